"""Allocation of credit notes to invoices, and settlement groups.

Invoices and credits share a batch key (supplier and year here). Amounts count as equal within
a cent.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from decimal import Decimal
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed, ship
from . import decisions as dec

CENT = Decimal("0.01")
MONEY = "decimal(18,2)"
#: Subsets of the first five invoices, small ones first, each in order.
SUBSETS = [list(c) for n in range(1, 6) for c in combinations(range(5), n)]


def _upto(rows: DataFrame, credits: DataFrame, value: str, out: str, least: Column) -> DataFrame:
    """For every credit, the first row of its batch whose ``value`` reaches ``least``: an as-of lookup.

    Credits and rows are lined up by value in one window, so nothing is paired. It runs from the
    largest value down, as Spark goes over each frame that ends with its partition anew.
    """
    line = rows.select("batch", F.col(value).alias("__v"), F.lit(1).alias("__kind"), F.col("doc_id").alias("__id"), F.struct("doc_id", "amount", F.col("pos"), F.col("running")).alias("__row"))
    asked = credits.select("batch", least.cast("decimal(28,2)").alias("__v"), F.lit(0).alias("__kind"), F.col("credit_id").alias("__id"), F.lit(None).cast(line.schema["__row"].dataType).alias("__row"))
    later = Window.partitionBy("batch").orderBy(F.desc("__v"), F.desc("__kind"), F.desc("__id")).rowsBetween(Window.unboundedPreceding, -1)
    both = line.withColumn("__v", F.col("__v").cast("decimal(28,2)")).unionByName(asked)
    return both.withColumn(out, F.last("__row", ignorenulls=True).over(later)).where("__kind = 0").select(F.col("__id").alias("credit_id"), out)


def subset_sums(first: Column) -> Column:
    """(total, n) of the :data:`SUBSETS` of a batch's first invoices, in their order."""
    masks = F.array(*[F.array(*[F.lit(i) for i in s]) for s in SUBSETS])
    total = lambda s: F.aggregate(s, F.lit(0).cast("decimal(28,2)"), lambda a, i: (a + F.get(first, i)["amount"]).cast("decimal(28,2)"))
    return F.filter(F.transform(masks, lambda s: F.struct(total(s).alias("total"), F.size(s).alias("n"))), lambda x: x["total"].isNotNull())


def subset_of(sums: Column, amount: Column) -> Column:
    """The first of :func:`subset_sums` that ``amount`` equals."""
    return F.get(F.filter(sums, lambda x: F.abs(x["total"] - amount) <= F.lit(CENT)), F.lit(0))


def _near(credits: DataFrame, invoices: DataFrame) -> DataFrame:
    cents = F.col("amount").cast(MONEY) * 100
    asked = credits.select("credit_id", "batch", F.explode(F.array(cents - 1, cents, cents + 1)).alias("__c"))
    return asked.join(invoices.select("batch", cents.alias("__c"), F.struct("amount", "doc_id").alias("__i")), ["batch", "__c"])


def exact_pairs(credits: DataFrame, invoices: DataFrame) -> DataFrame:
    """(credit_id, doc_id) of a batch whose amounts agree within a cent: an equi-join on cents."""
    return _near(credits, invoices).select("credit_id", F.col("__i.doc_id").alias("doc_id"))


def match_one(credits: DataFrame, invoices: DataFrame) -> DataFrame:
    """Matches every credit for itself, by the first rule that applies.

    ``credits``: credit_id, batch, amount, ref_number; ``invoices``: doc_id, batch, amount.
    """
    order = Window.partitionBy("batch").orderBy("amount", "doc_id")
    inv = invoices.where(F.col("amount") > F.lit(CENT)).withColumn("pos", F.row_number().over(order)).withColumn("running", F.sum("amount").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    totals = inv.groupBy("batch").agg(F.sum("amount").alias("available"), F.array_sort(F.collect_list(F.when(F.col("pos") <= 5, F.struct("pos", "amount")))).alias("first"))
    totals = totals.select("batch", "available", subset_sums(F.col("first")).alias("sums"))
    refs = credits.where("ref_number is not null").select("credit_id", "batch", F.upper("ref_number").alias("__r")).join(inv.select("batch", F.upper("doc_id").alias("__r"), F.col("amount").alias("ref_amount")), ["batch", "__r"]).select("credit_id", "ref_amount")
    exact = _near(credits, inv).groupBy("credit_id").agg(F.count("*").alias("n_exact"), F.min("__i")["amount"].alias("exact_amount"))
    c = credits.join(totals, "batch", "left").join(refs, "credit_id", "left").join(exact, "credit_id", "left")
    c = c.join(_upto(inv, credits, "amount", "fit", F.col("amount")), "credit_id", "left").join(_upto(inv, credits, "running", "span", F.col("amount") - F.lit(CENT)), "credit_id", "left")
    early = F.col("ref_amount").isNotNull() | F.col("n_exact").isNotNull()
    c = c.withColumn("subset", F.when(~early, subset_of(F.col("sums"), F.col("amount"))))
    rule = (
        F.when(F.col("available").isNull(), "none")
        .when(F.col("amount") > F.col("available") + F.lit(CENT), "exceeds")
        .when(F.col("ref_amount").isNotNull(), "reference")
        .when(F.col("n_exact") == 1, "amount_exact").when(F.col("n_exact") > 1, "amount_exact_many")
        .when(F.col("subset").isNotNull(), "amount_subset")
        .when(F.col("fit").isNotNull(), "amount_fit")
        .when(F.col("span")["pos"] >= 2, "amount_span")
        .otherwise("unsure")
    )
    c = c.withColumn("rule", rule)
    of = lambda **m: F.coalesce(*[F.when(F.col("rule") == k, v) for k, v in m.items()])
    linked = of(reference=F.lit(1), amount_exact=F.lit(1), amount_exact_many=F.lit(1), amount_subset=F.col("subset")["n"], amount_fit=F.lit(1), amount_span=F.col("span")["pos"])
    got = of(reference=F.col("ref_amount"), amount_exact=F.col("exact_amount"), amount_exact_many=F.col("exact_amount"), amount_subset=F.col("subset")["total"], amount_fit=F.col("amount"), amount_span=F.col("amount"))
    remaining = F.greatest(F.col("amount") - F.coalesce(got, F.lit(0).cast(MONEY)), F.lit(0).cast(MONEY)).cast(MONEY)
    method = F.when(F.col("rule").isin("none", "exceeds", "unsure"), "manual_review").when(F.col("rule") == "amount_exact_many", "amount_exact").otherwise(F.col("rule"))
    missed = F.col("ref_number").isNotNull() & ~F.col("rule").isin("none", "exceeds", "reference")
    warn = F.array_compact(F.array(
        F.when(F.col("rule") == "none", "no_same_supplier_invoices"), F.when(F.col("rule") == "exceeds", "credit_exceeds_available_invoices"),
        F.when(missed, "referenced_invoices_not_in_batch"), F.when(F.col("rule") == "amount_exact_many", "multiple_exact_amount_matches"),
        F.when(F.col("rule") == "unsure", "no_confident_match"), F.when(linked.isNotNull() & (remaining > F.lit(CENT)), "remaining_credit_unallocated"),
    ))
    confidence = of(reference=F.lit(95), amount_exact=F.lit(90), amount_exact_many=F.lit(75), amount_subset=F.lit(80), amount_fit=F.lit(70), amount_span=F.lit(75))
    return c.select("credit_id", "batch", "amount", method.alias("method"), F.coalesce(confidence, F.lit(0)).alias("confidence"), F.coalesce(linked, F.lit(0)).alias("n_linked"), remaining.alias("remaining"), F.array_join(warn, "|").alias("warnings"))


class _Pool:
    """What invoices of a batch have left, in cents, kept in order of it."""

    def __init__(self, left: dict[str, int]):
        self.left = left
        self.open = sorted((a, n) for n, a in left.items() if a > 1)
        self.total = sum(a for a, _ in self.open)
        self.by_number: dict[str, list[str]] = {}
        for n in left:
            self.by_number.setdefault(n.upper(), []).append(n)

    def take(self, name: str, amount: int) -> None:
        before = self.left[name]
        del self.open[bisect_left(self.open, (before, name))]
        self.total -= before
        self.left[name] = after = before - amount
        if after > 1:
            insort(self.open, (after, name))
            self.total += after

    def choose(self, credit: int, ref: str | None) -> tuple[str, list[str], str]:
        """Method, invoices and warnings of a credit."""
        open_ = self.open
        if not open_:
            return "manual_review", [], "no_same_supplier_invoices"
        if credit > self.total + 1:
            return "manual_review", [], "credit_exceeds_available_invoices"
        missed = ""
        if ref:
            hit = sorted((self.left[n], n) for n in self.by_number.get(ref.upper(), []) if self.left[n] > 1)
            if hit:
                return "reference", [n for _, n in hit], ""
            missed = "referenced_invoices_not_in_batch"
        at = bisect_left(open_, (credit - 1, ""))
        if at < len(open_) and open_[at][0] <= credit + 1:
            many = at + 1 < len(open_) and open_[at + 1][0] <= credit + 1
            return "amount_exact", [open_[at][1]], "|".join(x for x in (missed, "multiple_exact_amount_matches" * many) if x)
        for s in SUBSETS:
            if s[-1] < len(open_) and abs(sum(open_[i][0] for i in s) - credit) <= 1:
                return "amount_subset", [open_[i][1] for i in s], missed
        if (at := bisect_left(open_, (credit, ""))) < len(open_):
            return "amount_fit", [open_[at][1]], missed
        total = 0
        for k, (a, _) in enumerate(open_, 1):
            total += a
            if total + 1 >= credit:
                return "amount_span", [n for _, n in open_[:k]], missed
        return "manual_review", [], "|".join(x for x in (missed, "no_confident_match") if x)


ALLOCATIONS = "batch string, credit_id string, invoice_id string, method string, applied_cents long, remaining_cents long, warnings string"


def _least_linked(pairs: list[tuple[str, str | None]]) -> list[str]:
    """Of each (credit, invoice) of a batch, the least id that pairs link it with."""
    parent: dict[str, str] = {}

    def top(x: str) -> str:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for c, n in pairs:
        a, b = sorted((top(c), top(c if n is None else n)))
        parent[b] = a
    return [top(c) for c, _ in pairs]


def match_batches(credits: DataFrame, invoices: DataFrame, linked: bool = False) -> DataFrame:
    """Credits of a batch take from what is left of its invoices, the largest first.

    The order within a batch is part of the result, so a batch is one group; batches without
    credits do not take part. A credit that cannot be poured in full is left to review. A task holds
    the number and amount of each of a batch's invoices; a credit costs a search among them. With
    ``linked`` rows get ``component``, the least id that allocations link them with: allocations do not
    leave their batch, so the task that makes them knows it.
    """
    ship(credits.sparkSession)
    schema = ALLOCATIONS + (", component string" if linked else "")

    def run(cs: pd.DataFrame, inv: pd.DataFrame) -> pd.DataFrame:
        pool, out = _Pool(dict(zip(inv["doc_id"], (int(a * 100) for a in inv["amount"]), strict=True))), []
        rows = sorted(((int(a * 100), c, r) for c, a, r in zip(cs["credit_id"], cs["amount"], cs["ref_number"], strict=True)), key=lambda x: (-x[0], x[1]))
        for amount, credit, ref in rows:
            method, chosen, warn = pool.choose(amount, ref)
            rest, parts = amount, []
            for n in chosen:
                take = min(rest, pool.left[n])
                if rest > 1 and take > 1:
                    parts.append((n, take))
                    rest -= take
            if rest > 1 and parts:
                method, parts, rest, warn = "manual_review", [], amount, "|".join(x for x in (warn, "remaining_credit_unallocated") if x)
            for n, take in parts:
                pool.take(n, take)
                out.append((cs["batch"].iloc[0], credit, n, method, take, rest, warn))
            if not parts:
                out.append((cs["batch"].iloc[0], credit, None, method, 0, amount, warn))
        if linked:
            out = [(*x, least) for x, least in zip(out, _least_linked([x[1:3] for x in out]), strict=True)]
        return pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    # renewed columns: both sides may come from one table
    c = credits.select(*[F.col(x).alias(x) for x in ("batch", "credit_id", "amount", "ref_number")])
    i = invoices.join(credits.select("batch").distinct(), "batch", "left_semi").select(*[F.col(x).alias(x) for x in ("batch", "doc_id", "amount")])
    return c.groupBy("batch").cogroup(i.groupBy("batch")).applyInPandas(lambda a, b: run(a, b) if len(a) else pd.DataFrame(columns=[x.split()[0] for x in schema.split(", ")]), schema)


def pour(credits: DataFrame, invoices: DataFrame) -> DataFrame:
    """All credits of a batch, the largest first, over its invoices in order: (credit_id, doc_id, applied).

    Running sums lay both sides on one line, on which each stretch between two ends belongs to one
    credit and one invoice. One window holds the ends, so nothing is paired.
    """
    def ends(rows: DataFrame, order: list, **ids: str) -> DataFrame:
        running = Window.partitionBy("batch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        named = [F.col(ids[x]) if x in ids else F.lit(None).cast("string") for x in ("credit_id", "doc_id")]
        return rows.where("amount > 0").select("batch", F.sum("amount").over(running).cast("decimal(28,2)").alias("end"), named[0].alias("credit_id"), named[1].alias("doc_id"))

    both = ends(credits, [F.desc("amount"), "credit_id"], credit_id="credit_id").unionByName(ends(invoices, ["amount", "doc_id"], doc_id="doc_id"))
    # from the far end, as Spark goes over each frame that runs to the end of its partition anew
    back = Window.partitionBy("batch").orderBy(F.desc("end"), "credit_id", "doc_id")
    seen = back.rowsBetween(Window.unboundedPreceding, 0)
    parts = both.select(
        F.last("credit_id", ignorenulls=True).over(seen).alias("credit_id"), F.last("doc_id", ignorenulls=True).over(seen).alias("doc_id"),
        (F.col("end") - F.coalesce(F.lead("end").over(back), F.lit(0))).cast(MONEY).alias("applied"),
    )
    return parts.where("applied > 0 and credit_id is not null and doc_id is not null")


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): least node that edges (a, b) reach; labels are lowered until they stay.

    Edges do not cross suppliers, so distances are small. Rounds are checkpointed.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("__c")), "b").groupBy("a").agg(F.min("__c").alias("__c"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("component", "__c").alias("__m"), "component")
        jump = labels.select(F.col("node").alias("__m"), F.col("component").alias("__j"))
        after = checkpointed(lower.join(jump, "__m").select("node", F.least("__m", "__j").alias("after"), "component"))
        changed = after.where("after <> component").limit(1).count()
        labels = after.select("node", F.col("after").alias("component"))
        if not changed:
            return labels


def components(allocations: DataFrame, documents: DataFrame) -> DataFrame:
    """``documents`` with ``component``: the least id of the documents that allocations link it with, or its own.

    Allocations that know their component (``linked`` ones) are asked for it; others are joined up.
    """
    if "component" in allocations.columns:
        known = allocations.select(F.explode(F.array("credit_id", "invoice_id")).alias("doc_id"), "component").where("doc_id is not null").groupBy("doc_id").agg(F.min("component").alias("component"))
        return documents.join(known, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    edges = allocations.where("invoice_id is not null").select(F.col("credit_id").alias("a"), F.col("invoice_id").alias("b"))
    return documents.join(connected(edges), F.col("doc_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc_id")).drop("node")


def settle(allocations: DataFrame, documents: DataFrame) -> DataFrame:
    """Settlement groups: one per component of credits and the invoices they were poured over.

    ``allocations`` as from :func:`match_batches`, best with ``linked``; ``documents``: doc_id, doc_type, amount.
    """
    allocations = checkpointed(allocations)
    return net(allocations, components(allocations, documents))


def net(allocations: DataFrame, members: DataFrame) -> DataFrame:
    """Settlement groups of ``members``: doc_id, doc_type, amount, component."""
    per = allocations.groupBy(F.col("credit_id").alias("doc_id")).agg(F.sum("applied_cents").alias("applied"), F.max(F.when(F.col("invoice_id").isNull(), F.col("remaining_cents")).otherwise(F.lit(0))).alias("unallocated"), F.max("method").alias("method"), F.max("warnings").alias("warnings"))
    m = members.join(per, "doc_id", "left")
    is_inv = F.col("doc_type") == "invoice"
    g = m.groupBy("component").agg(
        F.count_if(is_inv).alias("n_invoices"), F.count_if(~is_inv).alias("n_credits"),
        F.coalesce(F.sum(F.when(is_inv, F.col("amount"))), F.lit(0)).cast("decimal(28,2)").alias("invoices_total"),
        F.coalesce(F.sum(F.when(~is_inv, F.col("amount"))), F.lit(0)).cast("decimal(28,2)").alias("credits_total"),
        (F.coalesce(F.sum("applied"), F.lit(0)).cast("decimal(26,0)") / 100).cast("decimal(28,2)").alias("credits_applied"),
        F.coalesce(F.bool_or(F.col("unallocated") > 1), F.lit(False)).alias("open_credit"),
        F.sha2(F.array_join(F.array_sort(F.collect_list("doc_id")), "|"), 256).alias("digest"),
    )
    due = (F.col("invoices_total") - F.col("credits_applied")).cast("decimal(28,2)")
    status = F.when(F.col("open_credit"), "manual_review").when(due < -F.lit(CENT), "refund_required").when(due <= 0, "zero_amount").otherwise("ok")
    return g.select(F.substring("digest", 1, 16).alias("group_id"), "component", "n_invoices", "n_credits", "invoices_total", "credits_total", "credits_applied", due.alias("final_amount_due"), status.alias("status"))


def group_decision(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """One decision per group: refund, zero and manual first, then the worst of its invoices by id.

    ``decisions``: doc_id, component, decision, reason_code. A group with status ``rejected`` has
    the decision of its document.
    """
    worst = decisions.groupBy("component").agg(
        F.min(F.when(F.col("decision") == "excluded", F.struct("doc_id", "reason_code")))["reason_code"].alias("excluded"),
        F.min(F.when(F.col("decision") == "needs_review", F.struct("doc_id", "reason_code")))["reason_code"].alias("review"),
    )
    j = groups.join(worst, "component", "left")
    reason = (
        F.when(F.col("status") == "refund_required", "credit_refund_required").when(F.col("status") == "zero_amount", "zero_amount").when(F.col("status") == "manual_review", "credit_match_needs_review")
        .when(F.col("excluded").isNotNull(), F.col("excluded")).when(F.col("review").isNotNull(), F.col("review")).otherwise("export_allowed")
    )
    own = F.col("status").isin("ok", "rejected")
    state = F.when((F.col("status") == "zero_amount") | (own & F.col("excluded").isNotNull()), "excluded").when(~own | F.col("review").isNotNull(), "needs_review").otherwise("included")
    return j.withColumn("reason_code", reason).withColumn("decision", state).drop("excluded", "review")


def decided_groups(rows: DataFrame, credits: DataFrame, invoices: DataFrame) -> DataFrame:
    """The engine: accepted documents are matched, netted and decided by settlement group.

    ``rows``: engine rows of all documents; ``credits`` and ``invoices`` as for :func:`match_batches`.
    A rejected document takes no part in matching; it is a row of its own with status
    ``rejected`` and its reason, so that every document is in one row of the result.
    """
    decided = dec.decide(dec.with_payable(dec.accept(rows)))
    refused = F.col("reject_reason").isNotNull()
    decided = checkpointed(decided.select(
        "doc_id", "doc_type", "amount", refused.alias("refused"),
        F.when(refused, dec.reject_status(F.col("reject_reason"))).otherwise(F.col("decision")).alias("decision"),
        F.when(refused, F.col("reject_reason")).otherwise(F.col("reason_code")).alias("reason_code"),
    ))
    taken = decided.where("not refused").select("doc_id")
    allocations = checkpointed(match_batches(credits.join(taken.withColumnRenamed("doc_id", "credit_id"), "credit_id", "left_semi"), invoices.join(taken, "doc_id", "left_semi"), linked=True))
    members = checkpointed(components(allocations, decided))
    alone = members.where("refused").select("component", F.lit("rejected").alias("__status"))
    groups = net(allocations, members).join(alone, "component", "left").withColumn("status", F.coalesce("__status", "status")).drop("__status")
    return group_decision(groups, members.where("refused or doc_type = 'invoice'").select("doc_id", "component", "decision", "reason_code"))
