"""From allocated credits to payable groups: lines, totals, outcomes, export, links and overrides.

Allocations are rows (credit_id, invoice_id, invoice_number, applied, remaining, status, method,
warnings). An unallocated rest is a row of its own without an invoice, with a status
``unallocated_full`` or ``unallocated_partial``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .credits import CENT, MONEY

TOTAL = "decimal(28,2)"
#: Warnings that ask for no review.
NEUTRAL = ("user_override", "user_detached")


def unallocated(status: Column) -> Column:
    return F.coalesce(status.startswith("unallocated_"), F.lit(False))


def applied_per_invoice(allocations: DataFrame) -> DataFrame:
    """(invoice_id, applied): what credits take off every invoice."""
    return allocations.where("invoice_id is not null").groupBy("invoice_id").agg(F.sum("applied").cast(TOTAL).alias("applied"))


def lines(documents: DataFrame, allocations: DataFrame) -> DataFrame:
    """One line per document: gross, applied and what is left of it.

    A credit's rest is what its unallocated rows say; an invoice's is gross less applied, 0 at least.
    """
    on_invoice = applied_per_invoice(allocations).withColumnRenamed("invoice_id", "doc_id")
    on_credit = allocations.groupBy(F.col("credit_id").alias("doc_id")).agg(F.sum("applied").cast(TOTAL).alias("applied"), F.sum(F.when(unallocated(F.col("status")), F.col("remaining")).otherwise(0)).cast(TOTAL).alias("rest"))
    both = documents.join(on_invoice.withColumn("rest", F.lit(None).cast(TOTAL)).unionByName(on_credit), "doc_id", "left")
    gross, applied = F.abs("amount").cast(TOTAL), F.coalesce("applied", F.lit(0).cast(TOTAL))
    rest = F.coalesce("rest", F.greatest(gross - applied, F.lit(0)))
    return both.select(*documents.columns, gross.alias("gross"), applied.alias("applied"), rest.cast(TOTAL).alias("remaining"))


def totals(members: DataFrame, allocations: DataFrame) -> DataFrame:
    """Settlement groups of ``members`` (doc_id, doc_type, amount, component) with their status.

    An unallocated credit sends its group to review; else a negative balance is a refund, and a
    balance of zero or of a negative cent is nothing to pay.
    """
    of = members.select(F.col("doc_id").alias("credit_id"), "component")
    found = allocations.join(of, "credit_id").groupBy("component").agg(
        F.bool_or(unallocated(F.col("status"))).alias("open_credit"),
        F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("warnings")))), ",").alias("warnings"),
    )
    line, is_inv = lines(members, allocations), F.col("doc_type") == "invoice"
    add = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast(TOTAL)
    per = line.groupBy("component").agg(F.count_if(is_inv).alias("n_invoices"), F.count_if(~is_inv).alias("n_credits"), add(is_inv, "gross").alias("invoices_total"), add(~is_inv, "gross").alias("credits_total"), add(~is_inv, "applied").alias("credits_applied"))
    due = (F.col("invoices_total") - F.col("credits_applied")).cast(TOTAL)
    status = F.when(F.col("open_credit"), "manual_review").when(due < -F.lit(CENT), "refund_required").when(due <= 0, "zero_amount").otherwise("ok")
    out = per.join(found, "component", "left").withColumn("final_amount_due", due).withColumn("status", status)
    return out.select("component", "n_invoices", "n_credits", "invoices_total", "credits_total", "credits_applied", "final_amount_due", "status", F.coalesce("open_credit", F.lit(False)).alias("open_credit"), F.coalesce("methods", F.lit("")).alias("methods"), F.coalesce("warnings", F.lit("")).alias("warnings"))


def exportable(groups: DataFrame) -> DataFrame:
    """Decided groups that are paid: settled, with something to pay, included, with no open credit."""
    return groups.where("status not in ('refund_required', 'manual_review', 'zero_amount') and final_amount_due > 0 and decision = 'included' and not open_credit")


def outcomes(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, decision, reason_code, reason_detail) of documents that refunds and open credits hold back."""
    j = members.join(groups.select("component", "status", "n_invoices", "final_amount_due"), "component").where("status = 'refund_required' or (status = 'manual_review' and doc_type = 'credit_note')")
    refund, alone = F.col("status") == "refund_required", F.col("n_invoices") == 0
    return j.select(
        "doc_id", F.when(~refund & alone, "excluded").otherwise("needs_review").alias("decision"),
        F.when(refund, "credit_refund_required").when(alone, "unallocated_credit_not_payable").otherwise("credit_match_needs_review").alias("reason_code"),
        F.when(refund, F.concat(F.lit("refund_amount="), F.abs("final_amount_due").cast("string"))).when(alone, "unallocated_credit").alias("reason_detail"),
    )


def by_type(members: DataFrame) -> DataFrame:
    """A group's documents by type, and the first usable customer number among them.

    Groups hold the documents of one supplier that credits tie together.
    """
    name = F.trim(F.coalesce("customer_code", F.lit("")))
    ids = lambda kind: F.array_join(F.array_sort(F.collect_list(F.when(F.col("doc_type") == kind, F.col("doc_id")))), ",").alias(f"{kind}s")
    first = F.min(F.when(~name.isin("", "?"), F.struct("doc_id", name.alias("code"))))["code"]
    return members.groupBy("component").agg(ids("invoice"), ids("credit_note"), first.alias("customer_number"))


def links(allocations: DataFrame, invoices: DataFrame) -> DataFrame:
    """(doc_id, credit_id, applied): allocations found again among ``invoices``, by id, else by number."""
    asked = allocations.where("invoice_id is not null or invoice_number is not null")
    by_id = asked.join(invoices.select(F.col("doc_id").alias("invoice_id"), F.lit(True).alias("__id")), "invoice_id", "left")
    hit = by_id.where("__id").select(F.col("invoice_id").alias("doc_id"), "credit_id", "applied")
    rest = by_id.where("__id is null and invoice_number is not null").select("invoice_number", "credit_id", "applied").join(invoices.select("doc_id", "invoice_number"), "invoice_number")
    return hit.unionByName(rest.select("doc_id", "credit_id", "applied")).groupBy("doc_id", "credit_id").agg(F.sum("applied").cast(TOTAL).alias("applied"))


def needs_review(allocations: DataFrame) -> DataFrame:
    """(credit_id, needs_review): something remains, or a person did not decide and the match is manual or warned of."""
    warned = F.exists("warnings", lambda x: ~F.trim(x).isin("", *NEUTRAL))
    per = (F.col("remaining") > 0) | ((F.col("method") != "user_override") & ((F.col("method") == "manual_review") | warned))
    return allocations.groupBy("credit_id").agg(F.bool_or(F.coalesce(per, F.lit(False))).alias("needs_review"))


def _totals_of(overrides: DataFrame, invoices: DataFrame) -> DataFrame:
    """Overrides (credit_id, batch, action, parts) with their usable parts joined to the invoices of their batch."""
    each = overrides.select("credit_id", "batch", F.explode("parts").alias("p")).select("credit_id", "batch", F.col("p.doc_id").alias("doc_id"), F.col("p.applied").alias("applied"))
    known = each.join(invoices.select("batch", "doc_id"), ["batch", "doc_id"]).where(F.col("applied") > F.lit(CENT))
    return known.groupBy("credit_id").agg(F.sum("applied").cast(TOTAL).alias("total"), F.array_sort(F.collect_list(F.struct("doc_id", F.col("applied").cast(MONEY).alias("applied")))).alias("used"))


def apply_overrides(matches: DataFrame, overrides: DataFrame, invoices: DataFrame) -> DataFrame:
    """Matches (credit_id, batch, amount, method) with the users' decisions in their place.

    ``overrides``: credit_id, batch, action (detach, reassign, adjust), parts (doc_id, applied). An
    override that does not add up is skipped with a reason, and the match stays.
    """
    capacity = invoices.groupBy("batch").agg(F.sum("amount").cast(TOTAL).alias("capacity"))
    o = overrides.select("credit_id", "action").join(_totals_of(overrides, invoices), "credit_id", "left")
    j = matches.join(o, "credit_id", "left").join(capacity, "batch", "left")
    total, cent = F.coalesce("total", F.lit(0).cast(TOTAL)), F.lit(CENT)
    left = (F.col("amount") - total).cast(TOTAL)
    reassign = F.col("action") == "reassign"
    skipped = (
        F.when(F.col("action").isNull(), F.lit(None)).when(F.col("amount").isNull(), "credit_amount_missing").when(F.col("action") == "detach", F.lit(None))
        .when(total > F.col("amount") + cent, "allocation_exceeds_credit")
        .when(reassign & (F.col("amount") > F.coalesce("capacity", F.lit(0)) + cent), "insufficient_invoices")
        .when(reassign & (left > cent), "partial_allocation")
    )
    taken = F.col("action").isNotNull() & skipped.isNull()
    event = F.when(F.col("action").isNull(), "auto_matched").when(skipped.isNotNull(), "override_skipped").when(F.col("action") == "detach", "user_detached").when(reassign, "user_reassigned").otherwise("user_allocation_adjusted")
    warnings = F.when(taken, F.when(F.col("action") == "detach", F.array(F.lit("user_detached"))).when(left > cent, F.array(F.lit("user_override"), F.lit("remaining_credit_unallocated"))).otherwise(F.array(F.lit("user_override"))))
    empty = F.array().cast(f"array<struct<doc_id:string,applied:{MONEY}>>")
    used = F.when(F.col("action") == "detach", empty).otherwise(F.coalesce("used", empty))
    return j.select(
        "credit_id", "batch", "amount", F.when(taken, "user_override").otherwise(F.col("method")).alias("method"), event.alias("event"), skipped.alias("skipped"),
        F.when(taken, used).alias("parts"), F.when(taken, F.when(F.col("action") == "detach", F.col("amount").cast(TOTAL)).otherwise(left)).alias("remaining"), warnings.alias("warnings"),
    )


def check_reassign(requests: DataFrame, invoices: DataFrame) -> DataFrame:
    """(credit_id, problem) of requests (credit_id, batch, amount, entries): null where they add up.

    ``entries`` are (doc_id, text) with amounts as typed, such as ``12,50``; blank ones do not count.
    """
    capacity = invoices.groupBy("batch").agg(F.sum("amount").cast(TOTAL).alias("capacity"))
    each = requests.select("credit_id", F.explode_outer("entries").alias("e")).select("credit_id", F.trim("e.text").alias("text"))
    value = F.when(F.col("text").rlike(r"^-?\d+([.,]\d{1,2})?$"), F.replace("text", F.lit(","), F.lit(".")).cast(MONEY))
    typed = F.coalesce(F.col("text") != "", F.lit(False))
    sums = each.withColumn("v", value).groupBy("credit_id").agg(F.bool_or(typed).alias("any"), F.bool_or(typed & F.col("v").isNull()).alias("bad"), F.coalesce(F.sum(F.when(F.col("v") > F.lit(CENT), F.col("v"))), F.lit(0)).cast(TOTAL).alias("total"))
    j = requests.join(sums, "credit_id").join(capacity, "batch", "left")
    cent = F.lit(CENT)
    problem = (
        F.when(F.col("amount") > F.coalesce("capacity", F.lit(0)) + cent, "insufficient_invoices").when(F.col("bad"), "invalid_amount").when(~F.col("any"), "empty")
        .when(F.col("total") > F.col("amount") + cent, "exceeds_credit").when(F.col("total") + cent < F.col("amount"), "partial_allocation")
    )
    return j.select("credit_id", problem.alias("problem"))
