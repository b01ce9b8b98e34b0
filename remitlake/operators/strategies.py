"""All ways to propose an extraction rule from a confirmed value, tried on a document at once.

A text meets its confirmed values by one join on the document; everything else is an expression over the
array of its lines, so no strategy explodes, sorts or joins lines again. Every strategy gives one row:
``proposed`` with a rule and its label, ``invalid`` with a reason, or ``skipped`` where it does not apply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let, settle

# Names of strategies in their order, patterns of labels, tags and amounts.
STRING_STRATEGIES = (
    "token_matching_confirmed_value", "same_line_value_after_label", "factuur_inline_pagina", "generic_label_same_line_after_colon", "label_then_next_line",
    "last_token_on_line", "slash_compound_split", "ocr_tag_extraction", "fallback_value_locate_minimal_label",
)
AMOUNT_STRATEGIES = ("token_matching_confirmed_amount", "amount_label_next_line", "derived_excl_plus_vat", "unlabeled_prefix_amount", "amount_from_context", "amount_fallback_scan")
PAGE = r"(?i)\bFactuur\s+([A-Za-z0-9][A-Za-z0-9/-]{4,})\s+Pagina\b"
TAG = r"\[O\+[^\]]+\]"
AMOUNT = r"\d{1,3}(?:[.,]\d{3})+[.,]\d{2}|\d+[.,]\d{2}"
TOTAL = r"(?i)\b(?:te\s+betalen|te\s+voldoen|totaal\s+factuurbedrag|factuurbedrag|factuurtotaal|eindbedrag|amount\s+due|totaal|total)\b"
EXCL = r"(?i)\b(?:excl\.?\s*btw|exclusief\s+btw|netto\s+goederenbedrag)\b"
VAT_LINE = r"(?i)\bbtw\s*(?:\d{1,2}\s*%|:)"


def _or_null(text: Column, least: int) -> Column:
    return F.when(F.length(text) >= least, text)


def _colon_label(line: Column, prefix: Column) -> Column:
    """What stands before the first colon, where the value comes after it; at least one character."""
    return F.when(prefix.contains(":"), _or_null(F.trim(F.substring_index(line, ":", 1)), 1))


def _row(name: str, rule: Column, label: Column, candidate: Column, reason: Column | str, skipped: Column | None = None) -> Column:
    """One strategy's row; it proposes where the label is known and the value found."""
    ok = label.isNotNull() & candidate.isNotNull()
    skip = F.lit(False) if skipped is None else F.coalesce(skipped, F.lit(True))
    why = F.lit(reason) if isinstance(reason, str) else reason
    status = F.when(skip, "skipped").when(ok, "proposed").otherwise("invalid")
    kept = lambda c: F.when(~skip & ok, c)
    return F.struct(F.lit(name).alias("strategy"), status.alias("status"), kept(rule).alias("rule"), kept(label).alias("label"), kept(candidate).alias("candidate"), F.when(~skip & ~ok, why).alias("reason"))


def _met(texts: DataFrame, confirmed: DataFrame, columns: list[str]) -> DataFrame:
    lines = texts.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    return lines.join(confirmed.select("doc_id", *columns), "doc_id")


def strings(texts: DataFrame, confirmed: DataFrame) -> DataFrame:
    """The nine strategies for (doc_id, field_id, confirmed): doc_id, field_id, strategy, status, rule, label, candidate, reason.

    The first line that holds the value, without regard to case, counts. Null and blank values are not
    found anywhere; documents without a text give invalid rows; repeated values give repeated rows.
    """
    t = _met(texts, confirmed, ["field_id", F.trim(F.coalesce("confirmed", F.lit(""))).alias("v")])
    low = F.lower("v")
    holds = lambda needle: F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("line"))), lambda s: (needle != "") & F.contains(F.lower(s["line"]), needle))
    part = F.lower(F.trim(F.substring_index("v", "/", 1)))
    t = t.withColumn("at", F.get(holds(low), F.lit(0))).withColumn("half", F.when(F.col("v").contains("/"), F.get(holds(part), F.lit(0))))
    t = t.withColumn("line", F.col("at.line")).withColumn("before", F.get("lines", F.col("at.i") - 1))
    t = t.withColumn("pos", F.expr("instr(lower(line), lower(v))"))
    t = t.withColumn("prefix", F.trim(F.expr("substring(line, 1, pos - 1)"))).withColumn("actual", F.expr("substring(line, pos, length(v))"))
    page = F.get(F.filter(F.transform("lines", lambda x: F.regexp_extract(x, PAGE, 1)), lambda x: (x != "") & (F.lower(x) == low)), F.lit(0))
    tagged = F.get(F.filter("lines", lambda x: x.rlike(TAG) & F.contains(F.lower(x), low) & (low != "")), F.lit(0))
    half = F.expr("trim(substring(half.line, 1, instr(lower(half.line), lower(trim(substring_index(v, '/', 1)))) - 1))")
    # rows name their parts several times, so those are columns of their own first
    t = t.withColumns({"page": F.when(F.col("field_id") == "invoice_number", page), "tagged": tagged, "above": _or_null(F.trim(F.substring_index("before", ":", 1)), 2), "colon": _colon_label(F.col("line"), F.col("prefix")), "half_label": _colon_label(F.col("half.line"), half)})
    t = t.drop("lines").withColumn("tag_label", F.trim(F.regexp_extract("tagged", r"^(.*?)\[O\+", 1)))
    line, prefix, actual, found = F.col("line"), F.col("prefix"), F.col("actual"), F.col("at").isNotNull()
    above, colon, own, page, tagged, tag_label = F.col("above"), F.col("colon"), _or_null(prefix, 2), F.col("page"), F.col("tagged"), F.col("tag_label")
    why = lambda reason: F.when(~found, "value_not_in_text").otherwise(reason)
    after = lambda x: F.when(x.contains(":"), "same_line_after_colon").otherwise("same_line_value_after_label")
    number = F.col("field_id") == "invoice_number"
    slash = F.col("v").contains("/")
    n = STRING_STRATEGIES
    rows = F.array(
        _row(n[0], F.when(own.isNotNull(), after(prefix)).otherwise("next_line_first_token"), F.coalesce(own, above), actual, why("no_label_near_value")),
        _row(n[1], F.lit("same_line_value_after_label"), _or_null(prefix, 1), actual, why("no_label_prefix")),
        _row(n[2], F.lit("factuur_inline_pagina"), F.lit("Factuur"), page, "pattern_not_found", ~number),
        _row(n[3], F.lit("same_line_after_colon"), colon, actual, why("no_colon_label")),
        _row(n[4], F.lit("next_line_first_token"), above, actual, F.when(~found, "value_not_in_text").when(F.col("at.i") < 1, "no_line_above").otherwise("no_label")),
        _row(n[5], F.lit("last_token_on_line"), F.coalesce(colon, _or_null(prefix, 3)), actual, why("no_label")),
        _row(n[6], F.lit("same_line_after_colon"), F.col("half_label"), F.col("v"), F.when(F.col("half").isNull(), "value_not_in_text").otherwise("no_label"), ~slash),
        _row(n[7], F.lit("ocr_tag_extraction"), F.coalesce(_or_null(tag_label, 1), F.when(tagged.isNotNull(), "OCR")), F.when(tagged.isNotNull(), F.col("v")), "ocr_tag_not_found"),
        _row(n[8], F.when(line.contains(":"), "same_line_after_colon").otherwise("next_line_first_token"), F.when(line.contains(":"), F.coalesce(own, above)).otherwise(F.coalesce(above, own)), actual, why("no_minimal_label")),
    )
    return t.select("doc_id", "field_id", F.inline(rows))


def amounts(texts: DataFrame, confirmed: DataFrame) -> DataFrame:
    """The six strategies for (doc_id, cents, context): doc_id, strategy, status, rule, label, candidate, reason.

    ``cents`` is the confirmed amount, ``context`` (null: none) a line that it was confirmed on. Lines of
    sums without VAT and of VAT itself serve the derived strategy only. A document without a text, or a
    null amount, gives invalid rows.
    """
    t = _met(texts, confirmed, ["cents", "context"])
    to_cents = lambda x: F.regexp_replace(x, "[^0-9]", "").cast("long")

    def view(x: Column, i: Column) -> Column:
        return F.struct(i.alias("i"), x.alias("line"), F.transform(F.regexp_extract_all(x, F.lit(AMOUNT), F.lit(0)), to_cents).alias("sums"))

    def parted(s: Column) -> Column:
        part = lambda k: F.regexp_extract_all(s["line"], F.lit(f"(.*?)({AMOUNT})"), F.lit(k))
        return F.struct(s["line"].alias("line"), s["sums"].alias("sums"), part(0).alias("upto"), part(1).alias("gaps"))

    t = settle(t, F.transform("lines", view).alias("seen"))
    # of each line with the amount: what stands before it, its labels, and which amount of the line it is
    hit = F.filter("seen", lambda s: F.array_contains(s["sums"], F.col("cents")) & ~s["line"].rlike(EXCL) & ~s["line"].rlike(VAT_LINE))

    def place(s: Column, last: bool) -> Column:
        k = F.array_position(s["sums"], F.col("cents")).cast("int")
        if last:
            k = F.size(s["sums"]) + 1 - F.array_position(F.reverse(s["sums"]), F.col("cents")).cast("int")
        return F.concat(F.array_join(F.slice(s["upto"], 1, k - 1), ""), F.get(s["gaps"], k - 1))

    def placed(s: Column) -> Column:
        rule = F.when((F.size(s["sums"]) >= 2) & (F.get(s["sums"], F.lit(0)) == F.col("cents")), "same_line_first_amount").otherwise("same_line_last_amount")
        return F.struct(s["line"].alias("line"), rule.alias("rule"), place(s, False).alias("before"), F.trim(place(s, True)).alias("until"))

    def totals(s: Column) -> Column:
        total = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(s["before"], F.lit(TOTAL), F.lit(0))), -1)
        return F.struct(s["line"].alias("line"), s["rule"].alias("rule"), _colon_label(s["line"], s["before"]).alias("colon"), total.alias("total"), _or_null(s["until"], 3).alias("any"))

    def told(s: Column) -> Column:
        euro = F.when(s["line"].rlike(r"(?i)\bEUR\b|€"), "EUR")
        return F.struct(s["line"].alias("line"), s["rule"].alias("rule"), F.coalesce(s["colon"], s["total"]).alias("near"), F.coalesce(s["total"], euro).alias("scan"), s["any"].alias("any"))

    t = settle(t, F.transform(F.transform(F.transform(F.transform(hit, parted), placed), totals), told).alias("hits"))
    first = lambda field: F.get(F.filter("hits", lambda h: h[field].isNotNull()), F.lit(0))
    mine = F.get(F.filter("hits", lambda h: F.contains(h["line"], F.trim("context")) & (F.trim("context") != "") & F.coalesce(h["near"], h["scan"]).isNotNull()), F.lit(0))
    # patterns are tried last, on the lines that the rest leaves
    above = F.filter("seen", lambda s: F.coalesce(F.array_contains(F.get("seen", s["i"] + 1)["sums"], F.col("cents")), F.lit(False)))
    pairs = F.filter(F.transform(above, lambda s: F.struct(F.regexp_extract(s["line"], TOTAL, 0).alias("label"), F.get("seen", s["i"] + 1)["sums"].alias("sums"))), lambda p: p["label"] != "")
    summed = F.filter("seen", lambda s: F.size(s["sums"]) > 0)
    last = lambda x: let(x, lambda y: F.get(y, F.size(y) - 1))
    t = t.withColumns({"near": first("near"), "scan": first("scan"), "any": first("any"), "mine": mine, "below": F.get(pairs, F.lit(0)), "excls": F.filter(summed, lambda s: s["line"].rlike(EXCL))})
    t = t.withColumns({"excl": F.get("excls", F.size("excls") - 1), "since": F.get("excls", F.lit(0))["i"]})
    t = t.withColumn("vat", last(F.filter("seen", lambda s: (s["i"] >= F.col("since")) & (F.size(s["sums"]) > 0) & s["line"].rlike(VAT_LINE))))
    sums = F.col("below.sums")
    under = F.when((F.size(sums) > 1) & ((F.get(sums, F.size(sums) - 1) == F.col("cents")) | (F.get(sums, F.lit(0)) != F.col("cents"))), "next_line_last_amount").otherwise("next_line_first_token")
    both = F.when(F.get("excl.sums", F.size("excl.sums") - 1) + F.get("vat.sums", F.size("vat.sums") - 1) == F.col("cents"), F.concat(F.regexp_extract("excl.line", EXCL, 0), F.lit(" + "), F.trim(F.regexp_extract("vat.line", VAT_LINE, 0))))
    t = t.withColumns({"under": under, "both": both}).drop("lines", "seen", "hits", "excls")
    under, both = F.col("under"), F.col("both")
    n, value = AMOUNT_STRATEGIES, F.col("cents").cast("string")
    rows = F.array(
        _row(n[0], F.col("near.rule"), F.col("near.near"), value, "amount_not_on_labeled_line"),
        _row(n[1], under, F.col("below.label"), value, "no_label_next_line"),
        _row(n[2], F.lit("derived_excl_plus_vat"), both, value, F.when(F.col("excl").isNull() | F.col("vat").isNull(), "derived_components_missing").otherwise("derived_mismatch")),
        _row(n[3], F.col("any.rule"), F.col("any.any"), value, "no_unlabeled_line"),
        _row(n[4], F.col("mine.rule"), F.coalesce("mine.near", "mine.scan"), value, "context_no_match", F.col("context").isNull()),
        _row(n[5], F.col("scan.rule"), F.col("scan.scan"), value, "no_eligible_line"),
    )
    return t.select("doc_id", F.inline(rows))
