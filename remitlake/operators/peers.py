"""Candidates kept or dropped for what else their document holds, without joining candidates to candidates.

Each value states what it says about other values (a K code that its bare digits repeat it, a long number
that its last four digits are a piece of it) as rows of (document, key, bit), and asks with the keys that
concern itself. One shuffle by document, then one window by (document, key), brings all answers together;
work and state grow with the candidates, not with their pairs. Where a document's candidates are an array
in its row already, :func:`judged` answers the same within the row, without any shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let, settle

# Sources, labels and shapes of customer numbers.
WEAK = ("delivery_block_six_digit", "ref_slash_customer", "collapsed_k_token", "collapsed_k_near_label")
LABELLED = ("label", "label_next_line", "collapsed_klantcode_fused")
ALLOWED = ("header_table_customer", "uw_klant_k_prefix", "klant_line_k_prefix", "ref_slash_customer", "standalone_k_token", "spaced_k_token", "line_only_k_code", "collapsed_k_token", "collapsed_k_near_label", *LABELLED)
SUFFIX_SOURCES = ("ref_slash_customer", "label_next_line", "label_block_next_line")
LABEL = r"(?i)\b(?:klantnummer|klantcode|klantnr|uw\s+klant|debiteurnummer|debiteurnr|debiteur|betaler|relatienummer|relatie|customer\s*(?:number|no|code|nr|id)|kundennummer)\b"
K_CODE = r"^k\d{4,8}$"
REFERENCE_LINE = r"(?i)\b(?:uw|onze|jullie|your)\s+referentie\b"
BANK = r"(?i)\b(?:iban|rekening(?:nummer)?|bankrekening|rabobank|abn\s*amro)\b"
PACKING = r"(?i)\b(?:pakbon(?:nummer|-nummer)?|packing\s*slip|leveringsbon|afleverbon)\b"
#: Why a value goes, by bit.
REASONS = {"repeats_k_code": 1, "glued_k_code": 2, "smeared_kvk": 4, "slashed_peer": 8, "short_suffix": 16, "weak_beside_label": 32, "unlabelled": 64, "no_customer_value": 128}
_KEYS = "array<struct<key:string,bit:int,ask:boolean>>"


def _any(*patterns: str) -> str:
    """One pattern that holds where any of ``patterns`` does; a letter's case counts in none of them."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


# Shapes of other things than customer numbers: anywhere, after spaces and marks are gone, and without a label.
NEVER = _any(r"^\d{1,3}dg$", r"^V[FO].*\d", r"^F\d{5,}$", r"^NL[0-9A-Z]{2,6}$", r"^20\d{2}$", r"^\d{4}[a-z]{2}$")
NEVER_TIGHT = _any(r"^[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$", r"^(?:NL)?\d{9}B\d{2}$", r"^NL\d{2}[A-Z]{4}\d{6,20}$")
BARE = _any(r"^\d+[A-Z]{1,4}$", r"^\d{9,}$", r"^k\d{7,8}$", r"^20\d{6}$", r"^\d{1,2}[./-]\d{1,2}[./-]\d{2,4}$", r"^\d{4}[./-]\d{1,2}[./-]\d{1,2}$", r"^\d{8}$")


def customer_value(value: Column, context: Column) -> Column:
    """Whether a value may be a customer number, by its shape and by the line that it stands on."""
    def shaped(v: Column, line: Column, labelled: Column) -> Column:
        tight = F.upper(F.regexp_replace(v, r"[\s._/-]+", ""))
        ordered = v.rlike(r"^20\d{4,6}$") & (_after_reference(v, line) | (~labelled & line.rlike(REFERENCE_LINE)))
        never = ~v.rlike(r"\d") | (F.length(v) < F.when(labelled, 2).otherwise(3)) | ordered | line.rlike(PACKING) | v.rlike(NEVER) | tight.rlike(NEVER_TIGHT)
        bare = v.rlike(BARE) | (v.rlike(r"^\d{6,}$") & ~line.rlike(r"(?i)\bafleveradres\b")) | (v.rlike(r"^[A-Z]\d{4,8}$") & line.rlike(r"(?i)\b(?:bron|referentie|levering|ref)\b")) | line.rlike(BANK)
        return ~never & (labelled | ~bare)

    v, line = F.trim(F.coalesce(value, F.lit(""))), F.coalesce(context, F.lit(""))
    return let(F.struct(v.alias("v"), line.alias("line"), line.rlike(LABEL).alias("labelled")), lambda x: shaped(x["v"], x["line"], x["labelled"]))


def _after_reference(v: Column, line: Column) -> Column:
    """Whether the value comes right after a reference label; used for plain digits only."""
    after = F.regexp_extract_all(line, F.lit(r"(?i)\b(?:uw|onze|jullie|your)\s+referentie\s*:?\s*(\d+)\b"), F.lit(1))
    return F.array_contains(after, v)


def _keys(v: Column, collapsed: Column) -> Column:
    """What a lower-case value claims of others and asks for itself; only ``collapsed`` ones ask for slashed peers."""
    k, digits, canon = v.rlike(r"^k\d{4,12}$"), v.rlike(r"^\d+$"), F.regexp_replace(v, "[^a-z0-9]", "")
    row = lambda when, name, key, bit, ask: F.when(when, F.struct(F.concat(F.lit(f"{name}:"), key).alias("key"), F.lit(bit).alias("bit"), F.lit(ask).alias("ask")))
    rest = F.substring(v, 2, 12)
    b = REASONS
    out = F.array(
        row(k, "digits", rest, b["repeats_k_code"], False), row(digits, "digits", v, b["repeats_k_code"], True),
        row(v.rlike(K_CODE), "code", v, b["glued_k_code"], False), row(v.rlike(K_CODE), "kvk", rest, b["smeared_kvk"], True),
        row(v.contains("/"), "slash", canon, b["slashed_peer"], False), row(collapsed & ~v.contains("/"), "slash", canon, b["slashed_peer"], True),
        row(v.rlike(r"^\d{8,12}$"), "end", F.right(v, F.lit(4)), b["short_suffix"], False), row(v.rlike(r"^\d{4}$"), "end", v, b["short_suffix"], True),
        F.struct(F.lit("self").alias("key"), F.lit(0).alias("bit"), F.lit(True).alias("ask")),
    )
    # a longer code asks with each shorter one that it may begin with
    shorter = F.when(v.rlike(K_CODE) & (F.length(v) > 5), F.transform(F.sequence(F.lit(5), F.length(v) - 1), lambda n: F.struct(F.concat(F.lit("code:"), F.substr(v, F.lit(1), n)).alias("key"), F.lit(b["glued_k_code"]).alias("bit"), F.lit(True).alias("ask"))))
    return F.concat(F.array_compact(out).cast(_KEYS), F.coalesce(shorter.cast(_KEYS), F.array().cast(_KEYS)))


def judge(found: DataFrame, texts: DataFrame) -> DataFrame:
    """``found`` with ``reasons``, the bits of :data:`REASONS` for which each candidate goes; 0 keeps it.

    ``found``: doc_id, value, source, line_no, context; ``texts``: doc_id, text. Values are compared
    without regard to case; rows without a document or value have no peers and go as no customer value.
    Repeated candidates share their verdict as far as source and line are the same. A document's
    candidates of one value are gathered, which its own text bounds.
    """
    rows = found.withColumn("__v", F.lower(F.trim(F.coalesce("value", F.lit(""))))).repartition("doc_id")
    source = F.coalesce("source", F.lit(""))
    each = rows.groupBy("doc_id", "__v").agg(F.collect_list(F.struct(*found.columns)).alias("__rows"), F.bool_or(_telling(source)).alias("__told"), F.bool_or(F.startswith(source, F.lit("collapsed_"))).alias("__glued"))
    each = each.select("doc_id", "__v", "__rows", F.bool_or("__told").over(Window.partitionBy("doc_id")).alias("__told"), F.explode(_keys(F.col("__v"), F.col("__glued"))).alias("__k"))
    own = F.col("__k.key") == "self"
    each = each.select("doc_id", "__v", F.when(own, F.col("__rows")).alias("__rows"), F.when(own, F.col("__told")).alias("__told"), "__k.*")
    # runs of digits after kvk, in the text without anything but letters and digits; K codes may be a piece of them
    runs = F.regexp_extract_all(F.regexp_replace(F.lower("text"), "[^a-z0-9]", ""), F.lit(r"kvk(\d{4,8})"), F.lit(1))
    run = texts.select("doc_id", F.explode(F.array_distinct(runs)).alias("__r"))
    kvk = run.select("doc_id", F.explode(F.transform(F.sequence(F.lit(4), F.length("__r")), lambda n: F.substr("__r", F.lit(1), n))).alias("__r"))
    kvk = kvk.select("doc_id", F.concat(F.lit("kvk:"), "__r").alias("key"), F.lit(REASONS["smeared_kvk"]).alias("bit"), F.lit(False).alias("ask"))
    both = each.unionByName(kvk, allowMissingColumns=True)
    claimed = F.bit_or(F.when(~F.col("ask"), F.col("bit")).otherwise(0)).over(Window.partitionBy("doc_id", "key"))
    answered = both.withColumn("__c", claimed.bitwiseAND(F.col("bit"))).where("ask")
    value = answered.groupBy("doc_id", "__v").agg(F.bit_or("__c").alias("__c"), F.first("__rows", True).alias("__rows"), F.bool_or("__told").alias("__told"))
    out = value.select("__v", "__c", "__told", F.inline("__rows"))
    return out.select(*found.columns, _reasons(F.col("__c"), F.col("__v"), F.col("value"), source, F.col("context"), F.col("__told")).alias("reasons"))


def _telling(source: Column) -> Column:
    """Whether a candidate of this source stands by a label."""
    return source.rlike("^(?:label_block|klantcode)") | source.isin(*LABELLED)


def _reasons(claimed: Column, v: Column, value: Column, source: Column, context: Column, told: Column) -> Column:
    """All bits of a candidate from those that its peers ``claimed`` and from its own source, shape and line."""
    says = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), REASONS[name]).otherwise(0)
    peer = lambda name: claimed.bitwiseAND(F.lit(REASONS[name])) != 0
    allowed = source.isin(*ALLOWED) | source.rlike("^(?:label_block|klantcode)") | v.rlike(K_CODE) | F.coalesce(context.rlike(LABEL), F.lit(False))
    tests = [
        says(peer("repeats_k_code"), "repeats_k_code"), says(peer("glued_k_code"), "glued_k_code"), says(peer("smeared_kvk"), "smeared_kvk"),
        says(peer("slashed_peer") & F.startswith(source, F.lit("collapsed_")), "slashed_peer"),
        says(peer("short_suffix") & source.isin(*SUFFIX_SOURCES), "short_suffix"),
        says(told & source.isin(*WEAK), "weak_beside_label"),
        says(~told & ~allowed, "unlabelled"),
        says(~customer_value(value, context), "no_customer_value"),
    ]
    return reduce(Column.__add__, tests).cast("int")


def judged(rows: DataFrame, found: str, text: str) -> DataFrame:
    """One row for each entry of the array ``found`` (value, source, line_no, context) of each of ``rows``, with ``reasons``.

    The verdicts of :func:`judge` where a document is one row that holds all its candidates and its
    ``text``; nothing is shuffled. A candidate is sought among the values of its own document only.
    """
    source = lambda x: F.coalesce(x["source"], F.lit(""))
    rest = lambda v: F.substring(v, 2, 12)
    canon = lambda v: F.regexp_replace(v, "[^a-z0-9]", "")
    some = lambda pattern, of: F.transform(F.filter(F.col("__vs"), lambda v: v.rlike(pattern)), of)
    keep = [c for c in rows.columns if c not in (found, text)]
    t = rows.where(F.size(found) > 0)
    t = settle(t, F.transform(found, lambda x: F.lower(F.trim(F.coalesce(x["value"], F.lit(""))))).alias("__all"), F.exists(found, lambda x: _telling(source(x))).alias("__told"))
    t = settle(t, F.array_distinct("__all").alias("__vs"))
    # runs of digits after kvk, in the text without anything but letters and digits; K codes may be a piece of them
    runs = let(F.lower(text), lambda x: F.when(x.contains("v"), F.regexp_extract_all(F.regexp_replace(x, "[^a-z0-9]", ""), F.lit(r"kvk(\d{4,8})"), F.lit(1))))
    t = settle(t, F.struct(
        some(r"^k\d{4,12}$", rest).alias("digits"), some(K_CODE, lambda v: v).alias("codes"), some("/", canon).alias("slash"), some(r"^\d{8,12}$", lambda v: F.right(v, F.lit(4))).alias("ends"),
        F.coalesce(runs, F.array().cast("array<string>")).alias("kvk"),
    ).alias("__p"))
    bit = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), REASONS[name]).otherwise(0)
    has = lambda name, v: (F.size(F.col("__p")[name]) > 0) & F.array_contains(F.col("__p")[name], v)

    def claimed(x: Column, v: Column) -> Column:
        tests = [
            bit(v.rlike(r"^\d+$") & has("digits", v), "repeats_k_code"),
            bit(v.rlike(K_CODE) & F.exists(F.col("__p")["codes"], lambda p: (F.length(p) < F.length(v)) & F.startswith(v, p)), "glued_k_code"),
            bit(v.rlike(K_CODE) & F.exists(F.col("__p")["kvk"], lambda r: F.startswith(r, rest(v))), "smeared_kvk"),
            bit(F.startswith(source(x), F.lit("collapsed_")) & ~v.contains("/") & has("slash", canon(v)), "slashed_peer"),
            bit(v.rlike(r"^\d{4}$") & has("ends", v), "short_suffix"),
        ]
        return reduce(Column.__add__, tests)

    def row(x: Column, v: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("value", "source", "line_no", "context")], let(claimed(x, v), lambda c: _reasons(c, v, x["value"], source(x), x["context"], F.col("__told"))).alias("reasons"))

    return t.select(*keep, F.inline(F.zip_with(found, "__all", row)))


# VAT labels and the number itself.
VAT = r"\b(NL\d{9}B\d{2})\b"
VAT_NR = r"(?i)\bbtw\s*(?:nr\b\.?|nummer\b)"
VAT_BARE = r"(?i)\bbtw\s*:"


def vat_candidates(texts: DataFrame) -> DataFrame:
    """(doc_id, line_no, n_lines, value, kind) of (doc_id, text): VAT numbers on a line with a number label
    (``btw_nr``), with a bare label (``btw``), or without (``regex``). Null and empty texts give none."""
    split = texts.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("__l"))
    line = split.select("doc_id", F.size("__l").alias("n_lines"), F.posexplode("__l").alias("line_no", "line"))
    kind = F.when(F.col("line").rlike(VAT_NR), "btw_nr").when(F.col("line").rlike(VAT_BARE), "btw").otherwise("regex")
    return line.select("doc_id", "line_no", "n_lines", F.explode(F.regexp_extract_all("line", F.lit(VAT), F.lit(1))).alias("value"), kind.alias("kind"))


def drop_footer_vat(found: DataFrame) -> DataFrame:
    """Without footer copies where the head of the page names a VAT number by a label.

    The head is the first fifth of the lines, at least twelve, at most half; the foot likewise from the
    end. With a number label above, values of bare labels that stand in the foot go; with any label
    above, those without a label. A value stands in a part if any of its candidates does.
    """
    n = F.col("n_lines")
    part = F.greatest(F.lit(12), F.floor(n * F.lit(2) / 10).cast("int"))
    head = F.least(part, F.greatest(F.lit(1), F.floor((n + 1) / 2).cast("int")))
    foot = n - F.least(part, F.greatest(F.lit(1), n - head))
    doc, value = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "value")
    t = found.repartition("doc_id").withColumn("__up", F.min("line_no").over(value) < head).withColumn("__down", F.max("line_no").over(value) >= foot)
    label = F.col("kind") != "regex"
    t = t.withColumn("__nr", F.bool_or(F.col("__up") & (F.col("kind") == "btw_nr")).over(doc)).withColumn("__any", F.bool_or(F.col("__up") & label).over(doc))
    gone = F.col("__down") & ((F.col("__nr") & (F.col("kind") == "btw")) | (F.col("__any") & (F.col("kind") == "regex")))
    return t.where(~gone).drop("__up", "__down", "__nr", "__any")
