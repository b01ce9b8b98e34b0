"""Tables read by the places of their characters, and invoice numbers without a label.

A head line's cells and the words of the rows below it are intervals of characters; a word belongs to
the cell that it overlaps most. So an empty column stays empty, and a right-aligned value finds its head.
Heads whose cells are parted by single spaces (collapsed ones) are read by order instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let, settle
from . import numbers as nb

# Names of columns, what they all hold, what is no value, label-free layouts with their trust.
HEADS = (
    ("date", r"(?i)factuurdatum|facturatiedatum|verzenddatum|vervaldatum|leverdatum|^datum$"),
    ("invoice", r"(?i)factuurnummer|factuurnr|faktuurnummer|faktuurnr|^factuur$"),
    ("customer", r"(?i)debiteurennummer|debiteurnummer|debiteurnr|klantnummer|klantnr|kundennummer|relatienummer|^customer(?: number)?$|^betaler$"),
)
HEAD_PARTS = r"(?i)datum|fa[ck]tuur|debiteur|klant|kunden|relatie|customer|betaler"
NO_VALUE = r"^(?:\d{2}-\d{2}-\d{4}|\d{4}-\d{2}-\d{2}|[Nn][Ll]\d{9}[Bb]\d{2})$"
MONEY = r"^\d+,\d{2}$"
ORDER_ROW = r"(?i)\b(?:ordernummer|bestelnummer|bestelnr|uw\s+referentie|onze\s+referentie)\b"
UNLABELLED = (
    ("factuur_colon", 84, r"(?i)^\s*Factuur\s*:\s*([A-Za-z0-9][A-Za-z0-9/-]{3,})\s*$"),
    ("factuur_plain", 83, r"(?i)^\s*Factuur\s+([A-Za-z0-9][A-Za-z0-9/-]{5,})\s*$"),
    ("factuur_inline", 85, r"(?i)\bFactuur\s+([A-Za-z]?\.?[A-Za-z0-9][A-Za-z0-9/.-]{4,})\b"),
    ("dotted_label_value", 88, r"(?i)\b(?:Nummer|Factuurnummer|Factuurnr|Faktuurnummer|FaktuurNr|Belegnummer)\s*[.\s]{2,}:?\s*([A-Za-z0-9][A-Za-z0-9/.-]{3,})"),
    ("year_slash_ref", 78, r"(?:^|[^A-Za-z0-9./])(\d{2}/\d{7,})"),
    ("multi_slash_ref", 82, r"(?:^|[^A-Za-z0-9./])(\d{2,4}/\d{2,4}/\d{5,})"),
    ("payment_reference", 84, r"(?i)\bvermelden\s+(\d{2,4}/\d{2,4}/\d{5,})\b"),
)
PREFIXED = r"(?i)\bFactuur\s+([A-Za-z]{1,8}\s+\d{6,})\b"
NUMBER_DAY = r"(?i)\bNummer\s*/\s*Datum\b[\s:]*([A-Za-z0-9][A-Za-z0-9/-]{4,})\s*/\s*\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b"
#: Rows below a head that are looked at, and the trust of each field's first one plus one.
BELOW, TRUST = 4, {"invoice": 90, "customer": 89}


def intervals(line: Column, cell: str) -> Column:
    """The parts of a line that match ``cell`` as (s, e, t): from character s up to e, with their text.

    ``cell`` has no group; white space between parts belongs to none.
    """
    gaps, parts = (F.regexp_extract_all(line, F.lit(rf"(\s*)({cell})"), F.lit(k)) for k in (1, 2))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,t:string>>").alias("out"))
    each = F.zip_with(gaps, parts, lambda g, p: F.struct(F.length(g).alias("g"), p.alias("t")))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + F.length(x["t"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["t"].alias("t")))).alias("out"))

    return F.aggregate(each, start, add)["out"]


def head_kind(text: Column) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), k) for k, p in HEADS])


def identifying(text: Column) -> Column:
    """Whether a word may be a number of a column: at least four characters with a digit, no date, no VAT number."""
    bare = F.regexp_replace(text, r"^[\W_]+|[\W_]+$", "")
    return let(bare, lambda x: (F.length(x) >= 4) & x.rlike(r"\d") & ~text.rlike(NO_VALUE) & (x.rlike("[A-Za-z]") | (F.length(F.regexp_replace(x, r"\D", "")) >= 4)))


def header_spans(line_table: DataFrame) -> DataFrame:
    """Candidates (doc_id, line_no, value, source, confidence) under heads of at least two known columns.

    The first row below that has a number counts (blank lines, rows of amounts and rows about orders are
    passed over). The trust falls by one for each line; it is 55 where more than one number stands under
    the column or the number overlaps no column. Collapsed heads go by order, dates not counted. A column
    without a number gives nothing; so do null and empty lines.
    """
    cells = intervals(F.col("line"), r"\S+(?: \S+)*")
    loose = F.col("line").rlike(r"\S\s{2,}\S")
    tight = F.filter(F.transform(F.split(F.trim("line"), r"\s+"), head_kind), lambda k: k.isNotNull())
    # most lines have no part of a head's name
    t = settle(line_table.where(F.col("line").rlike(HEAD_PARTS)).select("doc_id", "line_no", "line", "after"), loose.alias("loose"), F.when(loose, F.transform(cells, lambda c: F.struct(c["s"], c["e"], head_kind(c["t"]).alias("k")))).alias("cells"), F.when(~loose, tight).alias("heads")).drop("line")
    known = F.when(F.col("loose"), F.filter(F.transform("cells", lambda c: c["k"]), lambda k: k.isNotNull())).otherwise(F.col("heads"))
    t = t.where(F.size(known) >= 2)
    words = lambda x: F.filter(intervals(x, r"\S+"), lambda w: identifying(w["t"]))

    def is_row(x: Column) -> Column:
        parts = F.split(F.trim(x), r"\s+")
        counts = F.struct(F.size(F.filter(parts, identifying)).alias("ids"), F.size(F.filter(parts, lambda w: w.rlike(MONEY))).alias("money"))
        return ~x.rlike(ORDER_ROW) & let(counts, lambda c: (c["ids"] > 0) & ~((c["money"] >= 2) | ((c["money"] == 1) & (c["ids"] <= 1))))

    # the first row counts, so lines after it are not looked at
    nth = lambda j: F.struct(F.get("after", F.lit(j)).alias("x"), F.lit(j + 1).alias("j"))
    row = F.coalesce(*[F.when(is_row(F.get("after", F.lit(j))), nth(j)) for j in range(BELOW)])
    t = settle(t, row.alias("row")).where("row is not null")
    t = settle(t, words(F.col("row.x")).alias("words"))

    # of each word, the cell that it overlaps most; the first one of equals
    overlap = lambda w, c: F.least(w["e"], c["e"]) - F.greatest(w["s"], c["s"])
    best = lambda w: F.array_max(F.transform("cells", lambda c: F.struct(overlap(w, c).alias("o"), (-c["s"]).alias("s"))))
    t = settle(t, F.when(F.col("loose"), F.transform("words", lambda w: F.struct(w["t"].alias("t"), best(w).alias("b")))).alias("under"))

    def column(name: str) -> Column:
        cell = F.get(F.filter("cells", lambda c: c["k"] == name), F.lit(0))
        mine = F.filter("under", lambda u: u["b"]["s"] == -cell["s"])
        first = F.get(mine, F.lit(0))
        sure = (F.size(mine) == 1) & (first["b"]["o"] > 0)
        at = F.array_position("heads", name).cast("int") - 1
        dates = F.size(F.filter(F.slice("heads", F.lit(1), F.greatest(at, F.lit(0))), lambda h: h == "date"))
        value = F.when(F.col("loose"), first["t"]).when(at >= 0, F.get(F.transform("words", lambda w: w["t"]), at - dates))
        trust = F.when(F.col("loose") & ~sure, 55).otherwise(TRUST[name] - F.col("row.j"))
        return F.struct(value.alias("value"), F.lit(f"header_table_{name}").alias("source"), trust.cast("int").alias("confidence"))

    found = F.filter(F.array(*[column(k) for k in TRUST]), lambda x: x["value"].isNotNull())
    return settle(t, found.alias("found")).select("doc_id", "line_no", F.inline("found"))


def invoice_fallback(line_table: DataFrame) -> DataFrame:
    """Invoice numbers without a label of their own, by layouts, dated lines and label-free patterns.

    Each line is looked at once, with the next one where a number may stand there. A value comes once for
    each rule and line; implausible ones (years, VAT numbers, accounts, no digit) go.
    """
    def hits_of(source: str, trust: int, pattern: str, text: Column) -> Column:
        return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))), lambda v: nb._found(v, source, trust))

    line = F.coalesce("line", F.lit(""))
    two = F.concat(line, F.lit("\n"), F.coalesce(F.get("after", F.lit(0)), F.lit("")))
    here = [hits_of(*rule, line) for rule in (*nb.LAYOUTS, *UNLABELLED)]
    joined = F.transform(F.array_distinct(F.regexp_extract_all(line, F.lit(PREFIXED), F.lit(1))), lambda v: nb._found(F.concat(F.upper(F.regexp_extract(v, r"^\S+", 0)), F.regexp_extract(v, r"\S+$", 0)), "factuur_prefixed_digits", 81))
    below = F.when(line.rlike(r"(?i)\bNummer\s*/\s*Datum\b"), hits_of("nummer_datum_table", 80, NUMBER_DAY, two))
    none = F.array().cast("array<struct<value:string,source:string,confidence:int>>")
    found = line_table.select("doc_id", "line_no", F.inline(F.concat(*here, joined, F.coalesce(below, none))))
    found = found.unionByName(nb.dated_numbers(line_table))
    return found.where(nb.plausible_number(F.col("value")) & F.col("value").rlike(r"\d"))
