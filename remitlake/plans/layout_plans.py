"""Tables read by character places, numbers without a label, and candidates judged beside their peers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layouts as ly
from ..operators import numbers as nb
from ..operators import peers as pr
from ..sources import fixtures as fx
from .book import query
from .fixture_sql import DOCS, SUP, w

LINES = "ln AS MATERIALIZED (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS line_no, unnest(string_split(text, chr(10))) AS line FROM lay)"


def _documents(spark, sf):
    d = fx.documents(spark, sf).join(fx.suppliers(spark, sf).select("supplier_id", "vat_number"), "supplier_id")
    return d.select("doc_id", "order_id", "vat_number", F.date_format("doc_date", "dd-MM-yyyy").alias("day"), F.lpad(F.col("order_id").cast("string"), 6, "0").alias("n"))


# The same columns for the SQL texts.
BASE = "b AS (SELECT doc_id, order_id, s.vat_number, strftime(doc_date, '%d-%m-%Y') AS day, lpad(CAST(order_id AS VARCHAR), 6, '0') AS n FROM docs d JOIN sup s ON d.supplier_id = s.supplier_id)"

TABLES = """lay AS (SELECT doc_id, CASE order_id % 6
  WHEN 0 THEN concat(rpad('Factuurdatum', 16, ' '), rpad('Factuurnummer', 18, ' '), 'Klantnummer', chr(10), rpad(day, 16, ' '), rpad(doc_id, 18, ' '), n)
  WHEN 1 THEN concat(rpad('Factuurdatum', 16, ' '), rpad('Factuurnummer', 18, ' '), 'Klantnummer', chr(10), rpad(day, 16, ' '), doc_id)
  WHEN 2 THEN concat(rpad('Factuurdatum', 16, ' '), rpad('Factuurnummer', 18, ' '), 'Klantnummer', chr(10), chr(10), rpad(day, 34, ' '), n)
  WHEN 3 THEN concat('Factuurdatum Factuurnummer Klantnummer', chr(10), day, ' ', doc_id, ' ', n)
  WHEN 4 THEN concat(lpad('Factuurnummer', 20, ' '), lpad('Betaler', 16, ' '), chr(10), '1200,00  1300,00', chr(10), lpad(doc_id, 20, ' '), lpad(n, 16, ' '))
  ELSE concat(rpad('Factuurnummer', 24, ' '), 'Klantnummer', chr(10), doc_id, ' ', n, chr(10), 'Ordernummer ', n) END AS text FROM b)"""


def _tables(spark, sf):
    d, k = _documents(spark, sf), F.col("order_id") % 6
    lit, rpad, lpad = F.lit, lambda c, n: F.rpad(c, n, " "), lambda c, n: F.lpad(c, n, " ")
    three = F.concat(rpad(lit("Factuurdatum"), 16), rpad(lit("Factuurnummer"), 18), lit("Klantnummer\n"))
    day, n = F.col("day"), F.col("n")
    text = (
        F.when(k == 0, F.concat(three, rpad(day, 16), rpad("doc_id", 18), n))
        .when(k == 1, F.concat(three, rpad(day, 16), "doc_id"))
        .when(k == 2, F.concat(three, lit("\n"), rpad(day, 34), n))
        .when(k == 3, F.concat(lit("Factuurdatum Factuurnummer Klantnummer\n"), day, lit(" "), "doc_id", lit(" "), n))
        .when(k == 4, F.concat(lpad(lit("Factuurnummer"), 20), lpad(lit("Betaler"), 16), lit("\n1200,00  1300,00\n"), lpad("doc_id", 20), lpad(n, 16)))
        .otherwise(F.concat(rpad(lit("Factuurnummer"), 24), lit("Klantnummer\n"), "doc_id", lit(" "), n, lit("\nOrdernummer "), n))
    )
    return d.select("doc_id", text.alias("text"))


KIND = "CASE WHEN regexp_matches({0}, '(?i)factuurdatum|facturatiedatum|verzenddatum|vervaldatum|leverdatum|^datum$') THEN 'date' WHEN regexp_matches({0}, '(?i)factuurnummer|factuurnr|faktuurnummer|faktuurnr|^factuur$') THEN 'invoice' WHEN regexp_matches({0}, '(?i)debiteurennummer|debiteurnummer|debiteurnr|klantnummer|klantnr|kundennummer|relatienummer|^customer(?: number)?$|^betaler$') THEN 'customer' END"
IDENT = r"(length(regexp_replace({0}, '^[\W_]+|[\W_]+$', '', 'g')) >= 4 AND regexp_matches({0}, '\d') AND NOT regexp_full_match({0}, '\d{{2}}-\d{{2}}-\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}|[Nn][Ll]\d{{9}}[Bb]\d{{2}}') AND (regexp_matches({0}, '[A-Za-z]') OR length(regexp_replace({0}, '\D', '', 'g')) >= 4))"
SPANS = rf"""wd AS MATERIALIZED (SELECT *, e - length(t) AS s FROM (SELECT *, sum(length(g) + length(t)) OVER (PARTITION BY doc_id, line_no ORDER BY i) AS e FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '(\s*)(\S+)', 1)) AS g, unnest(regexp_extract_all(line, '(\s*)(\S+)', 2)) AS t, generate_subscripts(regexp_extract_all(line, '(\s*)(\S+)', 2), 1) AS i FROM ln))),
  ce AS (SELECT *, e - length(t) AS s, {KIND.format('t')} AS kind FROM (SELECT *, sum(length(g) + length(t)) OVER (PARTITION BY doc_id, line_no ORDER BY i) AS e FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '(\s*)(\S+(?: \S+)*)', 1)) AS g, unnest(regexp_extract_all(line, '(\s*)(\S+(?: \S+)*)', 2)) AS t, generate_subscripts(regexp_extract_all(line, '(\s*)(\S+(?: \S+)*)', 2), 1) AS i FROM ln WHERE regexp_matches(line, '\S\s{{2,}}\S')))),
  hk AS (SELECT doc_id, line_no, kind, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY i) - 1 AS p FROM (SELECT *, {KIND.format('t')} AS kind FROM wd) WHERE kind IS NOT NULL AND (doc_id, line_no) NOT IN (SELECT (doc_id, line_no) FROM ce)),
  hd AS (SELECT doc_id, line_no, true AS loose FROM ce WHERE kind IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2 UNION ALL SELECT doc_id, line_no, false FROM hk GROUP BY 1, 2 HAVING count(*) >= 2),
  st AS (SELECT ln.doc_id, ln.line_no, count(*) FILTER (WHERE {IDENT.format('t')}) AS n_ids, count(*) FILTER (WHERE regexp_full_match(t, '\d+,\d{{2}}')) AS n_money FROM ln JOIN wd ON ln.doc_id = wd.doc_id AND ln.line_no = wd.line_no WHERE NOT regexp_matches(line, '(?i)\b(ordernummer|bestelnummer|bestelnr|uw\s+referentie|onze\s+referentie)\b') GROUP BY 1, 2),
  rw AS (SELECT hd.doc_id, hd.line_no, loose, min(st.line_no) AS r FROM hd JOIN st ON hd.doc_id = st.doc_id AND st.line_no BETWEEN hd.line_no + 1 AND hd.line_no + 4 WHERE n_ids > 0 AND NOT (n_money >= 2 OR (n_money = 1 AND n_ids <= 1)) GROUP BY 1, 2, 3),
  iw AS (SELECT rw.*, wd.s, wd.e, wd.t, row_number() OVER (PARTITION BY rw.doc_id, rw.line_no ORDER BY wd.s) - 1 AS p FROM rw JOIN wd ON rw.doc_id = wd.doc_id AND rw.r = wd.line_no WHERE {IDENT.format('t')}),
  ov AS (SELECT * FROM (SELECT iw.*, ce.s AS cs, ce.kind, least(iw.e, ce.e) - greatest(iw.s, ce.s) AS o, row_number() OVER (PARTITION BY iw.doc_id, iw.line_no, iw.p ORDER BY least(iw.e, ce.e) - greatest(iw.s, ce.s) DESC, ce.s) AS best FROM iw JOIN ce ON iw.doc_id = ce.doc_id AND iw.line_no = ce.line_no) WHERE best = 1),
  fc AS (SELECT doc_id, line_no, kind, min(s) AS cs FROM ce WHERE kind IN ('invoice', 'customer') GROUP BY 1, 2, 3),
  tr AS (SELECT * FROM (VALUES ('invoice', 90), ('customer', 89)) t(kind, trust))"""


@query("ex_header_spans", w(SUP, DOCS, BASE, TABLES, LINES, SPANS) + """SELECT doc_id, value, concat('header_table_', kind) AS source, CAST(confidence AS INT) AS confidence FROM (
  SELECT ov.doc_id, ov.kind, arg_min(ov.t, ov.s) AS value, CASE WHEN count(*) = 1 AND min(ov.o) > 0 THEN any_value(trust) - (any_value(r) - any_value(ov.line_no)) ELSE 55 END AS confidence FROM ov JOIN fc ON ov.doc_id = fc.doc_id AND ov.line_no = fc.line_no AND ov.cs = fc.cs JOIN tr ON ov.kind = tr.kind GROUP BY ov.doc_id, ov.line_no, ov.kind
  UNION ALL SELECT hk.doc_id, hk.kind, iw.t, trust - (iw.r - iw.line_no) FROM hk JOIN tr ON hk.kind = tr.kind JOIN iw ON hk.doc_id = iw.doc_id AND hk.line_no = iw.line_no AND NOT iw.loose AND iw.p = hk.p - (SELECT count(*) FROM hk d WHERE d.doc_id = hk.doc_id AND d.line_no = hk.line_no AND d.kind = 'date' AND d.p < hk.p))""")
def ex_header_spans(spark, sf):
    """Columns by overlap of characters; ``ex_header_table`` is the narrow form, by order of words."""
    return ly.header_spans(nb.lines(_tables(spark, sf))).select("doc_id", "value", "source", "confidence")


FREE = """lay AS (SELECT doc_id, CASE order_id % 10 WHEN 0 THEN concat('Factuur: ', doc_id) WHEN 1 THEN concat('Factuur F2', n) WHEN 2 THEN concat('Nummer.......:VF25-', n) WHEN 3 THEN concat('Factuur vf ', n, ' van heden') WHEN 4 THEN concat('Ref 25/1', n)
  WHEN 5 THEN concat('Bij betaling vermelden 25/10/', n) WHEN 6 THEN concat('Nummer / Datum', chr(10), doc_id, ' / ', day) WHEN 7 THEN concat('Datum Nummer', chr(10), replace(day, '-', '/'), ' 26FC', n, ' 1/2') WHEN 8 THEN concat('Factuur 2024', chr(10), 'BTW ', vat_number) ELSE concat('Factuur ', doc_id, ' Pagina 1') END AS text FROM b)"""


def _free(spark, sf):
    d, k, lit, n = _documents(spark, sf), F.col("order_id") % 10, F.lit, F.col("n")
    text = (
        F.when(k == 0, F.concat(lit("Factuur: "), "doc_id")).when(k == 1, F.concat(lit("Factuur F2"), n)).when(k == 2, F.concat(lit("Nummer.......:VF25-"), n)).when(k == 3, F.concat(lit("Factuur vf "), n, lit(" van heden"))).when(k == 4, F.concat(lit("Ref 25/1"), n))
        .when(k == 5, F.concat(lit("Bij betaling vermelden 25/10/"), n)).when(k == 6, F.concat(lit("Nummer / Datum\n"), "doc_id", lit(" / "), "day")).when(k == 7, F.concat(lit("Datum Nummer\n"), F.replace("day", lit("-"), lit("/")), lit(" 26FC"), n, lit(" 1/2"))).when(k == 8, F.concat(lit("Factuur 2024\nBTW "), "vat_number")).otherwise(F.concat(lit("Factuur "), "doc_id", lit(" Pagina 1")))
    )
    return d.select("doc_id", text.alias("text"))


def _rule(source: str, trust: int, pattern: str, text: str = "line") -> str:
    return f"SELECT doc_id, unnest(list_distinct(regexp_extract_all({text}, '{pattern}', 1))) AS value, '{source}' AS source, {trust} AS confidence FROM nx"


RULES = " UNION ALL ".join([
    _rule("factuur_inline_pagina", 86, r"(?i)\bFactuur\s+([A-Za-z0-9][A-Za-z0-9/-]{4,})\s+Pagina\b"), _rule("reg_invoice_row", 86, r"(?i)^\s*(REG[A-Z0-9][A-Z0-9/-]*\d+)\b"),
    _rule("nummer_inv", 88, r"(?i)\bNummer\s+(INV-[A-Za-z0-9-]+)\b"), _rule("nummer_reg", 88, r"(?i)\bNummer\s+(REG[A-Z0-9][A-Z0-9/-]*\d+)\b"), _rule("invoice_only_line", 87, r"(?i)\bINVOICE\s+([A-Za-z0-9][A-Za-z0-9/-]+)"),
    _rule("factuur_colon", 84, r"(?i)^\s*Factuur\s*:\s*([A-Za-z0-9][A-Za-z0-9/-]{3,})\s*$"), _rule("factuur_plain", 83, r"(?i)^\s*Factuur\s+([A-Za-z0-9][A-Za-z0-9/-]{5,})\s*$"), _rule("factuur_inline", 85, r"(?i)\bFactuur\s+([A-Za-z]?\.?[A-Za-z0-9][A-Za-z0-9/.-]{4,})\b"),
    _rule("dotted_label_value", 88, r"(?i)\b(?:Nummer|Factuurnummer|Factuurnr|Faktuurnummer|FaktuurNr|Belegnummer)\s*[.\s]{2,}:?\s*([A-Za-z0-9][A-Za-z0-9/.-]{3,})"), _rule("year_slash_ref", 78, r"(?:^|[^A-Za-z0-9./])(\d{2}/\d{7,})"),
    _rule("multi_slash_ref", 82, r"(?:^|[^A-Za-z0-9./])(\d{2,4}/\d{2,4}/\d{5,})"), _rule("payment_reference", 84, r"(?i)\bvermelden\s+(\d{2,4}/\d{2,4}/\d{5,})\b"),
    r"SELECT doc_id, concat(upper(regexp_extract(v, '^\S+')), regexp_extract(v, '\S+$')), 'factuur_prefixed_digits', 81 FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(line, '(?i)\bFactuur\s+([A-Za-z]{1,8}\s+\d{6,})\b', 1))) AS v FROM nx)",
    _rule("nummer_datum_table", 80, r"(?i)\bNummer\s*/\s*Datum\b[\s:]*([A-Za-z0-9][A-Za-z0-9/-]{4,})\s*/\s*\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b", "concat(line, chr(10), coalesce(n1, ''))") + r" WHERE regexp_matches(line, '(?i)\bNummer\s*/\s*Datum\b')",
    r"SELECT nx.doc_id, regexp_extract(b.line, '^\s*\d{1,2}/\d{1,2}/\d{4}\s+([A-Za-z0-9][A-Za-z0-9/-]{4,})\s', 1), 'datum_nummer_table', 87 - 2 * (b.line_no - nx.line_no) FROM nx JOIN ln b ON nx.doc_id = b.doc_id AND b.line_no BETWEEN nx.line_no + 1 AND nx.line_no + 3 WHERE regexp_matches(nx.line, '(?i)\bdatum\b') AND regexp_matches(nx.line, '(?i)\bnummer\b')",
    r"SELECT doc_id, regexp_extract(line, '^\s*\d{1,2}/\d{1,2}/\d{4}\s+([A-Za-z0-9][A-Za-z0-9/-]{4,})\s', 1), 'date_invoice_line', 79 FROM nx",
])
NEXT = "nx AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS n1 FROM ln)"


@query("ex_invoice_fallback", w(SUP, DOCS, BASE, FREE, LINES, NEXT) + rf"SELECT doc_id, value, source, CAST(confidence AS INT) AS confidence FROM ({RULES}) WHERE regexp_matches(value, '\d') AND NOT regexp_full_match(upper(regexp_replace(value, '[\s.]', '', 'g')), '20\d{{2}}|(NL)?\d{{9,12}}B\d{{2}}|NL\d{{2}}[A-Z]{{4}}\d{{10,20}}|[A-Z]{{6}}[A-Z0-9]{{2}}([A-Z0-9]{{3}})?')")
def ex_invoice_fallback(spark, sf):
    return ly.invoice_fallback(nb.lines(_free(spark, sf))).select("doc_id", "value", "source", "confidence")


PEERS = """lay AS (SELECT doc_id, CASE order_id % 8 WHEN 0 THEN concat('Klantnummer ', n, chr(10), 'Geleverd aan K', n) WHEN 1 THEN concat('Uw klant K', n, chr(10), 'Zie K', n, '52') WHEN 2 THEN concat('Klantnummer: K', n, chr(10), 'Ref ', n, ' / 4455') WHEN 3 THEN concat('Ref ', n, ' / 4455')
  WHEN 4 THEN concat('KvK 94', n, chr(10), 'Afgehaald door K94', n) WHEN 5 THEN concat('Klantnummer 12', n, chr(10), 'Klantcode', chr(10), right(n, 4)) WHEN 6 THEN concat('Klantnummer ', n, ' Uw referentie: 2026', right(n, 4)) ELSE concat('Debiteurnr. pakbon K', n) END AS text FROM b)"""


def _peers(spark, sf):
    d, k, lit, n = _documents(spark, sf), F.col("order_id") % 8, F.lit, F.col("n")
    end = F.right("n", lit(4))
    text = (
        F.when(k == 0, F.concat(lit("Klantnummer "), n, lit("\nGeleverd aan K"), n)).when(k == 1, F.concat(lit("Uw klant K"), n, lit("\nZie K"), n, lit("52"))).when(k == 2, F.concat(lit("Klantnummer: K"), n, lit("\nRef "), n, lit(" / 4455"))).when(k == 3, F.concat(lit("Ref "), n, lit(" / 4455")))
        .when(k == 4, F.concat(lit("KvK 94"), n, lit("\nAfgehaald door K94"), n)).when(k == 5, F.concat(lit("Klantnummer 12"), n, lit("\nKlantcode\n"), end)).when(k == 6, F.concat(lit("Klantnummer "), n, lit(" Uw referentie: 2026"), end)).otherwise(F.concat(lit("Debiteurnr. pakbon K"), n))
    )
    return d.select("doc_id", text.alias("text"))


# Peers are found by looking at every other candidate of the document.
TOKEN = r"list_filter(regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9./-]{{3,}}'), lambda x: regexp_matches(x, '\d') AND NOT regexp_full_match(x, '\d{{2}}-\d{{2}}-\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}'))"
FOUND = rf"""nx AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS n1 FROM ln),
  lb AS (SELECT *, {TOKEN.format("regexp_extract(line, '(?i)(klantnummer|klantcode|klantnr|debiteurnummer|debiteurnr|relatienummer|uw klant)(.*)$', 2)")} AS same, {TOKEN.format("coalesce(n1, '')")} AS below FROM nx WHERE regexp_matches(line, '(?i)\b(klantnummer|klantcode|klantnr|debiteurnummer|debiteurnr|relatienummer|uw\s+klant)')),
  raw AS (SELECT doc_id, line_no, unnest(same) AS v, 'label_block_same_line' AS source FROM lb UNION ALL SELECT doc_id, line_no, below[1], 'label_block_next_line' FROM lb WHERE len(same) = 0 AND len(below) > 0),
  sc AS (SELECT doc_id, -arg_max(line_no, c * 1000 - line_no) * -1 AS line_no, v, arg_max(source, c * 1000 - line_no) AS source FROM (SELECT doc_id, line_no, regexp_replace(v, '\s', '', 'g') AS v, source, c FROM (
    SELECT doc_id, line_no, concat('K', substr(unnest(regexp_extract_all(line, '(?i)\buw\s+(?:klant\s*:?\s*)?(k\d{{3,12}})\b', 1)), 2)) AS v, 'uw_klant_k_prefix' AS source, 90 AS c FROM ln UNION ALL SELECT doc_id, line_no, concat('K', substr(unnest(regexp_extract_all(line, '(?i)\bklant[^\n]{{0,48}}\s*:?\s*(k\d{{3,12}})\b', 1)), 2)), 'klant_line_k_prefix', 88 FROM ln
    UNION ALL SELECT doc_id, line_no, concat('K', substr(unnest(regexp_extract_all(line, '(?i)(?:^|[^a-z])(k\d{{4,12}})(?:$|\D)', 1)), 2)), 'standalone_k_token', 86 FROM ln UNION ALL SELECT doc_id, line_no, unnest(regexp_extract_all(line, '\b(\d{{4,}}\s*/\s*\d{{4,}})\b', 1)), 'ref_slash_customer', 76 FROM ln)) GROUP BY doc_id, v),
  f AS MATERIALIZED (SELECT x.doc_id, x.v AS value, lower(x.v) AS lv, x.source, ln.line AS context, regexp_matches(ln.line, '(?i)\b(klantnummer|klantcode|klantnr|uw\s+klant|debiteurnummer|debiteurnr|debiteur|betaler|relatienummer|relatie|kundennummer)\b') AS lab FROM (SELECT * FROM raw UNION ALL SELECT doc_id, line_no, v, source FROM sc) x JOIN ln ON x.doc_id = ln.doc_id AND x.line_no = ln.line_no),
  told AS (SELECT DISTINCT doc_id FROM f WHERE source LIKE 'label_block%'),
  pairs AS (SELECT f.doc_id, f.lv, max(CASE WHEN regexp_full_match(p.lv, 'k\d{{4,12}}') AND substr(p.lv, 2) = f.lv THEN 1 ELSE 0 END) AS b1, max(CASE WHEN regexp_full_match(f.lv, 'k\d{{4,8}}') AND regexp_full_match(p.lv, 'k\d{{4,8}}') AND length(p.lv) < length(f.lv) AND starts_with(f.lv, p.lv) THEN 2 ELSE 0 END) AS b2, max(CASE WHEN regexp_full_match(f.lv, '\d{{4}}') AND regexp_full_match(p.lv, '\d{{8,12}}') AND right(p.lv, 4) = f.lv THEN 16 ELSE 0 END) AS b16 FROM f JOIN f p ON f.doc_id = p.doc_id GROUP BY 1, 2)"""


@query("ex_filter_customer", w(SUP, DOCS, BASE, PEERS, LINES, FOUND) + r"""SELECT doc_id, value, source, CAST(b1 + b2 + kvk + CASE WHEN source IN ('ref_slash_customer', 'label_block_next_line') THEN b16 ELSE 0 END + CASE WHEN t AND source = 'ref_slash_customer' THEN 32 ELSE 0 END + CASE WHEN
    length(value) < 2 OR (regexp_full_match(value, '20\d{4,6}') AND regexp_matches(context, concat('(?i)\buw\s+referentie\s*:?\s*', value, '\b'))) OR regexp_matches(context, '(?i)\bpakbon\b') OR regexp_full_match(value, '20\d{2}') OR (NOT lab AND (regexp_full_match(lv, 'k\d{7,8}') OR regexp_full_match(value, '\d{6,}'))) THEN 128 ELSE 0 END AS INT) AS reasons
  FROM (SELECT f.*, b1, b2, b16, f.doc_id IN (SELECT doc_id FROM told) AS t, CASE WHEN regexp_full_match(f.lv, 'k\d{4,8}') AND contains(regexp_replace(lower(lay.text), '[^a-z0-9]', '', 'g'), concat('kvk', substr(f.lv, 2))) THEN 4 ELSE 0 END AS kvk FROM f JOIN pairs ON f.doc_id = pairs.doc_id AND f.lv = pairs.lv JOIN lay ON f.doc_id = lay.doc_id)""")
def ex_filter_customer(spark, sf):
    """Every candidate with the reasons for which it goes, as bits; 0 keeps it."""
    return pr.judged(nb.customers(_peers(spark, sf), tables=False), "found", "text").select("doc_id", "value", "source", "reasons")


FOOT = """lay AS (SELECT doc_id, concat(CASE order_id % 4 WHEN 0 THEN concat('BTW nr. ', vat_number) WHEN 1 THEN concat('BTW: ', vat_number) WHEN 2 THEN vat_number ELSE 'Factuur' END, repeat(concat(chr(10), 'regel'), 20 + CAST(order_id % 3 AS INT) * 30), chr(10), CASE order_id % 5 WHEN 0 THEN concat('BTW: ', vat_number) WHEN 1 THEN concat('IBAN ', n, ' ', vat_number, ' NL123456789B01') WHEN 2 THEN concat('BTW nummer ', vat_number) ELSE 'BTW: NL123456789B01' END) AS text FROM b)"""


def _foot(spark, sf):
    d, o, lit, vat = _documents(spark, sf), F.col("order_id"), F.lit, F.col("vat_number")
    head = F.when(o % 4 == 0, F.concat(lit("BTW nr. "), vat)).when(o % 4 == 1, F.concat(lit("BTW: "), vat)).when(o % 4 == 2, vat).otherwise("Factuur")
    foot = F.when(o % 5 == 0, F.concat(lit("BTW: "), vat)).when(o % 5 == 1, F.concat(lit("IBAN "), "n", lit(" "), vat, lit(" NL123456789B01"))).when(o % 5 == 2, F.concat(lit("BTW nummer "), vat)).otherwise("BTW: NL123456789B01")
    return d.select("doc_id", F.concat(head, F.repeat(lit("\nregel"), (20 + o % 3 * 30).cast("int")), lit("\n"), foot).alias("text"))


@query("ex_filter_vat_footer", w(SUP, DOCS, BASE, FOOT, LINES) + r""", v AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '\b(NL\d{9}B\d{2})\b', 1)) AS value, CASE WHEN regexp_matches(line, '(?i)\bbtw\s*(nr|nummer)\b') THEN 'btw_nr' WHEN regexp_matches(line, '(?i)\bbtw\s*:') THEN 'btw' ELSE 'regex' END AS kind FROM ln),
  sz AS (SELECT doc_id, n, hd, n - least(pt, greatest(1, n - hd)) AS ft FROM (SELECT *, least(pt, greatest(1, (n + 1) // 2)) AS hd FROM (SELECT doc_id, count(*) AS n, greatest(12, (count(*) * 2) // 10) AS pt FROM ln GROUP BY 1))),
  part AS (SELECT v.*, (SELECT count(*) FROM v x WHERE x.doc_id = v.doc_id AND x.value = v.value AND x.line_no < hd) > 0 AS up, (SELECT count(*) FROM v x WHERE x.doc_id = v.doc_id AND x.value = v.value AND x.line_no >= ft) > 0 AS down FROM v JOIN sz ON v.doc_id = sz.doc_id)
  SELECT doc_id, line_no, value, kind FROM part p WHERE NOT (down AND ((kind = 'btw' AND doc_id IN (SELECT doc_id FROM part WHERE up AND kind = 'btw_nr')) OR (kind = 'regex' AND doc_id IN (SELECT doc_id FROM part WHERE up AND kind <> 'regex'))))""")
def ex_filter_vat_footer(spark, sf):
    return pr.drop_footer_vat(pr.vat_candidates(_foot(spark, sf))).select("doc_id", "line_no", "value", "kind")
