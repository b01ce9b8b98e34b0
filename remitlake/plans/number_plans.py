"""Invoice and customer numbers read from texts of twelve layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import numbers as nb
from ..sources import fixtures as fx
from .book import query
from .fixture_sql import DOCS, SUP, w


def _layouts(spark, sf):
    d = fx.documents(spark, sf).join(fx.suppliers(spark, sf).select("supplier_id", "supplier_name", "customer_code"), "supplier_id")
    k, n = F.col("order_id") % 12, F.lpad(F.col("order_id").cast("string"), 6, "0")
    day, lit = F.date_format("doc_date", "dd-MM-yyyy"), F.lit
    spaced = F.regexp_replace(F.concat(lit("k"), n), "(.)", "$1 ")
    body = (
        F.when(k == 0, F.concat(lit("Klantnummer "), "customer_code"))
        .when(k == 1, F.concat(lit("Klantcode\n\n"), "customer_code", lit(" vast\nFactuurnummer: "), "doc_id"))
        .when(k == 2, F.concat(lit("Debiteurnummer 12345/"), n, lit("\nFactuurnr: 2024")))
        .when(k == 3, F.concat(lit("Uw Klant: K"), n))
        .when(k == 4, F.concat(lit("Geleverd aan "), spaced))
        .when(k == 5, F.concat(lit("Factuurdatum Factuurnummer Klantnummer\n"), day, lit(" "), "doc_id", lit(" 00"), n))
        .when(k == 6, F.concat(lit("Factuurnummer Betaler\n\n"), "doc_id", lit(" 00"), n))
        .when(k == 7, F.concat(lit("Creditnota VCR "), n, lit("+")))
        .when(k == 8, F.concat(lit("Creditnota\nCN "), n, lit("\nRef "), n, lit(" / 4455")))
        .when(k == 9, F.concat(lit("Creditnota van de maand\nCreditnummer: CN"), n, lit("\nBetr. onze factuur\nFactuurnummer: INV"), n))
        .when(k == 10, F.concat(lit("Klantnr.\n2026"), n))
        .otherwise(F.concat(lit("Verkoopcredit volgens afspraak\nNummer: VC"), n, lit("\nFact.nr. Factuurnummer: VF"), n))
    )
    return d.select("doc_id", "supplier_id", "customer_code", F.concat_ws("\n", F.concat(lit("Leverancier "), "supplier_name"), body, lit("Totaal 10,00")).alias("text"))


LAYOUTS = """lay AS (SELECT d.doc_id, d.supplier_id, s.customer_code, concat_ws(chr(10), concat('Leverancier ', s.supplier_name), CASE d.order_id % 12 WHEN 0 THEN concat('Klantnummer ', s.customer_code) WHEN 1 THEN concat('Klantcode', chr(10), chr(10), s.customer_code, ' vast', chr(10), 'Factuurnummer: ', d.doc_id)
  WHEN 2 THEN concat('Debiteurnummer 12345/', n, chr(10), 'Factuurnr: 2024') WHEN 3 THEN concat('Uw Klant: K', n) WHEN 4 THEN concat('Geleverd aan ', regexp_replace(concat('k', n), '(.)', '\\1 ', 'g')) WHEN 5 THEN concat('Factuurdatum Factuurnummer Klantnummer', chr(10), strftime(d.doc_date, '%d-%m-%Y'), ' ', d.doc_id, ' 00', n)
  WHEN 6 THEN concat('Factuurnummer Betaler', chr(10), chr(10), d.doc_id, ' 00', n) WHEN 7 THEN concat('Creditnota VCR ', n, '+') WHEN 8 THEN concat('Creditnota', chr(10), 'CN ', n, chr(10), 'Ref ', n, ' / 4455') WHEN 9 THEN concat('Creditnota van de maand', chr(10), 'Creditnummer: CN', n, chr(10), 'Betr. onze factuur', chr(10), 'Factuurnummer: INV', n)
  WHEN 10 THEN concat('Klantnr.', chr(10), '2026', n) ELSE concat('Verkoopcredit volgens afspraak', chr(10), 'Nummer: VC', n, chr(10), 'Fact.nr. Factuurnummer: VF', n) END, 'Totaal 10,00') AS text
  FROM (SELECT *, lpad(CAST(order_id AS VARCHAR), 6, '0') AS n FROM docs) d JOIN sup s ON d.supplier_id = s.supplier_id)"""
# Lines with the line number from 0; what follows is read from the text itself.
LINES = "ln AS (SELECT doc_id, text, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS line_no, unnest(string_split(text, chr(10))) AS line FROM lay), nx AS (SELECT *, lead(line, 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS n1, lead(line, 2) OVER (PARTITION BY doc_id ORDER BY line_no) AS n2, lead(line, 3) OVER (PARTITION BY doc_id ORDER BY line_no) AS n3, lead(line, 4) OVER (PARTITION BY doc_id ORDER BY line_no) AS n4 FROM ln)"
BASE = w(SUP, DOCS, LAYOUTS, LINES)
KCODE = "CASE WHEN regexp_full_match(regexp_replace({0}, '\\s', '', 'g'), '(?i)k\\d{{4,12}}') THEN concat('K', substr(regexp_replace({0}, '\\s', '', 'g'), 2)) ELSE {0} END"
LABELS = r"""lab AS (SELECT *, regexp_extract(line, '(?i)\b(?:klantnummer|klantcode|klantnr\.?|debiteurnummer|debiteurnr\.?|relatienummer|uw\s+klant|customer\s+number)(.*)$', 1) AS rest FROM nx WHERE regexp_matches(line, '(?i)\b(?:klantnummer|klantcode|klantnr|debiteurnummer|debiteurnr|relatienummer|uw\s+klant|customer\s+number)')),
  lab2 AS (SELECT *, CASE WHEN regexp_matches(rest, '^\W*\d{4,}\s*/\s*\d{3,}') THEN [regexp_replace(regexp_extract(rest, '(\d{4,}\s*/\s*\d{3,})', 1), '\s', '', 'g')] ELSE list_filter(regexp_extract_all(rest, '[A-Za-z0-9][A-Za-z0-9./-]{3,}'), lambda x: regexp_matches(x, '\d') AND NOT regexp_full_match(x, '\d{2}-\d{2}-\d{4}|\d{4}-\d{2}-\d{2}')) END AS same,
    list_filter([{'v': list_filter(regexp_extract_all(n1, '[A-Za-z0-9][A-Za-z0-9./-]{3,}'), lambda x: regexp_matches(x, '\d') AND NOT regexp_full_match(x, '\d{2}-\d{2}-\d{4}|\d{4}-\d{2}-\d{2}'))[1], 'j': 1}, {'v': list_filter(regexp_extract_all(n2, '[A-Za-z0-9][A-Za-z0-9./-]{3,}'), lambda x: regexp_matches(x, '\d') AND NOT regexp_full_match(x, '\d{2}-\d{2}-\d{4}|\d{4}-\d{2}-\d{2}'))[1], 'j': 2}, {'v': list_filter(regexp_extract_all(n3, '[A-Za-z0-9][A-Za-z0-9./-]{3,}'), lambda x: regexp_matches(x, '\d') AND NOT regexp_full_match(x, '\d{2}-\d{2}-\d{4}|\d{4}-\d{2}-\d{2}'))[1], 'j': 3}], lambda s: s.v IS NOT NULL)[1] AS below FROM lab),
  labs AS (SELECT doc_id, line_no, """ + KCODE.format("v") + r""" AS value, source, CAST(confidence AS INT) AS confidence FROM (SELECT doc_id, line_no, unnest(same) AS v, 'label_block_same_line' AS source, greatest(70, 95 - generate_subscripts(same, 1)) AS confidence FROM lab2 WHERE len(same) > 0
    UNION ALL SELECT doc_id, line_no, below.v, 'label_block_next_line', CASE WHEN regexp_matches(below.v, '^20(2[5-9]|[3-9]\d)\d{4,}$') THEN greatest(40, 63 - below.j) ELSE 93 - below.j END FROM lab2 WHERE len(same) = 0 AND below IS NOT NULL))"""
SCANS = r"""scan AS (SELECT doc_id, value, max(confidence) AS confidence, max_by(source, confidence) AS source FROM (SELECT doc_id, regexp_replace(""" + KCODE.format("v") + r""", '\s', '', 'g') AS value, source, confidence FROM (
  SELECT doc_id, unnest(regexp_extract_all(line, '(?i)\buw\s+(?:klant\s*:?\s*)?(k\d{3,12})\b', 1)) AS v, 'uw_klant_k_prefix' AS source, 90 AS confidence FROM ln UNION ALL SELECT doc_id, unnest(regexp_extract_all(line, '(?i)\bklant[^\n]{0,48}\s*:?\s*(k\d{3,12})\b', 1)), 'klant_line_k_prefix', 88 FROM ln
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(line, '(?i)(?:^|[^a-z])(k\d{4,12})(?:$|\D)', 1)), 'standalone_k_token', 86 FROM ln UNION ALL SELECT doc_id, unnest(regexp_extract_all(line, '(?i)(?:^|[^a-z])(k(?:\s\d){4,12})(?:$|\D)', 1)), 'spaced_k_token', 85 FROM ln
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(line, '\b(\d{4,}\s*/\s*\d{4,})\b', 1)), 'ref_slash_customer', 76 FROM ln)) GROUP BY 1, 2)"""
CREDIT = r"""hint AS (SELECT DISTINCT doc_id FROM ln WHERE regexp_matches(line, '(?i)\b(creditnota|credit\s*note|verkoopcredit|creditfactuur)\b')), cn AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(v, '\s', '', 'g'), '\++$', '') AS value, source, confidence, rule FROM (
  SELECT doc_id, line_no, unnest(regexp_extract_all(line, '(?i)\b(?:creditnota|verkoopcreditnota|credit\s*note)\s*[:.]?\s*((?:VCR|VCN|VC|CN|CREN|CR|HA|SCM|SI)\s*[\dA-Z+./-]+)', 1)) AS v, 'credit_note_title' AS source, 92 AS confidence, 0 AS rule FROM nx UNION ALL
  SELECT doc_id, line_no, unnest(regexp_extract_all(line, '(?i)\b(?:credit(?:nota)?(?:nummer|nr\.?)|creditnummer)\s*[:.]?\s*((?:CN|VC|VCN|SCM|VCR)[\dA-Z+/-]+)', 1)), 'credit_document_number', 94, 1 FROM nx UNION ALL
  SELECT doc_id, line_no, unnest(regexp_extract_all(line, '(?i)\b(?:nummer|number|nr\.?)\s*[:.]?\s*((?:CN|VC|VCN|SCM|VCR)[\dA-Z+/-]+)', 1)), 'credit_document_number', 93, 2 FROM nx UNION ALL
  SELECT doc_id, line_no, regexp_extract(n1, '(?i)^\s*((?:VCR|VCN|VC|CN|CREN|CR|HA|SCM|SI)\s*[\dA-Z+./-]+)', 1), 'credit_note_next_line', 91, 3 FROM nx WHERE regexp_full_match(line, '(?i)\s*(creditnota|verkoopcreditnota|credit\s*note)\s*') AND regexp_matches(n1, '(?i)^\s*(VCR|VCN|VC|CN|CREN|CR|HA|SCM|SI)\s*[\dA-Z+./-]+'))),
  crd AS (SELECT doc_id, line_no, value, source, CAST(confidence AS INT) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, upper(value) ORDER BY rule, line_no) AS k FROM cn WHERE doc_id IN (SELECT doc_id FROM hint)) WHERE k = 1)"""
HEAD = r"""hd AS (SELECT *, list_filter(list_transform(string_split_regex(trim(line), '\s+'), lambda x: CASE WHEN regexp_full_match(x, '(?i)factuurdatum|facturatiedatum|verzenddatum|vervaldatum|leverdatum|datum') THEN 'date' WHEN regexp_full_match(x, '(?i)factuurnummer|factuurnr\.?') THEN 'invoice' WHEN regexp_full_match(x, '(?i)debiteurennummer|debiteurnummer|debiteurnr\.?|klantnummer|klantnr\.?|relatienummer|betaler') THEN 'customer' END), lambda x: x IS NOT NULL) AS heads FROM nx),
  hv AS (SELECT doc_id, line_no, heads, list_filter([{'v': list_filter(string_split_regex(trim(n1), '\s+'), lambda x: length(x) >= 4 AND regexp_matches(x, '\d') AND NOT regexp_full_match(x, '\d{2}-\d{2}-\d{4}|\d{4}-\d{2}-\d{2}')), 'j': 1}, {'v': list_filter(string_split_regex(trim(n2), '\s+'), lambda x: length(x) >= 4 AND regexp_matches(x, '\d') AND NOT regexp_full_match(x, '\d{2}-\d{2}-\d{4}|\d{4}-\d{2}-\d{2}')), 'j': 2}], lambda s: len(s.v) > 0)[1] AS r FROM hd WHERE len(heads) >= 2),
  tab AS (SELECT doc_id, line_no, r.v[p - len(list_filter(heads[1:p - 1], lambda x: x = 'date'))] AS value, concat('header_table_', kind) AS source, CAST(base - r.j AS INT) AS confidence FROM (SELECT hv.*, kind, base, list_position(heads, kind) AS p FROM hv, (VALUES ('invoice', 90), ('customer', 89)) t(kind, base)) WHERE p > 0 AND r IS NOT NULL)"""
INVLAB = r"inl AS (SELECT doc_id, line_no, regexp_extract(line, '(?i)\b(?:factuurnummer|factuurnr\.?|invoice\s*(?:no\.?|number))\s*[:\s]\s*([A-Za-z0-9][A-Za-z0-9./-]{2,})\s*$', 1) AS value, 'label_same_line' AS source, CAST(90 AS INT) AS confidence FROM ln WHERE regexp_matches(line, '(?i)\b(?:factuurnummer|factuurnr\.?|invoice\s*(?:no\.?|number))\s*[:\s]\s*([A-Za-z0-9./-]*\d[A-Za-z0-9./-]*)\s*$'))"
INVALL = "alli AS (SELECT * FROM crd UNION ALL SELECT * FROM tab WHERE source = 'header_table_invoice' UNION ALL SELECT * FROM inl)"
GOOD = r"good AS (SELECT * FROM alli WHERE NOT regexp_full_match(upper(regexp_replace(value, '[\s.]', '', 'g')), '20\d{2}|(NL)?\d{9,12}B\d{2}|NL\d{2}[A-Z]{4}\d{10,20}|[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?'))"
KEPT = r"kept AS (SELECT g.* FROM good g LEFT JOIN (SELECT doc_id, bool_or(source LIKE 'credit%' OR regexp_matches(value, '(?i)^(VCR|VCN|VC|CN|CREN|CR|HA|SCM|SI|C\d)')) AS own FROM good GROUP BY 1) o ON g.doc_id = o.doc_id JOIN ln ON g.doc_id = ln.doc_id AND g.line_no = ln.line_no WHERE NOT (g.doc_id IN (SELECT doc_id FROM hint) AND own AND g.source NOT LIKE 'credit%' AND regexp_matches(ln.line, '(?i)\b(factuurnr\.?|factuurnummer|fact\.?\s*nr\.?|vereffening\s+met\s+factuurnr|betr\.?:?\s*(onze\s+)?factuur|onze\s+factuur)')))"
COLS = ("doc_id", "value", "source", "confidence")
INV = w(SUP, DOCS, LAYOUTS, LINES, CREDIT, HEAD, INVLAB, INVALL, GOOD, KEPT)
CUS = w(SUP, DOCS, LAYOUTS, LINES, LABELS, SCANS, HEAD)
CUSALL = "cus AS (SELECT doc_id, value, source, confidence FROM labs UNION ALL SELECT doc_id, value, source, CAST(confidence AS INT) FROM scan UNION ALL SELECT doc_id, value, source, confidence FROM tab WHERE source = 'header_table_customer')"
CUSW = w(SUP, DOCS, LAYOUTS, LINES, LABELS, SCANS, HEAD, CUSALL)


def _lines(spark, sf):
    return nb.lines(_layouts(spark, sf))


def _invoice(line_table):
    table = nb.header_tables(line_table).where("source = 'header_table_invoice'")
    return nb.credit_numbers(line_table).unionByName(table).unionByName(nb.invoice_labels(line_table))


def _customer(line_table):
    table = nb.header_tables(line_table).where("source = 'header_table_customer'")
    return nb.customer_labels(line_table).unionByName(nb.customer_scans(line_table)).unionByName(table)


def _kept(line_table):
    return nb.invoice_numbers(line_table)


@query("ex_customer_labels", CUS + "SELECT doc_id, value, source, confidence FROM labs")
def ex_customer_labels(spark, sf):
    return nb.customer_labels(_lines(spark, sf)).select(*COLS)


@query("ex_customer_fallback", CUS + "SELECT doc_id, value, source, CAST(confidence AS INT) AS confidence FROM scan")
def ex_customer_fallback(spark, sf):
    return nb.customer_scans(_lines(spark, sf)).select(*COLS)


@query("ex_credit_number", INV + "SELECT doc_id, value, source, confidence FROM crd")
def ex_credit_number(spark, sf):
    return nb.credit_numbers(_lines(spark, sf)).select(*COLS)


@query("ex_header_table", INV + "SELECT doc_id, value, source, confidence FROM tab")
def ex_header_table(spark, sf):
    return nb.header_tables(_lines(spark, sf)).select(*COLS)


# What several parts read is made once.
INVM = INV.replace("ln AS (", "ln AS MATERIALIZED (", 1).replace("alli AS (", "alli AS MATERIALIZED (", 1)


@query("ex_filter_ident", INVM + "SELECT doc_id, value, source FROM good")
def ex_filter_ident(spark, sf):
    return _invoice(_lines(spark, sf)).where(nb.plausible_number(F.col("value"))).select("doc_id", "value", "source")


@query("ex_filter_credit_parent", INV + "SELECT doc_id, value, source FROM kept")
def ex_filter_credit_parent(spark, sf):
    return _kept(_lines(spark, sf)).select("doc_id", "value", "source")


@query("ex_number_ladder", INV + "SELECT doc_id, value, source FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['credit_document_number', 'credit_note_title', 'credit_note_next_line', 'header_table_invoice', 'label_same_line'], source), line_no) AS k FROM kept) WHERE k = 1")
def ex_number_ladder(spark, sf):
    return nb.ladder(_kept(_lines(spark, sf)))


@query("ex_customer_ladder", CUSW + "SELECT doc_id, value, source FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['header_table_customer', 'label_block_same_line', 'label_block_next_line', 'uw_klant_k_prefix', 'spaced_k_token', 'ref_slash_customer'], source), value) AS k FROM cus WHERE source NOT IN ('standalone_k_token', 'klant_line_k_prefix')) WHERE k = 1")
def ex_customer_ladder(spark, sf):
    order = ("header_table_customer", "label_block_same_line", "label_block_next_line", "uw_klant_k_prefix", "spaced_k_token", "ref_slash_customer")
    return nb.ladder(_customer(_lines(spark, sf)), order)


@query("ex_ident_result", INV + "SELECT l.doc_id, k.value, coalesce(k.source, 'NOT_FOUND') AS source, coalesce(k.confidence, 0) AS confidence, CASE WHEN k.value IS NULL THEN 'failed' WHEN k.confidence >= 80 THEN 'confirmed' ELSE 'tentative' END AS status FROM lay l LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, line_no, value DESC) AS n FROM kept) k ON l.doc_id = k.doc_id AND k.n = 1")
def ex_ident_result(spark, sf):
    texts = _layouts(spark, sf)
    return nb.result(texts, _kept(nb.lines(texts)))


@query("sp_missing", INV + "SELECT doc_id, 'invoice_number' AS field_id, 'NOT_FOUND' AS source, CAST(0 AS INT) AS confidence FROM lay WHERE doc_id NOT IN (SELECT doc_id FROM kept)")
def sp_missing(spark, sf):
    texts = _layouts(spark, sf)
    return nb.result(texts, _kept(nb.lines(texts))).where("status = 'failed'").select("doc_id", F.lit("invoice_number").alias("field_id"), "source", "confidence")


@query("sp_match_type", INVM + "SELECT doc_id, value, CASE WHEN source IN ('label_same_line', 'header_table_invoice') THEN 'label' ELSE 'regex' END AS match_type FROM alli")
def sp_match_type(spark, sf):
    return _invoice(_lines(spark, sf)).select("doc_id", "value", nb.match_type(F.col("source")).alias("match_type"))


@query("set_merge_resolved", CUSW + "SELECT doc_id, value, source, confidence FROM cus UNION ALL SELECT doc_id, v, 'resolved', CAST(CASE WHEN v LIKE '%/%' THEN 96 ELSE 70 END AS INT) FROM (SELECT doc_id, CASE WHEN supplier_id % 3 = 0 THEN concat(lower(customer_code), '/1') WHEN supplier_id % 3 = 1 THEN lower(customer_code) END AS v FROM lay) WHERE v IS NOT NULL AND (doc_id, v) NOT IN (SELECT doc_id, lower(value) FROM cus)")
def set_merge_resolved(spark, sf):
    texts = _layouts(spark, sf)
    s = F.col("supplier_id") % 3
    hint = F.when(s == 0, F.concat(F.lower("customer_code"), F.lit("/1"))).when(s == 1, F.lower("customer_code"))
    return nb.customers(texts).select("doc_id", F.inline(nb.resolved(hint, F.col("found"))))


@query("jn_db_override", CUSW + "SELECT doc_id, value, source, confidence FROM cus UNION ALL SELECT l.doc_id, l.customer_code, 'db_master', CAST(greatest(88, coalesce(max(c.confidence), 0)) AS INT) FROM lay l LEFT JOIN cus c ON l.doc_id = c.doc_id AND l.customer_code = c.value AND c.source IN ('label_block_same_line', 'label_same_line', 'ref_slash_customer', 'header_table_customer') GROUP BY l.doc_id, l.customer_code")
def jn_db_override(spark, sf):
    texts = _layouts(spark, sf)
    return nb.customers(texts).select("doc_id", F.inline(nb.mastered(F.col("customer_code"), F.col("found"))))


def _more(spark, sf):
    """Texts with numbers beside other cells, after dates, in two parts, or none."""
    d = fx.documents(spark, sf)
    k, n, lit = F.col("order_id") % 10, F.lpad(F.col("order_id").cast("string"), 6, "0"), F.lit
    day, dash = F.date_format("doc_date", "dd/MM/yyyy"), F.date_format("doc_date", "dd-MM-yyyy")
    text = (
        F.when(k == 0, F.concat(lit("Datum Nummer Bedrag\n"), day, lit(" F"), n, lit(" 10,00"))).when(k == 1, F.concat(lit("Datum Nummer\n\n"), day, lit(" 2024 x\n"), day, lit(" G-"), n, lit(" x"))).when(k == 2, F.concat(day, lit(" F"), n, lit(" iets\nVervaldatum "), dash))
        .when(k == 3, F.concat(lit("FACTUUR F"), n, lit(" Pagina 1\nCustomer 12"), n)).when(k == 4, F.concat(lit("Nummer INV-"), n, lit("\nRef | K"), n)).when(k == 5, F.concat(lit("INVOICE F"), n, lit(" due 30 days\n30 Tage bis "), F.date_add("doc_date", 1).cast("string")))
        .when(k == 6, F.concat(lit("Nummer REG"), n)).when(k == 7, F.concat(lit("  REG"), n, lit(" rest\nVervalt "), F.col("doc_date").cast("string"))).when(k == 8, F.concat(lit("Vorgangsnummer: 668\nBelegnummer 2025-"), n, lit("\nBelegnummer 2026-1111"))).otherwise(F.concat(lit("Belegnummer 2025-"), n))
    )
    return d.select("doc_id", "order_id", "doc_date", "amount", text.alias("text"))


MORE = """mo AS (SELECT doc_id, order_id, doc_date, amount, CASE order_id % 10 WHEN 0 THEN concat('Datum Nummer Bedrag', chr(10), dd, ' F', n, ' 10,00') WHEN 1 THEN concat('Datum Nummer', chr(10), chr(10), dd, ' 2024 x', chr(10), dd, ' G-', n, ' x') WHEN 2 THEN concat(dd, ' F', n, ' iets', chr(10), 'Vervaldatum ', strftime(doc_date, '%d-%m-%Y'))
  WHEN 3 THEN concat('FACTUUR F', n, ' Pagina 1', chr(10), 'Customer 12', n) WHEN 4 THEN concat('Nummer INV-', n, chr(10), 'Ref | K', n) WHEN 5 THEN concat('INVOICE F', n, ' due 30 days', chr(10), '30 Tage bis ', CAST(CAST(doc_date + 1 AS DATE) AS VARCHAR)) WHEN 6 THEN concat('Nummer REG', n) WHEN 7 THEN concat('  REG', n, ' rest', chr(10), 'Vervalt ', CAST(doc_date AS VARCHAR))
  WHEN 8 THEN concat('Vorgangsnummer: 668', chr(10), 'Belegnummer 2025-', n, chr(10), 'Belegnummer 2026-1111') ELSE concat('Belegnummer 2025-', n) END AS text FROM (SELECT *, lpad(CAST(order_id AS VARCHAR), 6, '0') AS n, strftime(doc_date, '%d/%m/%Y') AS dd FROM docs))"""
M = w(DOCS, MORE)


@query("ex_invoice_layouts", M + r"""SELECT doc_id, unnest(regexp_extract_all(text, p, 1)) AS value, source, CAST(c AS INT) AS confidence FROM mo, (VALUES ('factuur_inline_pagina', 86, '(?i)\bFactuur\s+([A-Za-z0-9][A-Za-z0-9/-]{4,})\s+Pagina\b'), ('reg_invoice_row', 86, '(?im)^\s*(REG[A-Z0-9][A-Z0-9/-]*\d+)\b'), ('nummer_inv', 88, '(?i)\bNummer\s+(INV-[A-Za-z0-9-]+)\b'), ('nummer_reg', 88, '(?i)\bNummer\s+(REG[A-Z0-9][A-Z0-9/-]*\d+)\b'), ('invoice_only_line', 87, '(?i)\bINVOICE\s+([A-Za-z0-9][A-Za-z0-9/-]+)')) v(source, c, p)""")
def ex_invoice_layouts(spark, sf):
    return nb.invoice_layouts(nb.lines(_more(spark, sf))).select(*COLS)


@query("ex_customer_layouts", M + r"SELECT doc_id, value, source, CAST(c AS INT) AS confidence FROM (SELECT doc_id, regexp_extract(text, '(?m)^Customer (\d{4,12})\b', 1) AS value, 'customer_standalone_line' AS source, 87 AS c FROM mo UNION ALL SELECT doc_id, regexp_extract(text, '\| (K\d{4,8})\b', 1), 'pipe_suffix_customer', 85 FROM mo) WHERE value <> ''")
def ex_customer_layouts(spark, sf):
    return nb.customer_layouts(nb.lines(_more(spark, sf))).select(*COLS)


@query("ex_date_number_table", M + r"""SELECT doc_id, value, source, CAST(confidence AS INT) AS confidence FROM (SELECT doc_id, regexp_extract(text, '\d{2}/\d{2}/\d{4} ([FG][0-9-]+) ', 1) AS value, unnest(CASE WHEN text LIKE 'Datum%' THEN ['datum_nummer_table', 'date_invoice_line'] ELSE ['date_invoice_line'] END) AS source,
  unnest(CASE WHEN text LIKE 'Datum%' THEN [CASE WHEN order_id % 10 = 0 THEN 85 ELSE 81 END, 79] ELSE [79] END) AS confidence FROM mo WHERE regexp_matches(text, '\d{2}/\d{2}/\d{4} [FG]'))""")
def ex_date_number_table(spark, sf):
    return nb.dated_numbers(nb.lines(_more(spark, sf))).select(*COLS)


@query("ex_two_part_number", M + r"SELECT doc_id, concat(regexp_extract(text, 'Vorgangsnummer: (\d+)', 1), ' ', regexp_extract(text, 'Belegnummer (\S+)', 1)) AS value FROM mo WHERE text LIKE '%Vorgangsnummer%'")
def ex_two_part_number(spark, sf):
    return nb.two_part_numbers(nb.lines(_more(spark, sf)))


@query("ex_date_suspicious", M + "SELECT doc_id FROM mo WHERE order_id % 10 IN (2, 7)")
def ex_date_suspicious(spark, sf):
    """Dates on a line about the due date; such a line with another date is no reason."""
    t = _more(spark, sf)
    return nb.suspicious_dates(nb.lines(t), t.select("doc_id", F.col("doc_date").alias("invoice_date")))


STATES = "CASE order_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'tentative' ELSE 'confirmed' END"


def _results(spark, sf, shift: int):
    k = (F.col("order_id") + shift) % 4 if shift == 0 else (F.col("order_id") / 4 + shift).cast("long") % 4
    status = F.when(k == 0, "failed").when(k == 1, "ambiguous").when(k == 2, "tentative").otherwise("confirmed")
    return fx.documents(spark, sf).select("doc_id", F.when(status != "failed", F.col("amount") + shift).cast("decimal(18,2)").alias("value"), status.alias("status"))


@query("ex_amount_secondary", w(DOCS) + "SELECT doc_id, CASE WHEN taken THEN CAST(amount + 1 AS DECIMAL(18,2)) WHEN s <> 'failed' THEN amount END AS value, CASE WHEN taken THEN t ELSE s END AS status, CASE WHEN taken THEN 'secondary' ELSE 'primary' END AS source FROM (SELECT *, s = 'failed' AND t IN ('tentative', 'confirmed') AS taken FROM (SELECT *, " + STATES + " AS s, CASE (order_id // 4 + 1) % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'tentative' ELSE 'confirmed' END AS t FROM docs))")
def ex_amount_secondary(spark, sf):
    return nb.secondary(_results(spark, sf, 0), _results(spark, sf, 1))


@query("ex_amount_legacy", w(DOCS) + "SELECT doc_id, CASE WHEN s IN ('confirmed', 'tentative') THEN amount END AS amount, CASE s WHEN 'confirmed' THEN 'high' WHEN 'tentative' THEN 'medium' WHEN 'ambiguous' THEN 'ambiguous' ELSE 'missing' END AS confidence FROM (SELECT *, " + STATES + " AS s FROM docs)")
def ex_amount_legacy(spark, sf):
    r = _results(spark, sf, 0)
    return r.select("doc_id", F.when(F.col("status").isin("confirmed", "tentative"), F.col("value")).alias("amount"), nb.legacy_confidence(F.col("status")).alias("confidence"))
