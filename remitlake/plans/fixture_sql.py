"""The derived tables of :mod:`remitlake.sources.fixtures` as SQL, for the oracles."""

from __future__ import annotations

SUP = """sup AS (SELECT s_suppkey AS supplier_id, s_name AS supplier_name,
  concat('NL', lpad(CAST(98 - CAST(CAST(concat('11102320', lpad(CAST(s_suppkey AS VARCHAR),10,'0'), '232100') AS DECIMAL(38,0)) % 97 AS INT) AS VARCHAR),2,'0'), 'BANK', lpad(CAST(s_suppkey AS VARCHAR),10,'0')) AS iban,
  concat('K', lpad(CAST(s_suppkey AS VARCHAR),6,'0')) AS customer_code,
  concat('NL', lpad(CAST(s_suppkey AS VARCHAR),9,'0'), 'B01') AS vat_number,
  lpad(CAST(10000000 + s_suppkey AS VARCHAR),8,'0') AS kvk_number,
  concat('sup', CAST(s_suppkey AS VARCHAR), '.example.org') AS email_domain,
  CAST(s_suppkey % 4 AS DECIMAL(5,2)) AS discount_pct, CAST(s_suppkey % 31 AS INT) AS term_days,
  CASE WHEN s_suppkey % 10 = 0 THEN 0 WHEN s_suppkey % 7 = 0 THEN 9 ELSE 21 END AS vat_rate FROM supplier)"""
DOCS = """docs AS (SELECT concat(CASE WHEN l_returnflag='R' THEN 'CN' ELSE 'INV' END, CAST(l_orderkey AS VARCHAR), '-', CAST(l_suppkey AS VARCHAR)) AS doc_id,
  l_suppkey AS supplier_id, l_orderkey AS order_id, CASE WHEN l_returnflag='R' THEN 'credit_note' ELSE 'invoice' END AS doc_type,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount, CAST(MIN(l_shipdate) AS DATE) AS doc_date
  FROM lineitem GROUP BY l_orderkey, l_suppkey, l_returnflag = 'R', CASE WHEN l_returnflag='R' THEN 'CN' ELSE 'INV' END, CASE WHEN l_returnflag='R' THEN 'credit_note' ELSE 'invoice' END)"""
CREDITS = """credits AS (SELECT doc_id AS credit_id, supplier_id, amount, doc_date,
  CASE WHEN order_id % 3 = 0 AND ref_order IS NOT NULL THEN concat('INV', CAST(ref_order AS VARCHAR), '-', CAST(supplier_id AS VARCHAR)) END AS ref_number
  FROM (SELECT *, MIN(CASE WHEN doc_type='invoice' THEN order_id END) OVER (PARTITION BY supplier_id ORDER BY order_id RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ref_order FROM docs) WHERE doc_type='credit_note')"""
ROWS = """rws AS (SELECT d.doc_id, d.supplier_id, d.order_id, d.doc_type, d.amount, d.doc_date, s.discount_pct, s.vat_rate, s.term_days, concat(d.doc_id, '.pdf') AS source_file,
  CASE WHEN d.order_id % 97 = 0 THEN '' ELSE s.supplier_name END AS supplier_name, s.iban AS db_iban,
  CASE WHEN d.order_id % 11 = 0 THEN NULL WHEN d.order_id % 17 = 0 THEN replace(s.iban,'BANK','BANC') ELSE s.iban END AS iban,
  CASE d.order_id % 13 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'unmatched' WHEN 2 THEN 'load_failed' WHEN 3 THEN 'no_hint' WHEN 4 THEN 'new' WHEN 5 THEN 'reviewed' ELSE 'confirmed' END AS match_status,
  CASE d.order_id % 7 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'failed' WHEN 2 THEN 'tentative' ELSE 'confirmed' END AS amount_status,
  CAST(d.order_id % 4 AS INT) AS n_candidates, d.order_id % 2 = 0 AS term_trusted, CASE WHEN d.order_id % 19 = 0 THEN NULL ELSE d.doc_date END AS invoice_date,
  CASE d.order_id % 5 WHEN 0 THEN 'no_text' WHEN 1 THEN 'read_failed' END AS load_error, s.customer_code, s.vat_number, s.kvk_number, s.email_domain
  FROM docs d JOIN sup s ON d.supplier_id = s.supplier_id)"""
TEXTS = """texts AS (SELECT d.doc_id, d.supplier_id, d.order_id, d.doc_type, d.amount, d.doc_date, concat_ws(chr(10), concat('Factuurnummer: ', d.doc_id), concat('Factuurdatum: ', strftime(d.doc_date, '%d-%m-%Y')),
  concat('Klantnummer: ', s.customer_code), concat('Totaal te betalen EUR ', replace(CAST(d.amount AS VARCHAR),'.',',')), concat('IBAN ', s.iban), concat('BTW nr ', s.vat_number), concat('KvK ', s.kvk_number), concat('E-mail info@', s.email_domain)) AS text
  FROM docs d JOIN sup s ON d.supplier_id = s.supplier_id)"""
ATTEMPTS = """attempts AS (SELECT user_id AS doc_id, event_type AS field_id, event_id AS attempt_id, concat('s', CAST(event_id % 6 AS VARCHAR)) AS strategy,
  CASE event_id % 3 WHEN 0 THEN 'valid' WHEN 1 THEN 'invalid' ELSE 'skipped' END AS status, CAST((event_id * 37) % 101 AS INT) AS confidence_pct FROM events)"""

# Half-up division by 1 + VAT rate and half-even discount, in integer cents (c, r, pct).
EXCL_CENTS = "((2*c*100 + (100+r)) // (2*(100+r)))"
DISCOUNT_CENTS = "((x*pct)//100 + CASE WHEN (x*pct)%100 > 50 OR ((x*pct)%100 = 50 AND ((x*pct)//100)%2 = 1) THEN 1 ELSE 0 END)"


def w(*parts: str) -> str:
    """WITH clause of the parts."""
    return "WITH " + ", ".join(parts) + " "


def money(cents: str) -> str:
    """Exact amount of integer cents."""
    return f"CAST(CAST({cents} AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2))"
