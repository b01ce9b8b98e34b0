"""Scans, projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, identifiers, money
from ..operators import decisions
from ..sources import fixtures as fx
from .book import query
from .fixture_sql import DISCOUNT_CENTS, DOCS, EXCL_CENTS, ROWS, SUP, TEXTS, money as m, w

S = "DATE '1997-01-01'"


def _session():
    return F.to_date(F.lit("1997-01-01"))


@query("src_documents", w(SUP, DOCS, TEXTS) + "SELECT doc_id, length(text) AS n_chars, len(string_split(text, chr(10))) AS n_lines FROM texts")
def src_documents(spark, sf):
    return fx.texts(spark, sf).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


@query("src_load_error", "SELECT doc_id, CASE WHEN text IS NULL THEN 'read_failed' WHEN trim(text) = '' THEN 'no_text' ELSE 'ok' END AS load_state FROM (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE text END AS text FROM documents)")
def src_load_error(spark, sf):
    text = F.when(F.col("doc_id") % 9 == 0, F.lit(None)).when(F.col("doc_id") % 9 == 1, F.lit("  ")).otherwise(F.col("text"))
    return fx.table(spark, sf, "documents").select("doc_id", F.when(text.isNull(), "read_failed").when(F.trim(text) == "", "no_text").otherwise("ok").alias("load_state"))


@query("src_suppliers", w(SUP) + "SELECT supplier_id, supplier_name, iban, customer_code, vat_number, kvk_number, email_domain, discount_pct, term_days, CAST(vat_rate AS INT) AS vat_rate FROM sup")
def src_suppliers(spark, sf):
    return fx.suppliers(spark, sf)


@query("src_history", "SELECT o_orderkey AS file_no, CAST(o_orderdate AS DATE) AS export_date, l_linenumber AS line_no, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def src_history(spark, sf):
    """Exported files with their payment lines nested, exploded again."""
    line = fx.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("line_no"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))).alias("payments"))
    files = fx.table(spark, sf, "orders").where("o_orderstatus = 'F'").join(line, F.col("o_orderkey") == F.col("l_orderkey"))
    return files.select(F.col("o_orderkey").alias("file_no"), F.col("o_orderdate").cast("date").alias("export_date"), F.inline("payments"))


@query("flt_accept", w(SUP, DOCS, ROWS) + """SELECT doc_id, CASE WHEN match_status='load_failed' THEN CASE WHEN load_error='no_text' THEN 'pdf_no_text' ELSE 'pdf_read_failed' END
  WHEN match_status IN ('matched','new','confirmed','reviewed') THEN 'accepted' WHEN match_status='no_hint' THEN 'no_supplier_hint' WHEN match_status='needs_review' THEN 'needs_review' ELSE 'unmatched_supplier' END AS reason FROM rws""")
def flt_accept(spark, sf):
    return fx.rows(spark, sf).select("doc_id", F.coalesce(decisions.reject_reason(), F.lit("accepted")).alias("reason"))


@query("flt_missing_name", w(SUP, DOCS, ROWS) + "SELECT doc_id, supplier_id FROM rws WHERE match_status IN ('matched','new','confirmed','reviewed') AND trim(coalesce(supplier_name,'')) = ''")
def flt_missing_name(spark, sf):
    return decisions.accept(fx.rows(spark, sf)).where("reject_reason = 'missing_supplier_name'").select("doc_id", "supplier_id")


@query("prj_review_detail", w(SUP, DOCS, ROWS) + """SELECT doc_id, concat('core_matches=', CASE WHEN order_id%2=0 THEN 'iban,kvk' ELSE 'vat' END,
  CASE WHEN order_id%3<>0 OR order_id%5<>0 THEN concat(';missing=', concat_ws(',', CASE WHEN order_id%3<>0 THEN 'IBAN' END, CASE WHEN order_id%5<>0 THEN 'customer_code' END)) ELSE '' END,
  CASE WHEN iban IS NULL THEN ';ocr=ocr_iban_no_result' ELSE '' END) AS reason_detail FROM rws WHERE match_status = 'needs_review'""")
def prj_review_detail(spark, sf):
    o = F.col("order_id")
    core = F.when(o % 2 == 0, F.array(F.lit("iban"), F.lit("kvk"))).otherwise(F.array(F.lit("vat")))
    ocr = F.array_compact(F.array(F.when(F.col("iban").isNull(), "ocr_iban_no_result")))
    return fx.rows(spark, sf).where("match_status = 'needs_review'").select("doc_id", decisions.review_detail(core, o % 3 == 0, o % 5 == 0, F.lit(True), ocr).alias("reason_detail"))


@query("prj_normalize_engine", """SELECT o_orderkey AS order_id, CASE WHEN t IS NULL THEN 'missing_amount' WHEN TRY_CAST(replace(trim(t),',','.') AS DECIMAL(24,6)) IS NULL THEN 'amount_invalid_format' ELSE 'ok' END AS reason,
  CAST(round(TRY_CAST(replace(trim(t),',','.') AS DECIMAL(24,6)),2) AS DECIMAL(18,2)) AS amount_dec FROM (SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN '' WHEN 3 THEN concat(' ', replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR),'.',',')) ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS t FROM orders)""")
def prj_normalize_engine(spark, sf):
    o, p = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    t = F.when(o % 10 == 0, F.lit(None)).when(o % 10 == 1, "n/a").when(o % 10 == 2, "").when(o % 10 == 3, F.concat(F.lit(" "), F.replace(p, F.lit("."), F.lit(",")))).otherwise(p)
    d = money.strict(F.col("t"))
    return fx.table(spark, sf, "orders").select(o.alias("order_id"), t.alias("t")).select("order_id", F.when(F.col("t").isNull(), "missing_amount").when(d.isNull(), "amount_invalid_format").otherwise("ok").alias("reason"), d.alias("amount_dec"))


@query("flt_amount_status", w(SUP, DOCS, ROWS) + "SELECT doc_id, CASE WHEN amount_status='failed' THEN 'missing_amount' WHEN n_candidates >= 2 THEN 'amount_ambiguous' ELSE 'amount_uncertain' END AS reason FROM rws WHERE amount_status IN ('ambiguous','failed')")
def flt_amount_status(spark, sf):
    reason = F.when(F.col("amount_status") == "failed", "missing_amount").when(F.col("n_candidates") >= 2, "amount_ambiguous").otherwise("amount_uncertain")
    return fx.rows(spark, sf).where(F.col("amount_status").isin("ambiguous", "failed")).select("doc_id", reason.alias("reason"))


WARN = """concat_ws('|', CASE WHEN iban IS NOT NULL AND iban <> db_iban THEN 'iban_mismatch_supplier' END, CASE WHEN NOT term_trusted THEN 'supplier_term_not_applied' END, CASE WHEN invoice_date IS NULL THEN 'missing_invoice_date' END, CASE WHEN amount_status='tentative' THEN 'amount_tentative' END)"""


@query("prj_warnings", w(SUP, DOCS, ROWS) + f"SELECT doc_id, nullif({WARN}, '') AS warning FROM rws")
def prj_warnings(spark, sf):
    mismatch = F.coalesce(F.col("iban") != F.col("db_iban"), F.lit(False))
    return fx.rows(spark, sf).select("doc_id", decisions.warnings(mismatch).alias("warning"))


PAY = f"pay AS (SELECT *, x, CASE WHEN pct > 0 THEN {DISCOUNT_CENTS} ELSE 0 END AS dc FROM (SELECT *, {EXCL_CENTS} AS x FROM (SELECT *, CAST(amount*100 AS BIGINT) AS c, CAST(vat_rate AS BIGINT) AS r, CAST(discount_pct AS BIGINT) AS pct FROM rws)))"
LADDER = "CASE WHEN c - dc <= 0 THEN 'zero_amount' WHEN iban IS NULL THEN 'missing_iban' WHEN iban <> db_iban THEN 'invalid_iban' WHEN amount_status='tentative' THEN 'low_confidence' WHEN amount_status='ambiguous' THEN 'ambiguous' WHEN amount_status='failed' THEN 'missing_amount' ELSE 'export_allowed' END"
STATUS = "CASE WHEN reason_code IN ('zero_amount','missing_iban','invalid_iban','missing_amount') THEN 'excluded' WHEN reason_code IN ('low_confidence','ambiguous') THEN 'needs_review' ELSE 'included' END"
DECIDED = f"decided AS (SELECT *, {STATUS} AS decision FROM (SELECT *, {LADDER} AS reason_code, {m('c - dc')} AS payable FROM pay))"
BASE = w(SUP, DOCS, ROWS, PAY)
FULL = w(SUP, DOCS, ROWS, PAY, DECIDED)


@query("prj_discount", BASE + f"SELECT doc_id, {m('x')} AS excl_base, {m('dc')} AS discount, {m('c - dc')} AS payable FROM pay WHERE doc_type='invoice'")
def prj_discount(spark, sf):
    return decisions.with_payable(fx.rows(spark, sf).where("doc_type = 'invoice'")).select("doc_id", "excl_base", "discount", "payable")


@query("prj_decision", FULL + "SELECT doc_id, decision, reason_code, payable FROM decided WHERE doc_type='invoice'")
def prj_decision(spark, sf):
    return decisions.decide(decisions.with_payable(fx.rows(spark, sf).where("doc_type = 'invoice'"))).select("doc_id", "decision", "reason_code", "payable")


@query("prj_decision_norm", FULL + "SELECT doc_id, decision = 'needs_review' AS requires_rerun, sha256(concat_ws('|', doc_id, decision, reason_code, CAST(payable AS VARCHAR))) AS fingerprint FROM decided WHERE doc_type='invoice'")
def prj_decision_norm(spark, sf):
    return decisions.decide(decisions.with_payable(fx.rows(spark, sf).where("doc_type = 'invoice'"))).select("doc_id", "requires_rerun", "fingerprint")


@query("flt_exportable", FULL + "SELECT doc_id, lower(supplier_name) AS supplier, payable FROM decided WHERE doc_type='invoice' AND decision='included'")
def flt_exportable(spark, sf):
    """Included payments that need no rerun, in canonical order."""
    out = decisions.decide(decisions.with_payable(fx.rows(spark, sf).where("doc_type = 'invoice'"))).where("decision = 'included' and not requires_rerun")
    return out.select("doc_id", F.lower("supplier_name").alias("supplier"), "payable").orderBy("doc_id", "supplier", F.col("payable").cast("string"))


@query("prj_effective_amount", w(SUP, DOCS, ROWS) + """SELECT doc_id, CASE WHEN picked IS NOT NULL THEN picked WHEN amount_status IN ('confirmed','tentative') AND snap IS NOT NULL AND (cell IS NULL OR cell = snap) THEN snap ELSE cell END AS amount_used FROM (
  SELECT doc_id, amount_status, CASE WHEN order_id%6=0 THEN CAST(amount + 1 AS DECIMAL(18,2)) END AS picked, CASE WHEN order_id%5<>0 THEN amount END AS snap, CASE WHEN order_id%4=0 THEN CAST(amount - 1 AS DECIMAL(18,2)) WHEN order_id%4=1 THEN NULL ELSE amount END AS cell FROM rws)""")
def prj_effective_amount(spark, sf):
    o, a = F.col("order_id"), F.col("amount")
    picked, snap = F.when(o % 6 == 0, (a + 1).cast("decimal(18,2)")), F.when(o % 5 != 0, a)
    cell = F.when(o % 4 == 0, (a - 1).cast("decimal(18,2)")).when(o % 4 == 1, F.lit(None)).otherwise(a)
    return fx.rows(spark, sf).select("doc_id", decisions.effective_amount(cell, F.col("amount_status"), snap, picked).alias("amount_used"))


OVER = "ovr AS (SELECT doc_id, CAST(amount + 5 AS DECIMAL(18,2)) AS new_amount FROM docs WHERE order_id % 10 = 3)"


@query("prj_amount_override", w(SUP, DOCS, ROWS, OVER) + "SELECT r.doc_id, coalesce(o.new_amount, r.amount) AS amount, o.new_amount IS NOT NULL AS overridden FROM rws r LEFT JOIN ovr o ON r.doc_id = o.doc_id")
def prj_amount_override(spark, sf):
    over = fx.documents(spark, sf).where("order_id % 10 = 3").select("doc_id", (F.col("amount") + 5).cast("decimal(18,2)").alias("new_amount"))
    return fx.rows(spark, sf).join(over, "doc_id", "left").select("doc_id", F.coalesce("new_amount", "amount").alias("amount"), F.col("new_amount").isNotNull().alias("overridden"))


MODE = "CASE order_id % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'due' ELSE 'manual' END"


@query("prj_execution_date", w(SUP, DOCS, ROWS) + f"""SELECT doc_id, {MODE} AS date_mode, CASE order_id % 3 WHEN 0 THEN {S} WHEN 1 THEN coalesce(greatest(CAST(invoice_date + CASE WHEN term_trusted THEN term_days ELSE 0 END AS DATE), {S}), {S}) ELSE CAST(doc_date + 3 AS DATE) END AS execution_date FROM
  (SELECT doc_id, order_id, CASE WHEN invoice_date IS NULL THEN {S} ELSE invoice_date END AS invoice_date, CASE WHEN invoice_date IS NULL THEN FALSE ELSE term_trusted END AS term_trusted, term_days, doc_date FROM rws)""")
def prj_execution_date(spark, sf):
    o = F.col("order_id")
    mode = F.when(o % 3 == 0, "direct").when(o % 3 == 1, "due").otherwise("manual")
    rows = fx.rows(spark, sf).withColumn("manual_date", F.date_add("doc_date", 3)).withColumn("date_mode", mode)
    return rows.select("doc_id", "date_mode", decisions.execution_date(F.col("date_mode"), _session()).alias("execution_date"))


@query("flt_weekend", w(DOCS) + "SELECT doc_id, doc_date FROM docs WHERE isodow(doc_date) >= 6")
def flt_weekend(spark, sf):
    return fx.documents(spark, sf).where(dates.weekend(F.col("doc_date"))).select("doc_id", "doc_date")


@query("prj_description", w(SUP, DOCS, ROWS) + "SELECT supplier_id, concat_ws(' - ', max(customer_code), string_agg(doc_id, ' - ' ORDER BY doc_id) FILTER (WHERE doc_type='invoice'), string_agg(doc_id, ' - ' ORDER BY doc_id) FILTER (WHERE doc_type='credit_note')) AS description FROM rws GROUP BY supplier_id, year(doc_date), month(doc_date)")
def prj_description(spark, sf):
    """Customer, sorted invoices, then sorted credits of a supplier's month."""
    names = lambda kind: F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("doc_type") == kind, F.col("doc_id")))))
    g = fx.rows(spark, sf).groupBy("supplier_id", F.year("doc_date").alias("y"), F.month("doc_date").alias("mo")).agg(F.max("customer_code").alias("c"), names("invoice").alias("i"), names("credit_note").alias("n"))
    return g.select("supplier_id", F.array_join(F.concat(F.array("c"), "i", "n"), " - ").alias("description"))


@query("flt_row_filter", w(SUP, DOCS, ROWS) + "SELECT doc_id FROM rws WHERE contains(lower(concat_ws(' ', doc_id, supplier_name, iban, source_file, match_status, amount_status, CAST(amount AS VARCHAR), customer_code, vat_number)), '77')")
def flt_row_filter(spark, sf):
    cells = [F.col(c).cast("string") for c in ("doc_id", "supplier_name", "iban", "source_file", "match_status", "amount_status", "amount", "customer_code", "vat_number")]
    return fx.rows(spark, sf).where(F.contains(F.lower(F.concat_ws(" ", *cells)), F.lit("77"))).select("doc_id")


@query("flt_row_valid", w(SUP, DOCS, ROWS) + """SELECT doc_id, error FROM rws, unnest([CASE WHEN supplier_name = '' THEN 'missing_supplier_name' END, CASE WHEN iban IS NULL THEN 'missing_iban' END, CASE WHEN invoice_date IS NULL THEN 'missing_date' END, CASE WHEN amount <= 1000 THEN 'amount_too_low' END]) AS t(error) WHERE error IS NOT NULL""")
def flt_row_valid(spark, sf):
    errors = F.array_compact(F.array(
        F.when(F.col("supplier_name") == "", "missing_supplier_name"), F.when(F.col("iban").isNull(), "missing_iban"),
        F.when(F.col("invoice_date").isNull(), "missing_date"), F.when(F.col("amount") <= 1000, "amount_too_low"),
    ))
    return fx.rows(spark, sf).select("doc_id", F.explode(errors).alias("error"))


@query("flt_debtor_valid", "SELECT c_custkey AS debtor, CASE WHEN trim(c_name) = '' THEN 'missing_name' WHEN c_custkey % 6 = 0 THEN 'invalid_iban' WHEN length(bic) NOT IN (8, 11) THEN 'invalid_bic' ELSE 'ok' END AS state FROM (SELECT *, CASE WHEN c_custkey % 4 = 0 THEN 'BANKNL' ELSE 'BANKNL2A' END AS bic FROM customer)")
def flt_debtor_valid(spark, sf):
    k, padded = F.col("c_custkey"), F.lpad(F.col("c_custkey").cast("string"), 10, "0")
    check = F.lit(98) - (F.concat(F.lit("11102320"), padded, F.lit("232100")).cast("decimal(38,0)") % 97).cast("int")
    iban = F.concat(F.lit("NL"), F.lpad(F.when(k % 6 == 0, (check + 1) % 100).otherwise(check).cast("string"), 2, "0"), F.lit("BANK"), padded)
    bic = F.when(k % 4 == 0, "BANKNL").otherwise("BANKNL2A")
    state = F.when(F.trim("c_name") == "", "missing_name").when(~identifiers.iban_valid(iban), "invalid_iban").when(~bic.rlike("^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$"), "invalid_bic").otherwise("ok")
    return fx.table(spark, sf, "customer").select(k.alias("debtor"), state.alias("state"))


@query("prj_strip_text", w(SUP, DOCS, TEXTS) + "SELECT doc_id, supplier_id, amount FROM texts")
def prj_strip_text(spark, sf):
    return fx.texts(spark, sf).drop("text").select("doc_id", "supplier_id", "amount")


@query("prj_snapshot", w(SUP, DOCS, ROWS) + "SELECT doc_id, supplier_name, iban, amount, amount_status, match_status, invoice_date FROM rws")
def prj_snapshot(spark, sf):
    return fx.rows(spark, sf).select("doc_id", "supplier_name", "iban", "amount", "amount_status", "match_status", "invoice_date")


AMT = "(SELECT o_orderkey AS order_id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS p, o_orderkey % 6 AS k FROM orders)"


@query("fn_amount_eu", f"SELECT order_id, CASE k WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 2 THEN CAST(-CAST(p AS DECIMAL(18,2)) AS DECIMAL(24,6)) ELSE CAST(CAST(p AS DECIMAL(18,2)) AS DECIMAL(24,6)) END AS amount FROM {AMT}")
def fn_amount_eu(spark, sf):
    """Amounts written as 1.234,56 / EUR 1,234.56 / -12,50 / 1234 / none are read back."""
    p = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    whole, cents, k = F.substring_index(p, ".", 1), F.substring_index(p, ".", -1), F.col("o_orderkey") % 6
    grouped = lambda sep: F.reverse(F.regexp_replace(F.reverse(whole), "([0-9]{3})(?=[0-9])", f"$1{sep}"))
    t = (
        F.when(k == 0, F.concat(F.lit("EUR "), grouped("."), F.lit(","), cents)).when(k == 1, F.concat(F.lit("€ "), grouped(","), F.lit("."), cents))
        .when(k == 2, F.concat(F.lit("- "), whole, F.lit(","), cents)).when(k == 3, whole).when(k == 4, F.lit("n.v.t.")).otherwise(F.concat(whole, F.lit(","), cents, F.lit(" eur")))
    )
    return fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), money.european(t).alias("amount"))


@query("fn_amount_strict", f"SELECT order_id, CAST(round(TRY_CAST(CASE WHEN k = 5 THEN 'x1' ELSE p END AS DECIMAL(24,6)), 2) AS DECIMAL(18,2)) AS amount FROM {AMT}")
def fn_amount_strict(spark, sf):
    p = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    t = F.when(F.col("o_orderkey") % 6 == 5, "x1").otherwise(F.replace(p, F.lit("."), F.lit(",")))
    return fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), money.strict(t).alias("amount"))


@query("fn_amount_tokens", r"SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '\d{1,2}[.,]\d{2}\s*%', ' ', 'g'), '\d{1,3}(?:[.,]\d{3})*[.,]\d{2}')) AS n_tokens FROM documents")
def fn_amount_tokens(spark, sf):
    """Money tokens of whole texts that are no percentages."""
    plain = F.regexp_replace("text", r"\d{1,2}[.,]\d{2}\s*%", " ")
    return fx.table(spark, sf, "documents").select("doc_id", F.regexp_count(plain, F.lit(r"\d{1,3}(?:[.,]\d{3})*[.,]\d{2}")).cast("long").alias("n_tokens"))


@query("fn_money_fmt", f"SELECT order_id, p AS xml, replace(p, '.', ',') AS dutch FROM {AMT}")
def fn_money_fmt(spark, sf):
    a = F.col("o_totalprice").cast("decimal(18,2)")
    return fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), a.cast("string").alias("xml"), money.dutch(a).alias("dutch"))


@query("fn_money_sum", w(DOCS) + "SELECT supplier_id, CAST(sum(amount) AS DECIMAL(28,2)) AS total FROM docs GROUP BY supplier_id")
def fn_money_sum(spark, sf):
    return fx.documents(spark, sf).groupBy("supplier_id").agg(F.sum("amount").cast("decimal(28,2)").alias("total"))


@query("fn_vat_rate", "SELECT p_partkey, CASE WHEN TRY_CAST(t AS INT) BETWEEN 0 AND 100 THEN TRY_CAST(t AS INT) ELSE 21 END AS vat_rate FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN NULL WHEN 2 THEN '250' ELSE CAST(p_size AS VARCHAR) END AS t FROM part)")
def fn_vat_rate(spark, sf):
    k = F.col("p_partkey") % 5
    t = F.when(k == 0, "x").when(k == 1, F.lit(None)).when(k == 2, "250").otherwise(F.col("p_size").cast("string"))
    return fx.table(spark, sf, "part").select("p_partkey", money.vat_rate(t).alias("vat_rate"))


@query("fn_excl", f"SELECT order_id, {m(EXCL_CENTS)} AS excl FROM (SELECT order_id, CAST(CAST(p AS DECIMAL(18,2))*100 AS BIGINT) AS c, CASE k WHEN 0 THEN 0 WHEN 1 THEN 9 WHEN 2 THEN 6 ELSE 21 END AS r FROM {AMT})")
def fn_excl(spark, sf):
    k = F.col("o_orderkey") % 6
    rate = F.when(k == 0, 0).when(k == 1, 9).when(k == 2, 6).otherwise(21)
    return fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), money.excl(F.col("o_totalprice").cast("decimal(18,2)"), rate).alias("excl"))


@query("fn_iban_clean", w(SUP) + "SELECT supplier_id, iban AS clean FROM sup")
def fn_iban_clean(spark, sf):
    spaced = F.regexp_replace(F.lower("iban"), "(.{4})", "$1 ")
    return fx.suppliers(spark, sf).select("supplier_id", identifiers.iban_clean(spaced).alias("clean"))


@query("fn_iban_valid", w(SUP) + "SELECT supplier_id, supplier_id % 3 <> 0 AS valid FROM sup")
def fn_iban_valid(spark, sf):
    """Every third account has a digit of its number changed, which the check digits tell."""
    digit = (F.substring("iban", 18, 1).cast("int") + 1) % 10
    given = F.when(F.col("supplier_id") % 3 == 0, F.concat(F.substring("iban", 1, 17), digit.cast("string"))).otherwise(F.col("iban"))
    return fx.suppliers(spark, sf).select("supplier_id", identifiers.iban_valid(given).alias("valid"))


@query("fn_iban_mask", w(SUP) + "SELECT supplier_id, concat(left(iban,2), '…', right(iban,4)) AS masked FROM sup")
def fn_iban_mask(spark, sf):
    return fx.suppliers(spark, sf).select("supplier_id", identifiers.iban_mask(F.col("iban")).alias("masked"))


@query("fn_iban_ocr_fix", w(SUP) + "SELECT supplier_id, iban AS fixed FROM sup")
def fn_iban_ocr_fix(spark, sf):
    noisy = F.concat(F.substring("iban", 1, 2), F.translate(F.substring("iban", 3, 2), "0152", "OISZ"), F.substring("iban", 5, 4), F.translate(F.substring("iban", 9, 10), "0152", "OISZ"))
    return fx.suppliers(spark, sf).select("supplier_id", identifiers.iban_ocr_fix(noisy).alias("fixed"))


@query("fn_vat_compact", w(SUP) + "SELECT supplier_id, vat_number AS vat, supplier_id % 4 <> 0 AS shaped FROM sup")
def fn_vat_compact(spark, sf):
    dotted = F.concat(F.substring("vat_number", 1, 2), F.lit(" "), F.substring("vat_number", 3, 4), F.lit("."), F.substring("vat_number", 7, 20))
    bad = F.when(F.col("supplier_id") % 4 == 0, F.substring("vat_number", 1, 6)).otherwise(dotted)
    return fx.suppliers(spark, sf).select("supplier_id", identifiers.vat_compact(dotted).alias("vat"), identifiers.vat_shape(bad).alias("shaped"))


@query("fn_kvk", w(SUP) + "SELECT supplier_id, CASE WHEN supplier_id % 3 = 0 THEN NULL ELSE kvk_number END AS kvk FROM sup")
def fn_kvk(spark, sf):
    given = F.when(F.col("supplier_id") % 3 == 0, "123").otherwise(F.concat(F.lit("KvK "), F.substring("kvk_number", 1, 2), F.lit("."), F.substring("kvk_number", 3, 6)))
    return fx.suppliers(spark, sf).select("supplier_id", identifiers.kvk(given).alias("kvk"))


@query("fn_email_domain", w(SUP) + "SELECT supplier_id, CASE WHEN supplier_id % 5 = 0 THEN NULL ELSE email_domain END AS domain FROM sup")
def fn_email_domain(spark, sf):
    k = F.col("supplier_id") % 5
    given = F.when(k == 0, "info@localhost").when(k == 1, F.concat(F.lit(" Info@"), F.upper("email_domain"))).when(k == 2, F.concat(F.lit("www."), "email_domain")).otherwise(F.col("email_domain"))
    return fx.suppliers(spark, sf).select("supplier_id", identifiers.email_domain(given).alias("domain"))


@query("fn_customer_code", w(SUP) + "SELECT supplier_id, substr(customer_code, 2) AS code, CASE WHEN supplier_id % 2 = 0 THEN 'ab1' ELSE lpad(CAST(supplier_id AS VARCHAR), 6, '0') END AS other FROM sup")
def fn_customer_code(spark, sf):
    other = F.when(F.col("supplier_id") % 2 == 0, " AB1 ").otherwise(F.concat(F.substring("customer_code", 2, 3), F.lit("."), F.substring("customer_code", 5, 3)))
    return fx.suppliers(spark, sf).select("supplier_id", identifiers.customer_code(F.col("customer_code")).alias("code"), identifiers.customer_code(other).alias("other"))


@query("fn_k_code", w(SUP) + "SELECT supplier_id, CASE WHEN supplier_id % 3 = 0 THEN NULL ELSE customer_code END AS k_code FROM sup")
def fn_k_code(spark, sf):
    given = F.when(F.col("supplier_id") % 3 == 0, F.substring("customer_code", 2, 9)).otherwise(F.concat(F.lit("k "), F.substring("customer_code", 2, 9)))
    return fx.suppliers(spark, sf).select("supplier_id", identifiers.k_code(given).alias("k_code"))


@query("fn_clean_name", "SELECT p_partkey, concat(trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' bv') AS name FROM part")
def fn_clean_name(spark, sf):
    return fx.table(spark, sf, "part").select("p_partkey", identifiers.clean_name(F.concat(F.lit("2/2 "), "p_name", F.lit(" B.V."))).alias("name"))


@query("fn_date_parse", w(DOCS) + "SELECT doc_id, CASE WHEN order_id % 6 = 5 THEN NULL ELSE doc_date END AS day FROM docs")
def fn_date_parse(spark, sf):
    k, f = F.col("order_id") % 6, lambda p: F.date_format("doc_date", p)
    given = F.when(k == 0, f("yyyy-MM-dd")).when(k == 1, f("dd-MM-yyyy")).when(k == 2, f("d/M/yyyy")).when(k == 3, f("dd.MM.yyyy")).when(k == 4, F.concat(F.lit("op "), f("dd\\MM\\yyyy"))).otherwise("31-02-1997")
    given = F.when(k == 4, F.concat(F.lit("op "), f("dd"), F.lit("\\"), f("MM"), F.lit("\\"), f("yyyy"))).otherwise(given)
    return fx.documents(spark, sf).select("doc_id", dates.parse(given).alias("day"))


@query("fn_date_month", w(DOCS) + "SELECT doc_id, doc_date AS day FROM docs")
def fn_date_month(spark, sf):
    names = F.element_at(F.array(*[F.lit(n.split()[0]) for n in dates.MONTHS.values()]), F.month("doc_date"))
    short = F.date_format("doc_date", "MMM")
    given = F.when(F.col("order_id") % 2 == 0, F.concat_ws(" ", F.dayofmonth("doc_date").cast("string"), names, F.year("doc_date").cast("string"))).otherwise(F.concat(short, F.lit(" "), F.dayofmonth("doc_date").cast("string"), F.lit(", "), F.year("doc_date").cast("string")))
    return fx.documents(spark, sf).select("doc_id", dates.parse_named(given).alias("day"))


@query("fn_date_fmt", w(DOCS) + "SELECT doc_id, strftime(doc_date, '%d-%m-%Y') AS shown FROM docs")
def fn_date_fmt(spark, sf):
    return fx.documents(spark, sf).select("doc_id", dates.dutch(F.col("doc_date")).alias("shown"))


@query("fn_basename", w(DOCS) + "SELECT doc_id, concat(doc_id, '.pdf') AS file FROM docs")
def fn_basename(spark, sf):
    path = F.when(F.col("order_id") % 2 == 0, F.concat(F.lit("C:\\in\\"), "doc_id", F.lit(".pdf"))).otherwise(F.concat(F.lit("/in/x/"), "doc_id", F.lit(".pdf")))
    return fx.documents(spark, sf).select("doc_id", identifiers.basename(path).alias("file"))


@query("fn_doc_id", w(SUP, DOCS, ROWS) + "SELECT order_id, supplier_id, doc_type, CASE WHEN order_id % 4 = 0 THEN concat('inv:', doc_id) ELSE source_file END AS document_id FROM rws")
def fn_doc_id(spark, sf):
    """The file, else the number; a row with neither gets a hash of its content."""
    file = F.when(F.col("order_id") % 4 != 0, F.col("source_file"))
    name = F.coalesce(F.nullif(F.trim(file), F.lit("")), F.concat(F.lit("inv:"), "doc_id"), F.concat(F.lit("anon:"), F.sha2(F.to_json(F.struct("order_id", "supplier_id")), 256)))
    return fx.rows(spark, sf).select("order_id", "supplier_id", "doc_type", name.alias("document_id"))
