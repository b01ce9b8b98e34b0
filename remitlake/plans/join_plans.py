"""Joins, supplier resolution, credits and settlement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers
from ..operators import credits as cr
from ..operators import decisions, suppliers
from ..sources import fixtures as fx
from .book import query
from .fixture_sql import CREDITS, DOCS, ROWS, SUP, money as m, w
from .rows_plans import DECIDED, FULL, PAY


def _ids(spark, sf):
    """Documents with the identifiers read from them: some missing, some of the next supplier."""
    n = fx.table(spark, sf, "supplier").count()
    o, s = F.col("order_id"), F.col("supplier_id")
    d = fx.documents(spark, sf).select("doc_id", "order_id", s, ((s % n) + 1).alias("other"))
    sup = fx.suppliers(spark, sf)
    own, oth = sup.alias("a"), sup.select(F.col("supplier_id").alias("other"), F.col("vat_number").alias("o_vat"), F.col("iban").alias("o_iban"))
    return d.join(own, "supplier_id").join(oth, "other").select(
        "doc_id", "order_id",
        F.when(o % 4 == 0, F.lit(None)).when(o % 4 == 1, F.col("o_iban")).otherwise(F.col("iban")).alias("iban"),
        F.when(o % 3 == 0, F.col("customer_code")).alias("customer_code"),
        F.when(o % 5 == 0, F.col("o_vat")).when(o % 5 == 1, F.lit(None)).otherwise(F.col("vat_number")).alias("vat_number"),
        F.when(o % 2 == 0, F.col("kvk_number")).alias("kvk_number"),
        F.when(o % 7 < 3, F.col("email_domain")).alias("email_domain"),
        F.when(o % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("firma "), F.col("supplier_name"))).alias("hint"),
    )


IDS = """ids AS (SELECT d.doc_id, d.order_id, CASE d.order_id % 4 WHEN 0 THEN NULL WHEN 1 THEN b.iban ELSE a.iban END AS iban, CASE WHEN d.order_id % 3 = 0 THEN a.customer_code END AS customer_code,
  CASE d.order_id % 5 WHEN 0 THEN b.vat_number WHEN 1 THEN NULL ELSE a.vat_number END AS vat_number, CASE WHEN d.order_id % 2 = 0 THEN a.kvk_number END AS kvk_number,
  CASE WHEN d.order_id % 7 < 3 THEN a.email_domain END AS email_domain, CASE WHEN d.order_id % 6 = 0 THEN '' ELSE concat('firma ', a.supplier_name) END AS hint
  FROM docs d JOIN sup a ON d.supplier_id = a.supplier_id JOIN sup b ON b.supplier_id = (d.supplier_id % (SELECT count(*) FROM supplier)) + 1)"""
PAIRS = """pairs AS (SELECT i.doc_id, i.hint, i.iban IS NOT NULL AND i.iban <> s.iban AS iban_mismatch, s.supplier_id, s.supplier_name, coalesce(i.iban = s.iban, FALSE) AS iban_match, coalesce(i.customer_code = s.customer_code, FALSE) AS code_match, coalesce(i.vat_number = s.vat_number, FALSE) AS vat_match,
  coalesce(i.kvk_number = s.kvk_number, FALSE) AS kvk_match, coalesce(i.email_domain = s.email_domain, FALSE) AS email_match, i.customer_code, i.hint <> '' AS alias_match
  FROM ids i JOIN sup s ON i.iban = s.iban UNION SELECT i.doc_id, i.hint, i.iban IS NOT NULL AND i.iban <> s.iban, s.supplier_id, s.supplier_name, coalesce(i.iban = s.iban, FALSE), coalesce(i.customer_code = s.customer_code, FALSE), coalesce(i.vat_number = s.vat_number, FALSE), coalesce(i.kvk_number = s.kvk_number, FALSE), coalesce(i.email_domain = s.email_domain, FALSE), i.customer_code, i.hint <> ''
  FROM ids i JOIN sup s ON i.customer_code = s.customer_code UNION SELECT i.doc_id, i.hint, i.iban IS NOT NULL AND i.iban <> s.iban, s.supplier_id, s.supplier_name, coalesce(i.iban = s.iban, FALSE), coalesce(i.customer_code = s.customer_code, FALSE), coalesce(i.vat_number = s.vat_number, FALSE), coalesce(i.kvk_number = s.kvk_number, FALSE), coalesce(i.email_domain = s.email_domain, FALSE), i.customer_code, i.hint <> ''
  FROM ids i JOIN sup s ON i.vat_number = s.vat_number UNION SELECT i.doc_id, i.hint, i.iban IS NOT NULL AND i.iban <> s.iban, s.supplier_id, s.supplier_name, coalesce(i.iban = s.iban, FALSE), coalesce(i.customer_code = s.customer_code, FALSE), coalesce(i.vat_number = s.vat_number, FALSE), coalesce(i.kvk_number = s.kvk_number, FALSE), coalesce(i.email_domain = s.email_domain, FALSE), i.customer_code, i.hint <> ''
  FROM ids i JOIN sup s ON i.kvk_number = s.kvk_number)"""
SCORED = """scored AS (SELECT * FROM (SELECT *, CAST(iban_match AS INT) + CAST(code_match AS INT) + CAST(vat_match AS INT) + CAST(kvk_match AS INT) + CAST(email_match AS INT) + CAST(alias_match AS INT) AS n FROM pairs)
  WHERE NOT (customer_code IS NOT NULL AND NOT code_match AND NOT iban_match) AND NOT (n = 1 AND (vat_match OR kvk_match)) AND NOT (iban_mismatch AND n < 2))"""
RANKED = "ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY iban_match DESC, code_match DESC, (vat_match AND kvk_match) DESC, alias_match DESC, vat_match DESC, kvk_match DESC, email_match DESC, lower(supplier_name), supplier_id) AS INT) AS rank FROM scored)"
CORE = "concat_ws(',', CASE WHEN iban_match THEN 'iban' END, CASE WHEN code_match THEN 'customer_number' END, CASE WHEN kvk_match THEN 'kvk' END, CASE WHEN vat_match THEN 'vat' END, CASE WHEN email_match THEN 'email' END)"
NCORE = "CAST(iban_match AS INT) + CAST(code_match AS INT) + CAST(vat_match AS INT) + CAST(kvk_match AS INT) + CAST(email_match AS INT)"
# names of all suppliers clean to the same word here, so a hint matches every supplier's alias
MATCH = w(SUP, DOCS, IDS, PAIRS, SCORED, RANKED)


@query("jn_supplier_block", w(SUP, DOCS, IDS, PAIRS) + "SELECT doc_id, supplier_id FROM pairs")
def jn_supplier_block(spark, sf):
    return suppliers.block(_ids(spark, sf), fx.suppliers(spark, sf))


@query("win_supplier_pick", MATCH + "SELECT doc_id, supplier_id, rank FROM ranked")
def win_supplier_pick(spark, sf):
    return suppliers.pick(suppliers.score(_ids(spark, sf), fx.suppliers(spark, sf))).select("doc_id", "supplier_id", "rank")


@query("topk_alternatives", MATCH + "SELECT doc_id, supplier_id, rank FROM ranked WHERE rank BETWEEN 2 AND 4")
def topk_alternatives(spark, sf):
    return suppliers.pick(suppliers.score(_ids(spark, sf), fx.suppliers(spark, sf))).where("rank between 2 and 4").select("doc_id", "supplier_id", "rank")


@query("fn_match_status", MATCH + f"SELECT doc_id, {CORE} AS core, CASE WHEN {NCORE} >= 2 AND (iban_match OR code_match) THEN 'confirmed' ELSE 'needs_review' END AS status FROM ranked WHERE rank = 1")
def fn_match_status(spark, sf):
    best = suppliers.pick(suppliers.score(_ids(spark, sf), fx.suppliers(spark, sf))).where("rank = 1")
    return best.select("doc_id", F.array_join(suppliers.core_matches(), ",").alias("core"), suppliers.match_status().alias("status"))


@query("fn_core_matches", MATCH + f"SELECT doc_id, supplier_id, {NCORE} AS n_core, iban_match OR code_match AS anchor FROM scored")
def fn_core_matches(spark, sf):
    s = suppliers.score(_ids(spark, sf), fx.suppliers(spark, sf))
    return s.select("doc_id", "supplier_id", F.size(suppliers.core_matches()).alias("n_core"), (F.col("iban_match") | F.col("code_match")).alias("anchor"))


@query("fn_match_signals", w(SUP, DOCS, IDS) + "SELECT doc_id, concat_ws(',', CASE WHEN iban IS NOT NULL THEN 'iban' END, CASE WHEN customer_code IS NOT NULL THEN 'customer_number' END, CASE WHEN hint <> '' THEN 'hint' END, CASE WHEN email_domain IS NOT NULL THEN 'email_domain' END, CASE WHEN kvk_number IS NOT NULL THEN 'kvk' END, CASE WHEN vat_number IS NOT NULL THEN 'vat' END) AS signals FROM ids")
def fn_match_signals(spark, sf):
    names = {"iban": "iban", "customer_code": "customer_number", "hint": "hint", "email_domain": "email_domain", "kvk_number": "kvk", "vat_number": "vat"}
    found = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(c, F.lit(""))) != "", n) for c, n in names.items()]))
    return _ids(spark, sf).select("doc_id", F.array_join(found, ",").alias("signals"))


@query("jn_alias_token", r"SELECT p_partkey, concat(' ', lower(p_name), ' ') LIKE concat('% ', lower(alias), ' %') AND (alias LIKE '% %' OR length(alias) >= 3) AS matched FROM (SELECT *, split_part(p_name, ' ', CAST(1 + p_partkey % 3 AS INT)) AS alias FROM part)")
def jn_alias_token(spark, sf):
    alias = F.split_part("p_name", F.lit(" "), (1 + F.col("p_partkey") % 3).cast("int"))
    return fx.table(spark, sf, "part").select("p_partkey", identifiers.alias_in(F.lower("p_name"), F.lower(alias)).alias("matched"))


@query("jn_fuzzy_name")
def jn_fuzzy_name(spark, sf):
    """Similarity of a document's hint and the names of the suppliers it shares an identifier with, where the alias missed.

    Documents are blocked with suppliers by identifiers, so a hint is compared with a few names.
    Names here differ in their number, so hints have a letter of theirs changed.
    """
    ids = _ids(spark, sf).withColumn("hint", F.regexp_replace("hint", "upp", "up"))
    pairs = suppliers.score(ids, fx.suppliers(spark, sf)).where("not alias_match").select("doc_id", "supplier_id", F.lower("hint").alias("hint"), F.lower("s_name").alias("name"))
    return suppliers.fuzzy_ratio(pairs, "hint", "name", "ratio").select("doc_id", "supplier_id", F.round("ratio", 4).alias("ratio"), (F.col("ratio") >= 0.85).alias("similar"))


@query("jn_new_supplier", w(SUP, DOCS, ROWS) + "SELECT iban, CAST(count(*) AS BIGINT) AS n_docs FROM rws WHERE iban IS NOT NULL AND iban NOT IN (SELECT iban FROM sup WHERE supplier_id % 5 <> 0) AND iban NOT LIKE '%BANC%' GROUP BY iban")
def jn_new_supplier(spark, sf):
    """Valid accounts that the master (four fifths of it here) has not."""
    master = fx.suppliers(spark, sf).where("supplier_id % 5 <> 0").select("iban")
    new = fx.rows(spark, sf).where("iban is not null").join(master, "iban", "left_anti")
    return new.where(identifiers.iban_valid(F.col("iban"))).groupBy("iban").agg(F.count("*").alias("n_docs"))


@query("jn_sync_confirmed", w(SUP, DOCS, ROWS) + "SELECT r.doc_id, s.supplier_name AS name, s.term_days AS term FROM rws r LEFT JOIN sup s ON r.iban = s.iban WHERE r.match_status = 'unmatched'")
def jn_sync_confirmed(spark, sf):
    s = fx.suppliers(spark, sf).select("iban", F.col("supplier_name").alias("name"), F.col("term_days").alias("term"))
    return fx.rows(spark, sf).where("match_status = 'unmatched'").select("doc_id", "iban").join(s, "iban", "left").select("doc_id", "name", "term")


@query("jn_iban_decision", w(SUP, DOCS, ROWS) + """SELECT r.doc_id, CASE WHEN c.choice = 'use_pdf' THEN r.iban ELSE r.db_iban END AS iban, coalesce(c.choice, 'keep_db') AS choice FROM rws r
  LEFT JOIN (SELECT DISTINCT supplier_id, iban, CASE WHEN supplier_id % 2 = 0 THEN 'use_pdf' ELSE 'keep_db' END AS choice FROM rws WHERE iban <> db_iban AND supplier_id % 3 <> 0) c ON r.supplier_id = c.supplier_id AND r.iban = c.iban WHERE r.iban <> r.db_iban""")
def jn_iban_decision(spark, sf):
    rows = fx.rows(spark, sf).where("iban <> db_iban")
    choice = rows.where("supplier_id % 3 <> 0").select("supplier_id", "iban", F.when(F.col("supplier_id") % 2 == 0, "use_pdf").otherwise("keep_db").alias("choice")).distinct()
    j = rows.join(choice, ["supplier_id", "iban"], "left").withColumn("choice", F.coalesce("choice", F.lit("keep_db")))
    return j.select("doc_id", F.when(F.col("choice") == "use_pdf", F.col("iban")).otherwise(F.col("db_iban")).alias("iban"), "choice")


@query("jn_doc_type_override", w(SUP, DOCS, ROWS) + "SELECT doc_id, CASE WHEN order_id % 50 = 7 THEN CASE doc_type WHEN 'invoice' THEN 'credit_note' ELSE 'invoice' END ELSE doc_type END AS doc_type FROM rws")
def jn_doc_type_override(spark, sf):
    d = fx.documents(spark, sf)
    user = d.where("order_id % 50 = 7").select("doc_id", F.when(F.col("doc_type") == "invoice", "credit_note").otherwise("invoice").alias("user_type"))
    return d.join(user, "doc_id", "left").select("doc_id", F.coalesce("user_type", "doc_type").alias("doc_type"))


@query("jn_duplicate_history", w(SUP, DOCS, ROWS) + "SELECT doc_id, CAST(doc_date + 30 AS DATE) AS exported FROM rws WHERE doc_type='invoice' AND order_id % 6 = 0 AND supplier_name <> ''")
def jn_duplicate_history(spark, sf):
    """Payments whose (supplier, number, amount) were exported before, with the last export."""
    rows = fx.rows(spark, sf).where("doc_type = 'invoice' and supplier_name <> ''")
    key = [F.lower("supplier_name").alias("k1"), F.lower("doc_id").alias("k2"), F.col("amount").alias("k3")]
    past = rows.where("order_id % 6 = 0").select(*key, F.date_add("doc_date", 30).alias("d"))
    past = past.unionByName(past.withColumn("d", F.date_sub("d", 7))).groupBy("k1", "k2", "k3").agg(F.max("d").alias("exported"))
    return rows.select("doc_id", *key).join(past, ["k1", "k2", "k3"]).select("doc_id", "exported")


@query("jn_orphans", w(DOCS, CREDITS) + "SELECT c.credit_id, 'reference_absent' AS problem FROM credits c WHERE ref_number IS NOT NULL AND ref_number NOT IN (SELECT doc_id FROM docs WHERE order_id % 4 <> 0) UNION ALL SELECT credit_id, 'no_reference' FROM credits WHERE ref_number IS NULL")
def jn_orphans(spark, sf):
    docs = fx.documents(spark, sf)
    c = fx.credits(docs)
    covered = docs.where("order_id % 4 <> 0").select(F.col("doc_id").alias("ref_number"))
    absent = c.where("ref_number is not null").join(covered, "ref_number", "left_anti").select("credit_id", F.lit("reference_absent").alias("problem"))
    return absent.unionByName(c.where("ref_number is null").select("credit_id", F.lit("no_reference").alias("problem")))


@query("jn_parity", w(SUP, DOCS, ROWS) + """SELECT doc_id, problem FROM (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, unnest(CASE WHEN b.doc_id IS NULL THEN ['row_missing'] WHEN a.doc_id IS NULL THEN ['row_extra'] ELSE list_filter([CASE WHEN a.amount <> b.amount THEN 'amount_mismatch' END, CASE WHEN a.iban IS DISTINCT FROM b.iban THEN 'iban_mismatch' END], lambda x: x IS NOT NULL) END) AS problem
  FROM (SELECT * FROM rws WHERE order_id % 40 <> 0) a FULL JOIN (SELECT doc_id, CASE WHEN order_id % 41 = 0 THEN CAST(amount + 1 AS DECIMAL(18,2)) ELSE amount END AS amount, CASE WHEN order_id % 43 = 0 THEN NULL ELSE iban END AS iban FROM rws WHERE order_id % 39 <> 0) b ON a.doc_id = b.doc_id)""")
def jn_parity(spark, sf):
    rows = fx.rows(spark, sf)
    a = rows.where("order_id % 40 <> 0").select("doc_id", "amount", "iban").alias("a")
    b = rows.where("order_id % 39 <> 0").select("doc_id", F.when(F.col("order_id") % 41 == 0, (F.col("amount") + 1).cast("decimal(18,2)")).otherwise(F.col("amount")).alias("amount"), F.when(F.col("order_id") % 43 != 0, F.col("iban")).alias("iban")).alias("b")
    j = a.join(b, F.col("a.doc_id") == F.col("b.doc_id"), "full_outer")
    both = F.array_compact(F.array(F.when(F.col("a.amount") != F.col("b.amount"), "amount_mismatch"), F.when(~F.col("a.iban").eqNullSafe(F.col("b.iban")), "iban_mismatch")))
    problems = F.when(F.col("b.doc_id").isNull(), F.array(F.lit("row_missing"))).when(F.col("a.doc_id").isNull(), F.array(F.lit("row_extra"))).otherwise(both)
    return j.select(F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"), F.explode(problems).alias("problem"))


@query("jn_blacklist", w(SUP, DOCS, ROWS) + "SELECT doc_id, vat_number FROM rws WHERE vat_number NOT IN (SELECT vat_number FROM sup WHERE supplier_id % 8 = 0)")
def jn_blacklist(spark, sf):
    own = fx.suppliers(spark, sf).where("supplier_id % 8 = 0").select("vat_number")
    return fx.rows(spark, sf).select("doc_id", "vat_number").join(own, "vat_number", "left_anti").select("doc_id", "vat_number")


@query("jn_approvals", w(SUP, DOCS, ROWS) + "SELECT doc_id, CASE WHEN order_id % 9 = 0 OR order_id % 12 = 5 THEN 'user_approved' ELSE 'none' END AS approval FROM rws WHERE match_status = 'needs_review'")
def jn_approvals(spark, sf):
    """Saved approvals by row id, else by the older id (the file)."""
    rows = fx.rows(spark, sf)
    new = rows.where("order_id % 9 = 0").select("doc_id", F.lit("user_approved").alias("by_row"))
    old = rows.where("order_id % 12 = 5").select("source_file", F.lit("user_approved").alias("by_file"))
    j = rows.where("match_status = 'needs_review'").join(new, "doc_id", "left").join(old, "source_file", "left")
    return j.select("doc_id", F.coalesce("by_row", "by_file", F.lit("none")).alias("approval"))


@query("src_overrides", w(DOCS) + """SELECT doc_id, batch_key, new_amount FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN batch_key = 'b1' THEN 0 ELSE 1 END, seq DESC) AS n FROM (
  SELECT doc_id, concat('b', CAST((order_id + k) % 3 AS VARCHAR)) AS batch_key, k AS seq, CAST(amount + k AS DECIMAL(18,2)) AS new_amount FROM docs, (VALUES (0),(1),(2),(3)) v(k) WHERE order_id % 5 = 0)) WHERE n = 1""")
def src_overrides(spark, sf):
    """Overrides of any batch for documents present: the current batch wins, then the latest."""
    from pyspark.sql import Window

    k = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seq")
    saved = fx.documents(spark, sf).where("order_id % 5 = 0").select("doc_id", "order_id", "amount", k).select("doc_id", F.concat(F.lit("b"), ((F.col("order_id") + F.col("seq")) % 3).cast("string")).alias("batch_key"), "seq", (F.col("amount") + F.col("seq")).cast("decimal(18,2)").alias("new_amount"))
    order = Window.partitionBy("doc_id").orderBy(F.when(F.col("batch_key") == "b1", 0).otherwise(1), F.desc("seq"))
    return saved.join(fx.documents(spark, sf).select("doc_id"), "doc_id", "left_semi").withColumn("n", F.row_number().over(order)).where("n = 1").select("doc_id", "batch_key", "new_amount")


def _batched(spark, sf):
    docs = fx.documents(spark, sf)
    batch = F.concat_ws("-", F.col("supplier_id").cast("string"), F.year("doc_date").cast("string")).alias("batch")
    return fx.credits(docs).select("credit_id", batch, "amount", "ref_number"), docs.where("doc_type = 'invoice'").select("doc_id", batch, "amount"), docs


BATCHED = "bc AS (SELECT credit_id, concat(CAST(supplier_id AS VARCHAR), '-', CAST(year(doc_date) AS VARCHAR)) AS batch, amount, ref_number FROM credits), bi AS (SELECT doc_id, concat(CAST(supplier_id AS VARCHAR), '-', CAST(year(doc_date) AS VARCHAR)) AS batch, amount, row_number() OVER (PARTITION BY supplier_id, year(doc_date) ORDER BY amount, doc_id) AS pos, sum(amount) OVER (PARTITION BY supplier_id, year(doc_date) ORDER BY amount, doc_id) AS running FROM docs WHERE doc_type='invoice')"
TOT = "tot AS (SELECT batch, sum(amount) AS available FROM bi GROUP BY batch)"
SUBS = "subs AS (SELECT c.credit_id, min(s.sz) AS sz FROM bc c JOIN (SELECT batch, sz, total FROM (SELECT b.batch, mk, count(*) AS sz, sum(b.amount) AS total, max(mx.k) >= 0 AS ok, bit_count(mk) AS want FROM bi b JOIN (SELECT unnest(range(1,32)) AS mk) q ON TRUE JOIN (SELECT 0 AS k) mx ON TRUE WHERE b.pos <= 5 AND (mk >> CAST(b.pos - 1 AS INT)) & 1 = 1 GROUP BY b.batch, mk) WHERE sz = want) s ON c.batch = s.batch AND abs(s.total - c.amount) <= 0.01 GROUP BY c.credit_id)"
MATCHED = f"""matched AS (SELECT c.credit_id, c.amount, CASE WHEN t.available IS NULL THEN 'none' WHEN c.amount > t.available + 0.01 THEN 'exceeds' WHEN r.doc_id IS NOT NULL THEN 'reference' WHEN e.n = 1 THEN 'amount_exact' WHEN e.n > 1 THEN 'amount_exact_many'
  WHEN s.sz IS NOT NULL THEN 'amount_subset' WHEN f.n > 0 THEN 'amount_fit' WHEN p.pos >= 2 THEN 'amount_span' ELSE 'unsure' END AS rule, s.sz, p.pos, c.ref_number FROM bc c LEFT JOIN tot t ON c.batch = t.batch LEFT JOIN bi r ON r.batch = c.batch AND r.doc_id = c.ref_number
  LEFT JOIN (SELECT c.credit_id, count(*) AS n FROM bc c JOIN bi i ON c.batch = i.batch AND abs(c.amount - i.amount) <= 0.01 GROUP BY 1) e ON c.credit_id = e.credit_id LEFT JOIN subs s ON c.credit_id = s.credit_id
  LEFT JOIN (SELECT c.credit_id, count(*) AS n FROM bc c JOIN bi i ON c.batch = i.batch AND i.amount >= c.amount GROUP BY 1) f ON c.credit_id = f.credit_id LEFT JOIN (SELECT c.credit_id, min(i.pos) AS pos FROM bc c JOIN bi i ON c.batch = i.batch AND i.running >= c.amount - 0.01 GROUP BY 1) p ON c.credit_id = p.credit_id)"""
MWITH = w(DOCS, CREDITS, BATCHED, TOT, SUBS, MATCHED)


@query("grp_credit_match_one", MWITH + """SELECT credit_id, CASE rule WHEN 'none' THEN 'manual_review' WHEN 'exceeds' THEN 'manual_review' WHEN 'unsure' THEN 'manual_review' WHEN 'amount_exact_many' THEN 'amount_exact' ELSE rule END AS method,
  CASE rule WHEN 'reference' THEN 95 WHEN 'amount_exact' THEN 90 WHEN 'amount_exact_many' THEN 75 WHEN 'amount_subset' THEN 80 WHEN 'amount_fit' THEN 70 WHEN 'amount_span' THEN 75 ELSE 0 END AS confidence,
  CAST(CASE WHEN rule IN ('none','exceeds','unsure') THEN 0 WHEN rule = 'amount_subset' THEN sz WHEN rule = 'amount_span' THEN pos ELSE 1 END AS INT) AS n_linked FROM matched""")
def grp_credit_match_one(spark, sf):
    c, i, _ = _batched(spark, sf)
    return cr.match_one(c, i).select("credit_id", "method", "confidence", "n_linked")


@query("grp_credit_subset", w(DOCS, CREDITS, BATCHED, SUBS) + "SELECT credit_id, CAST(sz AS INT) AS n_invoices FROM subs")
def grp_credit_subset(spark, sf):
    """Credits that some of the first five invoices of their batch sum up to."""
    from pyspark.sql import Window

    c, i, _ = _batched(spark, sf)
    order = Window.partitionBy("batch").orderBy("amount", "doc_id")
    first = i.withColumn("pos", F.row_number().over(order)).where("pos <= 5").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("pos", "amount"))).alias("first"))
    sums = first.select("batch", cr.subset_sums(F.col("first")).alias("sums"))
    return c.join(sums, "batch").select("credit_id", cr.subset_of(F.col("sums"), F.col("amount"))["n"].alias("n_invoices")).where("n_invoices is not null")


@query("jn_credit_reference", w(DOCS, CREDITS, BATCHED) + "SELECT c.credit_id, i.doc_id FROM bc c JOIN bi i ON c.batch = i.batch AND c.ref_number = i.doc_id")
def jn_credit_reference(spark, sf):
    c, i, _ = _batched(spark, sf)
    j = c.where("ref_number is not null").select("credit_id", "batch", F.upper("ref_number").alias("k")).join(i.select("batch", "doc_id", F.upper("doc_id").alias("k")), ["batch", "k"])
    return j.select("credit_id", "doc_id")


@query("jn_credit_exact", w(DOCS, CREDITS, BATCHED) + "SELECT c.credit_id, i.doc_id FROM bc c JOIN bi i ON c.batch = i.batch AND abs(c.amount - i.amount) <= 1000")
def jn_credit_exact(spark, sf):
    """Band join by amount: both sides are dealt into bands as wide as the tolerance, which its SQL fixes at 1000; ``jn_credit_exact_cents`` has one cent."""
    c, i, _ = _batched(spark, sf)
    band = F.floor(F.col("amount") / 1000)
    left = c.select("credit_id", "batch", "amount", F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    right = i.select("batch", "doc_id", F.col("amount").alias("a"), band.alias("band"))
    return left.join(right, ["batch", "band"]).where("abs(amount - a) <= 1000").select("credit_id", "doc_id")


@query("jn_credit_fit", w(DOCS, CREDITS, BATCHED) + "SELECT credit_id, doc_id FROM (SELECT c.credit_id, i.doc_id, row_number() OVER (PARTITION BY c.credit_id ORDER BY i.amount, i.doc_id) AS n FROM bc c JOIN bi i ON c.batch = i.batch AND i.amount >= c.amount) WHERE n = 1")
def jn_credit_fit(spark, sf):
    from pyspark.sql import Window

    c, i, _ = _batched(spark, sf)
    order = Window.partitionBy("batch").orderBy("amount", "doc_id")
    inv = i.withColumn("pos", F.row_number().over(order)).withColumn("running", F.sum("amount").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return cr._upto(inv, c, "amount", "fit", F.col("amount")).where("fit is not null").select("credit_id", F.col("fit")["doc_id"].alias("doc_id"))


@query("win_span_prefix", w(DOCS, CREDITS, BATCHED) + "SELECT c.credit_id, CAST(min(i.pos) AS INT) AS n_invoices FROM bc c JOIN bi i ON c.batch = i.batch AND i.running >= c.amount - 0.01 GROUP BY c.credit_id")
def win_span_prefix(spark, sf):
    from pyspark.sql import Window

    c, i, _ = _batched(spark, sf)
    order = Window.partitionBy("batch").orderBy("amount", "doc_id")
    inv = i.withColumn("pos", F.row_number().over(order)).withColumn("running", F.sum("amount").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return cr._upto(inv, c, "running", "span", F.col("amount") - F.lit(cr.CENT)).where("span is not null").select("credit_id", F.col("span")["pos"].alias("n_invoices"))


@query("win_allocation_fill", w(DOCS, CREDITS, BATCHED) + """SELECT c.credit_id, i.doc_id, CAST(least(i.amount, c.amount - (i.running - i.amount)) AS DECIMAL(18,2)) AS applied FROM (SELECT batch, min_by(credit_id, (-amount, credit_id)) AS credit_id, max(amount) AS amount FROM bc GROUP BY batch) c JOIN bi i ON c.batch = i.batch WHERE i.running - i.amount < c.amount""")
def win_allocation_fill(spark, sf):
    """Narrow form, as its SQL fixes it: a batch's largest credit is poured over its invoices in order; ``win_allocation_pour`` pours all."""
    from pyspark.sql import Window

    c, i, _ = _batched(spark, sf)
    largest = c.groupBy("batch").agg(F.min(F.struct((-F.col("amount")).alias("neg"), "credit_id")).alias("x")).select("batch", F.col("x.credit_id").alias("credit_id"), (-F.col("x.neg")).alias("credit"))
    before = Window.partitionBy("batch").orderBy("amount", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    inv = i.withColumn("before", F.coalesce(F.sum("amount").over(before), F.lit(0)))
    j = inv.join(largest, "batch").withColumn("applied", F.greatest(F.lit(0).cast("decimal(28,2)"), F.least(F.col("amount").cast("decimal(28,2)"), (F.col("credit") - F.col("before")).cast("decimal(28,2)"))))
    return j.where("applied > 0").select("credit_id", "doc_id", F.col("applied").cast("decimal(18,2)").alias("applied"))


@query("win_allocation_pour", w(DOCS, CREDITS, BATCHED) + """SELECT c.credit_id, i.doc_id, CAST(least(c.running, i.running) - greatest(c.running - c.amount, i.running - i.amount) AS DECIMAL(18,2)) AS applied
  FROM (SELECT *, sum(amount) OVER (PARTITION BY batch ORDER BY amount DESC, credit_id) AS running FROM bc) c JOIN bi i ON c.batch = i.batch WHERE least(c.running, i.running) > greatest(c.running - c.amount, i.running - i.amount)""")
def win_allocation_pour(spark, sf):
    """Every credit of a batch is poured over its invoices in order, the largest first."""
    c, i, _ = _batched(spark, sf)
    return cr.pour(c, i)


@query("win_credit_order", w(DOCS, CREDITS, BATCHED) + "SELECT credit_id, CAST(row_number() OVER (PARTITION BY batch ORDER BY amount DESC, credit_id) AS INT) AS turn FROM bc")
def win_credit_order(spark, sf):
    from pyspark.sql import Window

    c, _, _ = _batched(spark, sf)
    return c.select("credit_id", F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("amount"), "credit_id")).alias("turn"))


@query("grp_credit_match_batch")
def grp_credit_match_batch(spark, sf):
    c, i, _ = _batched(spark, sf)
    return cr.match_batches(c, i)


def _settled(spark, sf):
    c, i, docs = _batched(spark, sf)
    return cr.settle(cr.match_batches(c, i, linked=True), docs.select("doc_id", "doc_type", "amount")), docs


@query("grp_settlement")
def grp_settlement(spark, sf):
    return _settled(spark, sf)[0]


EDGES = "edges AS (SELECT credit_id AS a, ref_number AS b FROM credits WHERE ref_number IS NOT NULL)"


@query("grp_components", "WITH RECURSIVE " + ", ".join((DOCS, CREDITS, EDGES)) + ", both_ AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach AS (SELECT a AS node, a AS r FROM both_ UNION SELECT reach.node, both_.b FROM reach JOIN both_ ON reach.r = both_.a) SELECT node, min(r) AS component FROM reach GROUP BY node")
def grp_components(spark, sf):
    c = fx.credits(fx.documents(spark, sf)).where("ref_number is not null")
    return cr.connected(c.select(F.col("credit_id").alias("a"), F.col("ref_number").alias("b")))


@query("grp_engine")
def grp_engine(spark, sf):
    """Settlement groups with their decision: accept, match, net, decide, export."""
    c, i, _ = _batched(spark, sf)
    return cr.decided_groups(fx.rows(spark, sf), c, i)


@query("grp_legacy_payments", FULL + "SELECT doc_id, decision, reason_code, payable, CAST('legacy' AS VARCHAR) AS pipeline FROM decided WHERE doc_type='invoice' AND match_status IN ('matched','new','confirmed','reviewed') AND supplier_name <> ''")
def grp_legacy_payments(spark, sf):
    """One payment per accepted invoice, for batches without credits."""
    rows = decisions.accept(fx.rows(spark, sf).where("doc_type = 'invoice'")).where("reject_reason is null")
    return decisions.decide(decisions.with_payable(rows)).select("doc_id", "decision", "reason_code", "payable", F.lit("legacy").alias("pipeline"))


@query("grp_ownership", w(DOCS, CREDITS) + "SELECT doc_id, CAST(n AS BIGINT) AS owners FROM (SELECT d.doc_id, (SELECT count(*) FROM credits c WHERE c.ref_number = d.doc_id) AS n FROM docs d WHERE doc_type='invoice') WHERE n <> 1")
def grp_ownership(spark, sf):
    """Invoices that no credit or several credits claim."""
    docs = fx.documents(spark, sf)
    claims = fx.credits(docs).where("ref_number is not null").groupBy(F.col("ref_number").alias("doc_id")).agg(F.count("*").alias("n"))
    return docs.where("doc_type = 'invoice'").join(claims, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("owners")).where("owners <> 1")


@query("snk_supplier_upsert", w(SUP) + """SELECT coalesce(a.iban, b.iban) AS iban, coalesce(a.supplier_name, b.supplier_name) AS supplier_name, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN a.iban IS NULL THEN CAST([] AS VARCHAR[]) ELSE [concat('a', CAST(a.supplier_id % 7 AS VARCHAR))] END, CASE WHEN b.iban IS NULL THEN CAST([] AS VARCHAR[]) ELSE [concat('a', CAST(b.supplier_id % 5 AS VARCHAR))] END))), ',') AS aliases, coalesce(a.term_days, b.term_days) AS term_days, a.iban IS NULL AS added
  FROM (SELECT * FROM sup WHERE supplier_id % 3 <> 0) a FULL JOIN (SELECT * FROM sup WHERE supplier_id % 2 = 0) b ON a.iban = b.iban""")
def snk_supplier_upsert(spark, sf):
    s = fx.suppliers(spark, sf)
    alias = lambda n: F.array(F.concat(F.lit("a"), (F.col("supplier_id") % n).cast("string"))).alias("aliases")
    out = suppliers.upsert(s.where("supplier_id % 3 <> 0").select("iban", "supplier_name", alias(7), "term_days"), s.where("supplier_id % 2 = 0").select("iban", "supplier_name", alias(5), "term_days"))
    return out.withColumn("aliases", F.array_join("aliases", ","))


_ = (PAY, DECIDED, m)
