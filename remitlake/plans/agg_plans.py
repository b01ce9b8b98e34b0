"""Aggregations, windows, orderings, set operations and the quality analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import decisions
from ..sources import fixtures as fx
from ..sources.shared import checkpointed
from .book import query
from .fixture_sql import ATTEMPTS, DOCS, ROWS, SUP, TEXTS, w
from .rows_plans import FULL


def _decided(spark, sf):
    return decisions.decide(decisions.with_payable(fx.rows(spark, sf).where("doc_type = 'invoice'")))


@query("agg_error_buckets", w(SUP, DOCS, ROWS) + """SELECT reason AS reject_reason, supplier_name, count(*) AS n_docs, CAST(sum(amount) AS DECIMAL(28,2)) AS amount FROM (SELECT *, CASE WHEN match_status='load_failed' THEN CASE WHEN load_error='no_text' THEN 'pdf_no_text' ELSE 'pdf_read_failed' END
  WHEN match_status IN ('matched','new','confirmed','reviewed') THEN CASE WHEN supplier_name='' THEN 'missing_supplier_name' END WHEN match_status='no_hint' THEN 'no_supplier_hint' WHEN match_status='needs_review' THEN 'needs_review' ELSE 'unmatched_supplier' END AS reason FROM rws) WHERE reason IS NOT NULL GROUP BY 1, 2""")
def agg_error_buckets(spark, sf):
    return decisions.error_buckets(decisions.accept(fx.rows(spark, sf)).where("reject_reason is not null"))


@query("agg_supplier_group", w(SUP, DOCS, ROWS) + "SELECT lower(trim(supplier_name)) AS supplier, count(*) AS n, count(*) FILTER (WHERE doc_type='credit_note') AS n_credits, CAST(sum(amount) AS DECIMAL(28,2)) AS total FROM rws GROUP BY 1")
def agg_supplier_group(spark, sf):
    return fx.rows(spark, sf).groupBy(F.lower(F.trim("supplier_name")).alias("supplier")).agg(F.count("*").alias("n"), F.count_if(F.col("doc_type") == "credit_note").alias("n_credits"), F.sum("amount").cast("decimal(28,2)").alias("total"))


@query("agg_iban_ambiguity", w(SUP, DOCS, ROWS) + "SELECT supplier_name, iban AS pdf_iban, max(db_iban) AS db_iban, count(*) AS invoice_count, string_agg(source_file, ',' ORDER BY source_file) AS files FROM rws WHERE iban <> db_iban AND supplier_name <> '' GROUP BY 1, 2")
def agg_iban_ambiguity(spark, sf):
    r = fx.rows(spark, sf).where("iban <> db_iban and supplier_name <> ''")
    return r.groupBy("supplier_name", F.col("iban").alias("pdf_iban")).agg(F.max("db_iban").alias("db_iban"), F.count("*").alias("invoice_count"), F.array_join(F.array_sort(F.collect_list("source_file")), ",").alias("files"))


@query("agg_group_decision", FULL + "SELECT supplier_id, CASE WHEN bool_or(decision='excluded') THEN 'excluded' WHEN bool_or(decision='needs_review') THEN 'needs_review' ELSE 'included' END AS decision, coalesce(min_by(reason_code, doc_id) FILTER (WHERE decision='excluded'), min_by(reason_code, doc_id) FILTER (WHERE decision='needs_review'), 'export_allowed') AS reason_code FROM decided WHERE doc_type='invoice' GROUP BY supplier_id, year(doc_date), month(doc_date)")
def agg_group_decision(spark, sf):
    """The worst decision of a supplier's month, from its first row of that kind."""
    first = lambda kind: F.min(F.when(F.col("decision") == kind, F.struct("doc_id", "reason_code")))["reason_code"]
    g = _decided(spark, sf).groupBy("supplier_id", F.year("doc_date").alias("y"), F.month("doc_date").alias("mo")).agg(first("excluded").alias("x"), first("needs_review").alias("r"))
    return g.select("supplier_id", F.when(F.col("x").isNotNull(), "excluded").when(F.col("r").isNotNull(), "needs_review").otherwise("included").alias("decision"), F.coalesce("x", "r", F.lit("export_allowed")).alias("reason_code"))


@query("agg_primary_invoice", FULL + "SELECT supplier_id, CAST(year(doc_date) AS INT) AS y, doc_id, payable FROM (SELECT *, row_number() OVER (PARTITION BY supplier_id, year(doc_date) ORDER BY payable DESC, doc_id) AS n FROM decided WHERE doc_type='invoice') WHERE n = 1")
def agg_primary_invoice(spark, sf):
    g = _decided(spark, sf).groupBy("supplier_id", F.year("doc_date").alias("y")).agg(F.min(F.struct((-F.col("payable")).alias("neg"), "doc_id")).alias("x"))
    return g.select("supplier_id", "y", F.col("x.doc_id").alias("doc_id"), (-F.col("x.neg")).cast("decimal(18,2)").alias("payable"))


@query("agg_group_output", FULL + "SELECT supplier_id, CAST(year(doc_date) AS INT) AS y, CAST(sum(payable) AS DECIMAL(28,2)) AS amount, min(iban) AS iban, count(*) AS n, bool_or(requires) AS requires_rerun FROM (SELECT *, decision='needs_review' AS requires FROM decided WHERE doc_type='invoice') GROUP BY 1, 2")
def agg_group_output(spark, sf):
    return _decided(spark, sf).groupBy("supplier_id", F.year("doc_date").alias("y")).agg(F.sum("payable").cast("decimal(28,2)").alias("amount"), F.min("iban").alias("iban"), F.count("*").alias("n"), F.bool_or("requires_rerun").alias("requires_rerun"))


@query("agg_export_gate", FULL + """SELECT CAST(sum(n) AS BIGINT) AS payment_count, CAST(sum(a) AS BIGINT) AS ambiguous_count, CAST(sum(f) AS BIGINT) AS failed_count, CAST(sum(i) AS BIGINT) AS invalid_amount_count, bool_or(iban <> '' AND n >= 2) AS duplicate_risk, CASE WHEN sum(a) + sum(f) + sum(i) > 0 THEN 'blocked' WHEN bool_or(iban <> '' AND n >= 2) THEN 'warning' ELSE 'valid' END AS gate
  FROM (SELECT coalesce(iban,'') AS iban, payable, count(*) AS n, count(*) FILTER (WHERE amount_status='ambiguous') AS a, count(*) FILTER (WHERE amount_status='failed') AS f, count(*) FILTER (WHERE payable <= 0) AS i FROM decided WHERE doc_type='invoice' GROUP BY 1, 2)""")
def agg_export_gate(spark, sf):
    return decisions.export_gate(_decided(spark, sf).withColumn("amount", F.col("payable")))


@query("agg_batch_totals", FULL + "SELECT CAST(year(doc_date) AS INT) AS y, CAST(month(doc_date) AS INT) AS mo, count(*) AS n, CAST(sum(payable) AS DECIMAL(28,2)) AS control_sum FROM decided WHERE doc_type='invoice' AND decision='included' GROUP BY ROLLUP (y, mo)")
def agg_batch_totals(spark, sf):
    """Counts and control sums per month, per year and overall."""
    p = _decided(spark, sf).where("decision = 'included'")
    return p.rollup(F.year("doc_date").alias("y"), F.month("doc_date").alias("mo")).agg(F.count("*").alias("n"), F.sum("payable").cast("decimal(28,2)").alias("control_sum"))


@query("agg_status_counts", w(SUP, DOCS, ROWS) + "SELECT match_status, count(*) FILTER (WHERE amount_status='confirmed') AS confirmed, count(*) FILTER (WHERE amount_status='tentative') AS tentative, count(*) FILTER (WHERE amount_status='ambiguous') AS ambiguous, count(*) FILTER (WHERE amount_status='failed') AS failed FROM rws GROUP BY 1")
def agg_status_counts(spark, sf):
    kinds = ["confirmed", "tentative", "ambiguous", "failed"]
    return fx.rows(spark, sf).groupBy("match_status").pivot("amount_status", kinds).count().na.fill(0)


@query("agg_vat_rate_mode", "SELECT source, rate, n FROM (SELECT source, rate, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, rate DESC) AS k FROM (SELECT source, CAST(unnest(regexp_extract_all(text, '([0-9]{1,2}) ', 1)) AS INT) AS rate FROM documents) WHERE rate BETWEEN 1 AND 30 GROUP BY 1, 2) WHERE k = 1")
def agg_vat_rate_mode(spark, sf):
    """The most frequent percentage of a group's texts; the larger one of equals."""
    d = fx.table(spark, sf, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit("([0-9]{1,2}) "), F.lit(1)).cast("array<int>")).alias("rate"))
    n = d.where("rate between 1 and 30").groupBy("source", "rate").agg(F.count("*").alias("n"))
    best = n.groupBy("source").agg(F.max(F.struct("n", "rate")).alias("x"))
    return best.select("source", F.col("x.rate").alias("rate"), F.col("x.n").alias("n"))


@query("agg_cent_groups", w(DOCS) + "SELECT supplier_id, doc_date, floor(amount / 1000) AS band, count(*) AS n, min(amount) AS first_amount FROM docs GROUP BY 1, 2, 3")
def agg_cent_groups(spark, sf):
    return fx.documents(spark, sf).groupBy("supplier_id", "doc_date", F.floor(F.col("amount").cast("double") / 1000).cast("double").alias("band")).agg(F.count("*").alias("n"), F.min("amount").alias("first_amount"))


@query("agg_order_distinct", w(SUP, DOCS, ROWS) + "SELECT supplier_id, string_agg(match_status, ',' ORDER BY first_pos) AS statuses FROM (SELECT supplier_id, match_status, min(order_id) AS first_pos FROM rws GROUP BY 1, 2) GROUP BY 1")
def agg_order_distinct(spark, sf):
    """Distinct statuses in the order of their first document."""
    g = fx.rows(spark, sf).groupBy("supplier_id", "match_status").agg(F.min("order_id").alias("p"))
    return g.groupBy("supplier_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "match_status"))), lambda x: x["match_status"]), ",").alias("statuses"))


@query("agg_batch_fingerprint", w(DOCS) + "SELECT supplier_id, sha256(string_agg(concat_ws(':', doc_id, CAST(amount AS VARCHAR)), '|' ORDER BY doc_id)) AS fingerprint FROM docs GROUP BY 1")
def agg_batch_fingerprint(spark, sf):
    item = F.concat_ws(":", "doc_id", F.col("amount").cast("string"))
    g = fx.documents(spark, sf).groupBy("supplier_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("i")))).alias("a"))
    return g.select("supplier_id", F.sha2(F.array_join(F.col("a.i"), "|"), 256).alias("fingerprint"))


@query("agg_determinism", w(DOCS) + "SELECT supplier_id, TRUE AS same FROM docs GROUP BY 1")
def agg_determinism(spark, sf):
    """A batch's fingerprint over three partitionings."""
    d = fx.documents(spark, sf)
    prints = []
    for k, parts in enumerate((d, d.repartition(7, "doc_id"), d.repartition(3, "order_id"))):
        prints.append(parts.groupBy("supplier_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("doc_id")), "|"), 256).alias(f"p{k}")))
    j = prints[0].join(prints[1], "supplier_id").join(prints[2], "supplier_id")
    return j.select("supplier_id", ((F.col("p0") == F.col("p1")) & (F.col("p1") == F.col("p2"))).alias("same"))


TRACKED = "dd AS (SELECT *, row_number() OVER () AS z FROM (SELECT doc_id, source_file, supplier_id, order_id, 0 AS k FROM rws UNION ALL SELECT doc_id, source_file, supplier_id, order_id, 1 FROM rws WHERE order_id % 20 = 0 UNION ALL SELECT doc_id, concat('copy-', source_file), supplier_id, order_id, 2 FROM rws WHERE order_id % 33 = 0))"


@query("win_dedup_docs", w(SUP, DOCS, ROWS) + "SELECT doc_id, source_file FROM rws")
def win_dedup_docs(spark, sf):
    """Repeated files, and copies of a document under another file name, come down to the first."""
    r = fx.rows(spark, sf).select("doc_id", "source_file", "order_id", F.col("supplier_id").cast("string").alias("hint"), F.col("doc_id").alias("invoice_number"))
    again = r.where("order_id % 20 = 0").withColumn("k", F.lit(1))
    copies = r.where("order_id % 33 = 0").withColumn("source_file", F.concat(F.lit("copy-"), "source_file")).withColumn("k", F.lit(2))
    all_ = r.withColumn("k", F.lit(0)).unionByName(again).unionByName(copies).withColumn("input_pos", F.struct("k", "order_id", "doc_id"))
    return decisions.first_documents(all_).select("doc_id", "source_file")


@query("win_amount_outlier", w(DOCS) + "SELECT doc_id, amount * 1.5 <= mx AND amount < mx AS demoted FROM (SELECT *, max(amount) OVER (PARTITION BY order_id) AS mx FROM docs)")
def win_amount_outlier(spark, sf):
    top = F.max("amount").over(Window.partitionBy("order_id"))
    return fx.documents(spark, sf).withColumn("mx", top).select("doc_id", ((F.col("amount") * F.lit(1.5).cast("decimal(2,1)") <= F.col("mx")) & (F.col("amount") < F.col("mx"))).alias("demoted"))


@query("win_dominant", w(ATTEMPTS) + "SELECT doc_id, field_id, attempt_id, confidence_pct >= 85 AND confidence_pct - coalesce(nxt, 0) >= 20 AS dominant FROM (SELECT *, row_number() OVER q AS n, lead(confidence_pct) OVER q AS nxt FROM attempts WINDOW q AS (PARTITION BY doc_id, field_id ORDER BY confidence_pct DESC, attempt_id)) WHERE n = 1")
def win_dominant(spark, sf):
    q = Window.partitionBy("doc_id", "field_id").orderBy(F.desc("confidence_pct"), "attempt_id")
    a = fx.attempts(spark, sf).withColumns({"n": F.row_number().over(q), "nxt": F.lead("confidence_pct").over(q)}).where("n = 1")
    return a.select("doc_id", "field_id", "attempt_id", ((F.col("confidence_pct") >= 85) & (F.col("confidence_pct") - F.coalesce("nxt", F.lit(0)) >= 20)).alias("dominant"))


@query("win_runner_up", w(ATTEMPTS) + "SELECT doc_id, field_id, attempt_id AS winner, nxt AS runner_up, CASE WHEN nxt IS NULL THEN 'only_candidate' WHEN confidence_pct > ncf THEN 'confidence' ELSE 'order' END AS reason FROM (SELECT *, row_number() OVER q AS n, lead(attempt_id) OVER q AS nxt, lead(confidence_pct) OVER q AS ncf FROM attempts WHERE status='valid' WINDOW q AS (PARTITION BY doc_id, field_id ORDER BY confidence_pct DESC, attempt_id)) WHERE n = 1")
def win_runner_up(spark, sf):
    q = Window.partitionBy("doc_id", "field_id").orderBy(F.desc("confidence_pct"), "attempt_id")
    a = fx.attempts(spark, sf).where("status = 'valid'").withColumns({"n": F.row_number().over(q), "nxt": F.lead("attempt_id").over(q), "ncf": F.lead("confidence_pct").over(q)}).where("n = 1")
    reason = F.when(F.col("nxt").isNull(), "only_candidate").when(F.col("confidence_pct") > F.col("ncf"), "confidence").otherwise("order")
    return a.select("doc_id", "field_id", F.col("attempt_id").alias("winner"), F.col("nxt").alias("runner_up"), reason.alias("reason"))


@query("win_candidate_dedupe", w(ATTEMPTS) + "SELECT doc_id, field_id, strategy, max(confidence_pct) AS confidence_pct FROM attempts GROUP BY 1, 2, 3")
def win_candidate_dedupe(spark, sf):
    q = Window.partitionBy("doc_id", "field_id", "strategy").orderBy(F.desc("confidence_pct"), "attempt_id")
    return fx.attempts(spark, sf).withColumn("n", F.row_number().over(q)).where("n = 1").select("doc_id", "field_id", "strategy", "confidence_pct")


@query("win_strategy_pick", w(ATTEMPTS) + "SELECT doc_id, field_id, attempt_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field_id ORDER BY confidence_pct DESC, strategy, attempt_id) AS n FROM attempts WHERE status='valid') WHERE n = 1")
def win_strategy_pick(spark, sf):
    q = Window.partitionBy("doc_id", "field_id").orderBy(F.desc("confidence_pct"), "strategy", "attempt_id")
    return fx.attempts(spark, sf).where("status = 'valid'").withColumn("n", F.row_number().over(q)).where("n = 1").select("doc_id", "field_id", "attempt_id")


@query("win_line_context", w(SUP, DOCS, TEXTS) + "SELECT doc_id, line_no, line, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_line FROM (SELECT doc_id, CAST(unnest(range(8)) AS INT) AS line_no, unnest(string_split(text, chr(10))) AS line FROM texts)")
def win_line_context(spark, sf):
    lines = fx.texts(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumn("next_line", F.lead("line").over(Window.partitionBy("doc_id").orderBy("line_no")))


STATS = "stats AS (SELECT field_id, strategy, count(*) AS attempts, count(*) FILTER (WHERE status='valid') AS wins, CAST(sum(confidence_pct) AS BIGINT) AS conf FROM attempts GROUP BY 1, 2)"


def _stats(spark, sf):
    return fx.attempts(spark, sf).groupBy("field_id", "strategy").agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "valid").alias("wins"), F.sum("confidence_pct").alias("conf"))


@query("agg_strategy_stats", w(ATTEMPTS, STATS) + "SELECT field_id, strategy, attempts, wins, round(conf / attempts, 4) AS avg_confidence FROM stats")
def agg_strategy_stats(spark, sf):
    return _stats(spark, sf).select("field_id", "strategy", "attempts", "wins", F.round(F.col("conf") / F.col("attempts"), 4).alias("avg_confidence"))


@query("agg_strategy_matrix", w(ATTEMPTS, STATS) + "SELECT f.field_id, r.strategy, coalesce(s.attempts, 0) AS attempts, round(coalesce(s.wins / s.attempts, 0), 4) AS win_rate FROM (SELECT DISTINCT field_id FROM attempts) f CROSS JOIN (SELECT concat('s', CAST(i AS VARCHAR)) AS strategy FROM range(8) t(i)) r LEFT JOIN stats s ON s.field_id = f.field_id AND s.strategy = r.strategy")
def agg_strategy_matrix(spark, sf):
    """Every registered strategy of every field, tried or not."""
    s = _stats(spark, sf)
    fields = s.select("field_id").distinct().withColumn("strategy", F.explode(F.array(*[F.lit(f"s{i}") for i in range(8)])))
    j = fields.join(s, ["field_id", "strategy"], "left")
    return j.select("field_id", "strategy", F.coalesce("attempts", F.lit(0)).alias("attempts"), F.round(F.coalesce(F.col("wins") / F.col("attempts"), F.lit(0.0)), 4).alias("win_rate"))


@query("agg_field_metrics", w(ATTEMPTS) + "SELECT field_id, count(*) AS n, round(100.0 * count(*) FILTER (WHERE status='valid') / count(*), 2) AS success_pct, count(*) FILTER (WHERE status='valid' AND confidence_pct < 40) AS fragile_wins, round(CAST(sum(confidence_pct) AS DOUBLE) / count(*), 4) AS avg_confidence FROM attempts GROUP BY 1")
def agg_field_metrics(spark, sf):
    valid = F.col("status") == "valid"
    return fx.attempts(spark, sf).groupBy("field_id").agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(valid) / F.count("*"), 2).alias("success_pct"), F.count_if(valid & (F.col("confidence_pct") < 40)).alias("fragile_wins"), F.round(F.sum("confidence_pct") / F.count("*"), 4).alias("avg_confidence"))


PATTERNS = "CASE WHEN status='invalid' AND confidence_pct >= 70 THEN 'confident_but_wrong' END, CASE WHEN status='skipped' THEN 'never_tried' END, CASE WHEN confidence_pct < 30 THEN 'weak' END, CASE WHEN strategy='s5' THEN 'fallback' END"


@query("agg_failure_patterns", w(ATTEMPTS) + f"SELECT pattern, count(*) AS frequency, string_agg(DISTINCT field_id, ',' ORDER BY field_id) AS fields, array_to_string(list_sort(list(attempt_id))[1:5], ',') AS examples FROM (SELECT *, unnest([{PATTERNS}]) AS pattern FROM attempts) WHERE pattern IS NOT NULL GROUP BY 1")
def agg_failure_patterns(spark, sf):
    """Overlapping patterns with their frequency, fields and the first five examples."""
    tags = F.array_compact(F.array(
        F.when((F.col("status") == "invalid") & (F.col("confidence_pct") >= 70), "confident_but_wrong"), F.when(F.col("status") == "skipped", "never_tried"),
        F.when(F.col("confidence_pct") < 30, "weak"), F.when(F.col("strategy") == "s5", "fallback"),
    ))
    tagged = fx.attempts(spark, sf).select("attempt_id", "field_id", F.explode(tags).alias("pattern"))
    first = tagged.withColumn("n", F.row_number().over(Window.partitionBy("pattern").orderBy("attempt_id"))).where("n <= 5").groupBy("pattern").agg(F.array_join(F.array_sort(F.collect_list("attempt_id")).cast("array<string>"), ",").alias("examples"))
    g = tagged.groupBy("pattern").agg(F.count("*").alias("frequency"), F.array_join(F.array_sort(F.collect_set("field_id")), ",").alias("fields"))
    return g.join(first, "pattern")


SNAP = "a AS (SELECT doc_id, field_id, attempt_id, strategy, confidence_pct AS c FROM attempts WHERE attempt_id % 10 <> 1), b AS (SELECT doc_id, field_id, attempt_id, CASE WHEN attempt_id % 7 = 0 THEN 's9' ELSE strategy END AS strategy, CASE WHEN attempt_id % 9 = 0 THEN confidence_pct + 5 ELSE confidence_pct END AS c FROM attempts WHERE attempt_id % 10 <> 2)"
DRIFT = "drift AS (SELECT coalesce(a.attempt_id, b.attempt_id) AS attempt_id, coalesce(a.field_id, b.field_id) AS field_id, unnest(CASE WHEN b.attempt_id IS NULL THEN ['missing'] WHEN a.attempt_id IS NULL THEN ['extra'] ELSE [CASE WHEN a.strategy <> b.strategy THEN 'winner' END, CASE WHEN abs(a.c - b.c) > 2 THEN 'confidence' END] END) AS drift FROM a FULL JOIN b ON a.attempt_id = b.attempt_id)"


def _drift(spark, sf):
    t, k = fx.attempts(spark, sf), F.col("attempt_id")
    a = t.where(k % 10 != 1).select(k, "field_id", "strategy", F.col("confidence_pct").alias("c")).alias("a")
    b = t.where(k % 10 != 2).select(k, "field_id", F.when(k % 7 == 0, "s9").otherwise(F.col("strategy")).alias("strategy"), F.when(k % 9 == 0, F.col("confidence_pct") + 5).otherwise(F.col("confidence_pct")).alias("c")).alias("b")
    j = a.join(b, F.col("a.attempt_id") == F.col("b.attempt_id"), "full_outer")
    both = F.array_compact(F.array(F.when(F.col("a.strategy") != F.col("b.strategy"), "winner"), F.when(F.abs(F.col("a.c") - F.col("b.c")) > 2, "confidence")))
    kinds = F.when(F.col("b.attempt_id").isNull(), F.array(F.lit("missing"))).when(F.col("a.attempt_id").isNull(), F.array(F.lit("extra"))).otherwise(both)
    return j.select(F.coalesce("a.attempt_id", "b.attempt_id").alias("attempt_id"), F.coalesce("a.field_id", "b.field_id").alias("field_id"), F.explode(kinds).alias("drift"))


@query("jn_snapshot_diff", w(ATTEMPTS, SNAP, DRIFT) + "SELECT attempt_id, field_id, drift FROM drift WHERE drift IS NOT NULL")
def jn_snapshot_diff(spark, sf):
    return _drift(spark, sf)


@query("agg_drift_report", w(ATTEMPTS, SNAP, DRIFT) + "SELECT field_id, drift, count(*) AS n FROM drift WHERE drift IS NOT NULL GROUP BY GROUPING SETS ((field_id), (drift))")
def agg_drift_report(spark, sf):
    d = _drift(spark, sf)
    return d.groupingSets([[F.col("field_id")], [F.col("drift")]], F.col("field_id"), F.col("drift")).agg(F.count("*").alias("n"))


@query("topk_broken", w(ATTEMPTS, SNAP, DRIFT) + "SELECT field_id, count(*) AS n FROM drift WHERE drift = 'winner' GROUP BY 1 ORDER BY n DESC, field_id LIMIT 10")
def topk_broken(spark, sf):
    return _drift(spark, sf).where("drift = 'winner'").groupBy("field_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field_id").limit(10)


FRAG = "frag AS (SELECT field_id, strategy, wins, round(1 - wins / attempts, 4) AS fragility, round(wins / attempts, 4) AS win_rate FROM stats)"


def _fragility(spark, sf):
    rate = F.col("wins") / F.col("attempts")
    return _stats(spark, sf).select("field_id", "strategy", "wins", F.round(1 - rate, 4).alias("fragility"), F.round(rate, 4).alias("win_rate"))


@query("topk_fragile", w(ATTEMPTS, STATS, FRAG) + "SELECT field_id, strategy, round(wins * fragility, 4) AS weight FROM frag ORDER BY weight DESC, field_id, strategy LIMIT 10")
def topk_fragile(spark, sf):
    return _fragility(spark, sf).select("field_id", "strategy", F.round(F.col("wins") * F.col("fragility"), 4).alias("weight")).orderBy(F.desc("weight"), "field_id", "strategy").limit(10)


@query("topk_demotions", w(ATTEMPTS, STATS, FRAG) + "SELECT field_id, strategy, fragility FROM frag WHERE fragility > 0.7")
def topk_demotions(spark, sf):
    return _fragility(spark, sf).where("fragility > 0.7").select("field_id", "strategy", "fragility").orderBy(F.desc("fragility"), "field_id", "strategy")


@query("win_strategy_order", w(ATTEMPTS, STATS, FRAG) + "SELECT field_id, strategy, CAST(row_number() OVER (PARTITION BY field_id ORDER BY fragility > 0.7, win_rate DESC, fragility, strategy) AS INT) AS place FROM frag")
def win_strategy_order(spark, sf):
    q = Window.partitionBy("field_id").orderBy(F.col("fragility") > 0.7, F.desc("win_rate"), "fragility", "strategy")
    return _fragility(spark, sf).select("field_id", "strategy", F.row_number().over(q).alias("place"))


@query("agg_semantic_trigger", w(ATTEMPTS, STATS, FRAG) + "SELECT round(sum(CASE WHEN strategy='s5' THEN wins ELSE 0 END) / sum(wins), 4) AS fallback_share, round(max(fragility), 4) AS top_fragility, sum(CASE WHEN strategy='s5' THEN wins ELSE 0 END) / sum(wins) > 0.4 OR max(fragility) > 0.4 AS adjusted FROM frag")
def agg_semantic_trigger(spark, sf):
    share = F.sum(F.when(F.col("strategy") == "s5", F.col("wins")).otherwise(0)) / F.sum("wins")
    return _fragility(spark, sf).agg(F.round(share, 4).alias("fallback_share"), F.round(F.max("fragility"), 4).alias("top_fragility"), ((share > 0.4) | (F.max("fragility") > 0.4)).alias("adjusted"))


@query("fn_fragility", w(ATTEMPTS) + "SELECT attempt_id, greatest(CAST(status='invalid' AS INT), CAST(confidence_pct < 40 AS INT), CAST(strategy='s5' AS INT), CAST(status='skipped' AS INT)) AS fragility FROM attempts")
def fn_fragility(spark, sf):
    parts = [F.col("status") == "invalid", F.col("confidence_pct") < 40, F.col("strategy") == "s5", F.col("status") == "skipped"]
    return fx.attempts(spark, sf).select("attempt_id", F.greatest(*[p.cast("int") for p in parts]).alias("fragility"))


@query("srt_payments", FULL + "SELECT doc_id, payable FROM decided WHERE doc_type='invoice'")
def srt_payments(spark, sf):
    return _decided(spark, sf).orderBy(F.lower("doc_id"), F.lower("supplier_name"), F.col("payable").cast("string")).select("doc_id", "payable")


@query("srt_groups", w(SUP, DOCS, ROWS) + "SELECT supplier_name, doc_id FROM rws WHERE doc_type='invoice'")
def srt_groups(spark, sf):
    return fx.rows(spark, sf).where("doc_type = 'invoice'").orderBy(F.lower("supplier_name"), F.lower("doc_id")).select("supplier_name", "doc_id")


@query("srt_ui_amount", w(DOCS) + "SELECT doc_id, CAST(row_number() OVER (ORDER BY amount DESC, doc_date, doc_id) AS INT) AS place FROM docs QUALIFY place <= 100")
def srt_ui_amount(spark, sf):
    """Narrow form, as its SQL fixes it: the first hundred by amount and date; ``srt_ui_amount_all`` places all documents."""
    top = fx.documents(spark, sf).orderBy(F.desc("amount"), "doc_date", "doc_id").limit(100)
    return top.select("doc_id", F.row_number().over(Window.orderBy(F.desc("amount"), "doc_date", "doc_id")).alias("place"))


def _placed(rows, order):
    """``rows`` with ``place`` in the whole order: ranges in order, then places within each after those of the ranges before."""
    dealt = checkpointed(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = dealt.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__within", within).join(F.broadcast(starts), "__part").withColumn("place", F.col("__start") + F.col("__within")).drop("__part", "__within", "__start")


@query("srt_ui_amount_all", w(DOCS) + "SELECT doc_id, row_number() OVER (ORDER BY amount DESC, doc_date, doc_id) AS place FROM docs")
def srt_ui_amount_all(spark, sf):
    """All documents by amount and date as typed columns, as a table view sorts them."""
    return _placed(fx.documents(spark, sf), (F.desc("amount"), F.asc("doc_date"), F.asc("doc_id"))).select("doc_id", "place").orderBy("place")


@query("set_candidate_union", w(SUP, DOCS, ROWS) + "SELECT doc_id, iban AS value, 'text' AS source FROM rws WHERE iban IS NOT NULL UNION ALL SELECT doc_id, db_iban, 'master' FROM rws")
def set_candidate_union(spark, sf):
    r = fx.rows(spark, sf)
    return r.where("iban is not null").select("doc_id", F.col("iban").alias("value"), F.lit("text").alias("source")).unionByName(r.select("doc_id", F.col("db_iban").alias("value"), F.lit("master").alias("source")))


@query("set_merge_iban", w(SUP, DOCS, ROWS) + "SELECT doc_id, value, min(prio) AS prio FROM (SELECT doc_id, iban AS value, 0 AS prio FROM rws WHERE iban IS NOT NULL UNION ALL SELECT doc_id, db_iban, 1 FROM rws) GROUP BY 1, 2")
def set_merge_iban(spark, sf):
    r = fx.rows(spark, sf)
    both = r.where("iban is not null").select("doc_id", F.col("iban").alias("value"), F.lit(0).alias("prio")).unionByName(r.select("doc_id", F.col("db_iban").alias("value"), F.lit(1).alias("prio")))
    return both.groupBy("doc_id", "value").agg(F.min("prio").alias("prio"))


@query("set_keys_diff", w(DOCS) + "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NOT NULL AS in_a, b.doc_id IS NOT NULL AS in_b FROM (SELECT doc_id FROM docs WHERE order_id % 3 <> 0) a FULL JOIN (SELECT doc_id FROM docs WHERE order_id % 4 <> 0) b ON a.doc_id = b.doc_id")
def set_keys_diff(spark, sf):
    d = fx.documents(spark, sf)
    a, b = d.where("order_id % 3 <> 0").select("doc_id", F.lit(True).alias("in_a")), d.where("order_id % 4 <> 0").select("doc_id", F.lit(True).alias("in_b"))
    return a.join(b, "doc_id", "full_outer").na.fill(False)


@query("set_traits_missing", w(SUP, DOCS, ROWS) + "SELECT doc_id, concat_ws(',', CASE WHEN iban IS NULL THEN 'iban' END, CASE WHEN order_id % 3 <> 0 THEN 'vat' END) AS missing FROM rws")
def set_traits_missing(spark, sf):
    have = F.array_compact(F.array(F.when(F.col("iban").isNotNull(), "iban"), F.when(F.col("order_id") % 3 == 0, "vat")))
    return fx.rows(spark, sf).select("doc_id", F.array_join(F.array_except(F.array(F.lit("iban"), F.lit("vat")), have), ",").alias("missing"))


@query("set_merge_profiles", w(SUP) + "SELECT supplier_id, CASE WHEN supplier_id % 5 = 0 THEN 'old' ELSE 'new' END AS amount_rule, 'old' AS iban_rule, 'new' AS date_rule FROM sup")
def set_merge_profiles(spark, sf):
    """Existing rules stay, learned ones win, locked fields are skipped."""
    old, new = F.create_map(F.lit("amount"), F.lit("old"), F.lit("iban"), F.lit("old")), F.create_map(F.lit("amount"), F.lit("new"), F.lit("date"), F.lit("new"))
    learned = F.map_filter(new, lambda k, v: ~((k == "amount") & (F.col("supplier_id") % 5 == 0)))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(learned), k)), learned)
    return fx.suppliers(spark, sf).select("supplier_id", merged.alias("m")).select("supplier_id", F.col("m")["amount"].alias("amount_rule"), F.col("m")["iban"].alias("iban_rule"), F.col("m")["date"].alias("date_rule"))


EVENTS = "ev AS (SELECT user_id AS doc_id, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'remove' ELSE 'set' END AS action, event_id % 100 AS v FROM events)"


@query("snk_override_upsert", w(EVENTS) + "SELECT doc_id, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS n FROM ev) WHERE n = 1 AND action = 'set'")
def snk_override_upsert(spark, sf):
    """Current overrides from the append-only event table: the last event of a document counts."""
    e = fx.table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 == 0, "remove").otherwise("set").alias("action"), (F.col("event_id") % 100).alias("value"))
    last = e.groupBy("doc_id").agg(F.max_by(F.struct("action", "value"), "seq").alias("x"))
    return last.where("x.action = 'set'").select("doc_id", F.col("x.value").alias("value"))


@query("snk_approvals", w(EVENTS) + "SELECT doc_id, count(*) FILTER (WHERE action='set') AS n_set, max(seq) AS last_seq FROM ev GROUP BY 1")
def snk_approvals(spark, sf):
    return fx.table(spark, sf, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count_if(F.col("event_id") % 5 != 0).alias("n_set"), F.max("event_id").alias("last_seq"))


@query("snk_runs", "SELECT user_id, event_id AS run_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS parent_id, sha256(concat_ws('|', CAST(event_id AS VARCHAR), event_type)) AS run_hash FROM events")
def snk_runs(spark, sf):
    parent = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return fx.table(spark, sf, "events").select("user_id", F.col("event_id").alias("run_id"), parent.alias("parent_id"), F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256).alias("run_hash"))


@query("snk_sepa_rows", FULL + "SELECT doc_id AS end_to_end, left(supplier_name, 70) AS creditor, iban, payable AS amount, left(concat(customer_code, ' / ', doc_id), 140) AS remittance FROM decided WHERE doc_type='invoice' AND decision='included'")
def snk_sepa_rows(spark, sf):
    p = _decided(spark, sf).where("decision = 'included'")
    return p.select(F.col("doc_id").alias("end_to_end"), F.left("supplier_name", F.lit(70)).alias("creditor"), "iban", F.col("payable").alias("amount"), F.left(F.concat("customer_code", F.lit(" / "), "doc_id"), F.lit(140)).alias("remittance"))


@query("snk_sepa_batch", FULL + "SELECT doc_date AS execution_date, count(*) AS n_transactions, CAST(sum(payable) AS DECIMAL(28,2)) AS control_sum, min(doc_id) AS first_id FROM decided WHERE doc_type='invoice' AND decision='included' GROUP BY 1")
def snk_sepa_batch(spark, sf):
    """Head of the payment block of every execution date; its transactions are written by :mod:`remitlake.sources.transfers`."""
    p = _decided(spark, sf).where("decision = 'included'")
    return p.groupBy(F.col("doc_date").alias("execution_date")).agg(F.count("*").alias("n_transactions"), F.sum("payable").cast("decimal(28,2)").alias("control_sum"), F.min("doc_id").alias("first_id"))


@query("snk_export_log", FULL + "SELECT CAST(year(doc_date) AS INT) AS file_no, doc_id, payable AS amount, CAST(count(*) OVER (PARTITION BY year(doc_date)) AS BIGINT) AS n_payments FROM decided WHERE doc_type='invoice' AND decision='included'")
def snk_export_log(spark, sf):
    p = _decided(spark, sf).where("decision = 'included'").withColumn("file_no", F.year("doc_date"))
    totals = p.groupBy("file_no").agg(F.count("*").alias("n_payments"))
    return p.join(totals, "file_no").select("file_no", "doc_id", F.col("payable").alias("amount"), "n_payments")


@query("snk_golden", w(SUP, DOCS, ROWS) + "SELECT doc_id, CASE WHEN supplier_name = '' THEN concat('doc-', left(sha1(doc_id), 12)) ELSE concat(regexp_replace(lower(supplier_name), '[^a-z0-9]+', '-', 'g'), '-', lower(doc_id)) END AS name FROM rws")
def snk_golden(spark, sf):
    slug = F.regexp_replace(F.lower("supplier_name"), "[^a-z0-9]+", "-")
    return fx.rows(spark, sf).select("doc_id", F.when(F.col("supplier_name") == "", F.concat(F.lit("doc-"), F.left(F.sha1("doc_id"), F.lit(12)))).otherwise(F.concat(slug, F.lit("-"), F.lower("doc_id"))).alias("name"))
