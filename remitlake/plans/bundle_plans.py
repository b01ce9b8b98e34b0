"""The learning pass, and bundles of what it learned: written, read back and held against their contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bundles
from ..operators import learning_pass as lp
from ..sources import fixtures as fx
from ..sources.shared import new_path
from .book import query
from .fixture_sql import ATTEMPTS, w

FIELDS = ("click", "error", "purchase", "signup", "view")
REGISTRY = {f: tuple(f"s{i}" for i in range(6)) for f in FIELDS}
ROUNDS = 4

TRIED = "tried AS (SELECT doc_id, field_id, strategy, bool_or(status = 'valid') AS v FROM attempts WHERE status <> 'skipped' GROUP BY 1, 2, 3), rates AS (SELECT field_id, strategy, count(*) FILTER (WHERE v) / count(*) AS rate FROM tried GROUP BY 1, 2)"


def _won(k: str, order: str) -> str:
    """Winners of an order, and how many documents of a field it gets right."""
    return f"""w{k} AS (SELECT field_id, strategy, count(*) FILTER (WHERE NOT v) AS wrong, count(*) FILTER (WHERE v) AS good FROM (SELECT field_id, arg_min(strategy, place) AS strategy, arg_min(v, place) AS v FROM tried JOIN {order} USING (field_id, strategy) GROUP BY doc_id, field_id) GROUP BY 1, 2),
  c{k} AS (SELECT field_id, sum(good) AS correct FROM w{k} GROUP BY 1)"""


def _rounds() -> str:
    parts = ["o0 AS (SELECT field_id, strategy, row_number() OVER (PARTITION BY field_id ORDER BY strategy) AS place FROM (SELECT DISTINCT field_id, strategy FROM attempts))", _won("0", "o0")]
    for r in range(1, ROUNDS + 1):
        side = "LEFT JOIN rates USING (field_id, strategy)" if r == 1 else f"LEFT JOIN (SELECT field_id, arg_min(strategy, (-wrong, strategy)) AS worst FROM w{r - 1} WHERE wrong > 0 GROUP BY 1) USING (field_id)"
        key = "-coalesce(rate, -1), strategy" if r == 1 else "coalesce(strategy = worst, false), place"
        parts += [f"p{r} AS (SELECT field_id, strategy, row_number() OVER (PARTITION BY field_id ORDER BY {key}) AS place FROM o{r - 1} {side})", _won(f"p{r}", f"p{r}")]
        parts += [f"o{r} AS MATERIALIZED (SELECT o.field_id, o.strategy, CASE WHEN x.correct > y.correct THEN p.place ELSE o.place END AS place FROM o{r - 1} o JOIN p{r} p USING (field_id, strategy) JOIN cp{r} x USING (field_id) JOIN c{r - 1} y USING (field_id))", _won(str(r), f"o{r}")]
    return ", ".join(parts)


@query("ln_learning_pass", w(ATTEMPTS, TRIED) + ", " + _rounds() + f" SELECT field_id, string_agg(strategy, ',' ORDER BY place) AS strategies, CAST(any_value(b.correct) AS BIGINT) AS correct_before, CAST(any_value(a.correct) AS BIGINT) AS correct_after FROM o{ROUNDS} JOIN c0 b USING (field_id) JOIN c{ROUNDS} a USING (field_id) GROUP BY field_id")
def ln_learning_pass(spark, sf):
    """Orders after the rounds, with the documents that came out right before and after."""
    attempts = fx.attempts(spark, sf)
    start = attempts.select("field_id", "strategy").distinct().groupBy("field_id").agg(F.array_sort(F.collect_list("strategy")).alias("strategies"))
    states = lp.run(attempts, start, ROUNDS)
    return states.groupBy("field_id").agg(F.array_join(F.max_by("strategies", "round"), ",").alias("strategies"), F.min_by("correct", "round").alias("correct_before"), F.max_by("correct", "round").alias("correct_after"))


RANKED = "ranked AS (SELECT doc_id, field_id, strategy, count(*) FILTER (WHERE status = 'valid') / count(*) AS rate FROM attempts GROUP BY 1, 2, 3)"


def _built(spark, sf):
    """A bundle for every user: the strategies of each field by the user's own rate of success."""
    rate = F.count_if(F.col("status") == "valid") / F.count("*")
    ranked = fx.attempts(spark, sf).groupBy("doc_id", "field_id", "strategy").agg(rate.alias("rate"))
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rate")).alias("k"), "strategy"))), lambda x: x["strategy"])
    fields = ranked.groupBy("doc_id", "field_id").agg(order.alias("strategies")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_id", "strategies")))).alias("orders"))
    scoring = F.create_map(*[F.lit(x) for f in FIELDS for x in (f, '{"enabled":true,"adjustments":{"vat_line_penalty":-5,"incl_btw_boost":1.5}}' if f == "view" else '{"enabled":false}')])
    return fields.select(F.col("doc_id").alias("user_id"), "orders", bundles.build(F.lit(1), F.sha2(F.col("doc_id").cast("string"), 256), F.col("orders"), scoring).alias("bundle"))


@query("snk_bundle", w(ATTEMPTS, RANKED) + """SELECT doc_id AS user_id, concat('v1|', string_agg(concat(field_id, '=', s), ';' ORDER BY field_id), '|click=off;error=off;purchase=off;signup=off;view=on:incl_btw_boost,vat_line_penalty') AS structure, max(CASE WHEN field_id = 'click' THEN o END) AS click_order
  FROM (SELECT doc_id, field_id, string_agg(strategy, ',' ORDER BY strategy) AS s, string_agg(strategy, ',' ORDER BY -rate, strategy) AS o FROM ranked GROUP BY 1, 2) GROUP BY 1""")
def snk_bundle(spark, sf):
    """Bundles of all users, written as JSON and read back."""
    path = new_path(spark, "bundles")
    _built(spark, sf).select("user_id", "bundle").write.json(path)
    back = spark.read.schema("user_id long, bundle string").json(path)
    click = F.try_variant_get(F.parse_json("bundle"), "$.patch.order.click", "array<string>")
    return back.select("user_id", bundles.structure(F.col("bundle")).alias("structure"), F.array_join(click, ",").alias("click_order"))


@query("fn_bundle_fp", w(ATTEMPTS) + """, have AS (SELECT doc_id, field_id, count(DISTINCT strategy) AS n FROM attempts GROUP BY 1, 2), lacks AS (SELECT u.doc_id, list_sort(list(CASE WHEN h.n IS NULL THEN concat('$.patch.order.', f, ':missing') WHEN h.n < 6 THEN concat('$.patch.order.', f, ':missing_strategies') END) FILTER (WHERE h.n IS NULL OR h.n < 6)) AS e FROM (SELECT DISTINCT doc_id FROM attempts) u CROSS JOIN (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) v(f) LEFT JOIN have h ON h.doc_id = u.doc_id AND h.field_id = f GROUP BY 1)
  SELECT doc_id AS user_id, CASE doc_id % 5 WHEN 0 THEN array_to_string(list_sort(list_concat(coalesce(e, []), ['$.version:missing'])), ' ') WHEN 1 THEN array_to_string(list_sort(list_concat(coalesce(e, []), ['$.semantic_scoring.view:unknown_adjustments'])), ' ') WHEN 2 THEN '$.patch:missing' WHEN 3 THEN '$:empty' ELSE coalesce(array_to_string(e, ' '), '') END AS errors,
    CASE WHEN doc_id % 5 IN (2, 3) THEN NULL ELSE doc_id % 5 <> 4 END AS changed FROM lacks""")
def fn_bundle_fp(spark, sf):
    """Bundles that lost their version, have an unknown adjustment, lost their orders, were cut off, or have other values only."""
    b, k = F.col("bundle"), F.col("user_id") % 5
    orders = F.to_json(F.struct(F.struct(F.col("orders").alias("order")).alias("x")))
    spoilt = (
        F.when(k == 0, F.replace(b, F.lit('"version":1,'), F.lit(""))).when(k == 1, F.replace(b, F.lit("incl_btw_boost"), F.lit("other_boost")))
        .when(k == 2, F.replace(b, F.concat(F.lit('"patch":'), F.substr(orders, F.lit(6), F.length(orders) - 6), F.lit(",")), F.lit(""))).when(k == 3, F.substr(b, F.lit(1), F.length(b) - 1)).otherwise(F.replace(b, F.lit("-5"), F.lit("-7")))
    )
    built = _built(spark, sf).withColumn("spoilt", spoilt)
    changed = F.when(~k.isin(2, 3), bundles.fingerprint(b) != bundles.fingerprint(F.col("spoilt")))
    return built.select("user_id", F.array_join(bundles.errors(F.col("spoilt"), REGISTRY), " ").alias("errors"), changed.alias("changed"))
