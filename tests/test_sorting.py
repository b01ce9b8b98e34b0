"""Places in an order over all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from remitlake import registry
from remitlake.plans import agg_plans


def test_every_document_has_a_place_in_order(spark, sf_dir):
    docs = agg_plans.fx.documents(spark, sf_dir).collect()
    want = [r["doc_id"] for r in sorted(docs, key=lambda r: (-r["amount"], r["doc_date"], r["doc_id"]))]
    got = [(r["doc_id"], r["place"]) for r in registry.queries()["srt_ui_amount_all"](spark, sf_dir).collect()]
    assert len(want) > 100 and got == [(d, k) for k, d in enumerate(want, 1)]


def test_places_go_on_over_many_ranges(spark):
    """More rows than one range is given, with ties."""
    rows = spark.range(0, 50_000, 1, 7).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("amount"))
    order = (F.desc("amount"), F.asc("id"))
    placed = agg_plans._placed(rows, order).collect()
    want = sorted(placed, key=lambda r: (-r["amount"], r["id"]))
    assert [r["place"] for r in want] == list(range(1, 50_001))
