"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0 to 1, linear between knots. Its
integral is the source's weight; the weights share a budget of words, and no source gets more
than ``cap`` times its own words. A source's cumulative demand over time is its target times
the integral so far; a document copy gets the time at which demand reaches it, and documents
are range-sorted by that time.

Defined results: null and empty texts have size 0 and add nothing; a null source is a source of
its own, sorted last; rows repeated or with a null doc_id are rows like any other; an empty
table gives an empty result. Extra columns are carried along; names starting with ``__`` and
``mix_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Weights of the sources in code point order, repeating, with the slope of each one's schedule.
CYCLE = ((5.0, -0.5), (2.0, 0.0), (1.0, 0.5))
#: Share of its source's target from which a row counts as large.
LARGE = 0.02


def cycled_schedule(rank: Column) -> Column:
    """Heavy sources come early and light ones late; each schedule's integral is its weight."""
    kinds = [
        F.array(
            F.struct(F.lit(0.0).alias("t"), F.lit(w * (1 - s)).alias("w")),
            F.struct(F.lit(1.0).alias("t"), F.lit(w * (1 + s)).alias("w")),
        )
        for w, s in CYCLE
    ]
    return F.element_at(F.array(*kinds), ((rank - 1) % len(CYCLE) + 1).cast("int"))


def with_integrals(schedule: Column) -> Column:
    """Segments ``(t, w, slope, upto)`` of a schedule; ``upto`` is the integral before ``t``."""
    n = F.size(schedule)
    segments = F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.struct(
            F.element_at(schedule, i)["t"].alias("t"),
            F.element_at(schedule, i)["w"].alias("w"),
            ((F.element_at(schedule, i + 1)["w"] - F.element_at(schedule, i)["w"]) / (F.element_at(schedule, i + 1)["t"] - F.element_at(schedule, i)["t"])).alias("slope"),
            ((F.element_at(schedule, i + 1)["w"] + F.element_at(schedule, i)["w"]) / 2 * (F.element_at(schedule, i + 1)["t"] - F.element_at(schedule, i)["t"])).alias("area"),
        ),
    )
    return F.transform(
        segments,
        lambda x, i: x.withField("upto", F.aggregate(F.slice(segments, F.lit(1), i), F.lit(0.0), lambda a, y: a + y["area"])),
    )


def inverse(segments: Column, area: Column) -> Column:
    """The time at which the integral of a schedule reaches ``area``."""
    s = F.element_at(F.filter(segments, lambda x: (x["upto"] <= area) | (x["upto"] == 0)), -1)
    rest = F.greatest(area - s["upto"], F.lit(0.0))
    # w u + slope u^2 / 2 = rest, in the form that stays exact for a slope near zero
    root = F.sqrt(F.greatest(s["w"] * s["w"] + 2 * s["slope"] * rest, F.lit(0.0)))
    return F.least(F.lit(1.0), s["t"] + F.when(rest > 0, 2 * rest / (s["w"] + root)).otherwise(0.0))


def targets(docs: DataFrame, schedule: Callable[[Column], Column] = cycled_schedule, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: its size, segments and target, in words. ``docs`` has mix_key and mix_size."""
    sizes = docs.groupBy("mix_key").agg(F.sum("mix_size").cast("long").alias("mix_source_size"))
    everything = Window.partitionBy(F.lit(0))
    rows = sizes.withColumn("__r", F.row_number().over(everything.orderBy("mix_key")))
    rows = rows.withColumn("mix_segments", with_integrals(schedule(F.col("__r"))))
    rows = rows.withColumn("mix_area", F.aggregate("mix_segments", F.lit(0.0), lambda a, x: a + x["area"]))
    rows = rows.withColumn("__full", cap * F.col("mix_source_size")).withColumn("__ratio", F.col("__full") / F.col("mix_area"))
    # Sources fill up in the order of __ratio; the level is fixed where the next one is not full yet.
    order = everything.orderBy("__ratio", "mix_key")
    back = everything.orderBy(F.desc("__ratio"), F.desc("mix_key"))
    rows = rows.withColumns({
        "__filled": F.coalesce(F.sum("__full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "__left": F.sum("mix_area").over(back.rowsBetween(Window.unboundedPreceding, 0)),
        "__budget": share * F.sum("mix_source_size").over(everything),
    }).withColumn("__level", (F.col("__budget") - F.col("__filled")) / F.col("__left"))
    level = F.min_by(F.when(F.col("__level") <= F.col("__ratio"), F.col("__level")), F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "mix_key"))).over(everything)
    return rows.select("mix_key", "mix_source_size", "mix_segments", "mix_area", F.least(F.col("__full"), F.coalesce(level * F.col("mix_area"), F.col("__full"))).alias("mix_target"))


def mix(docs: DataFrame, n_rows: int, schedule: Callable[[Column], Column] = cycled_schedule, share: float = 1.5, cap: int = 2, seed: int = 17, tie: tuple[str, ...] = ()) -> DataFrame:
    """Adds what the mix takes of each row of ``docs`` (columns doc_id, source and mix_size).

    Within a source, rows are laid out in seeded order, pass after pass, those of over ``LARGE`` of
    the target before the others; a copy is taken if its middle lies before the target. So the
    words taken miss the target by half the copy that lies across it at most, which is ``LARGE / 2``
    of the target unless the large rows alone go beyond it. mix_copies counts the copies, mix_times
    has their training times. ``n_rows`` only sets the number of buckets. ``tie`` names columns that
    order rows of one doc_id and size.
    """
    b = C.bucket_count(n_rows)
    rows = docs.withColumn("mix_key", C.source_key()).withColumn("__h", F.xxhash64(F.lit(seed), "doc_id", "mix_size", *tie))
    rows = rows.withColumn("__b", C.hash_bucket(F.col("__h"), b))
    # Sources may be many or one may be hot, so their rows are dealt over the buckets' salts.
    salts = 16
    by_source = targets(docs.withColumn("mix_key", C.source_key()), schedule, share, cap).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("__salt", (F.col("__b") % salts).cast("int")).join(by_source, ["mix_key", "__salt"])
    rows = rows.withColumn("__b", F.when(F.col("mix_size") > LARGE * F.col("mix_target"), F.col("__b")).otherwise(F.col("__b") + b))
    rows = C.prefix_sums(rows, ["mix_key"], "__b", ["__h", "doc_id"], "mix_size", "__off")
    half = F.col("mix_size") / 2
    start = lambda k: F.col("__off") + k * F.col("mix_source_size")
    times = F.array_compact(F.array(*[
        F.when(start(k) + half < F.col("mix_target"), inverse(F.col("mix_segments"), (start(k) + half) / F.col("mix_target") * F.col("mix_area")))
        for k in range(cap)
    ]))
    return rows.withColumn("mix_times", times).withColumn("mix_copies", F.size("mix_times")).drop("__h", "__b", "__off", "__salt", "mix_segments", "mix_area", "mix_key")


def in_training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy taken, range-sorted by its training time (column mix_time)."""
    each = mixed.withColumn("mix_time", F.explode("mix_times"))
    return each.repartitionByRange("mix_time", F.xxhash64("doc_id")).sortWithinPartitions("mix_time", "doc_id")


def op1_mixing(spark, sf_dir):
    """One row per document, range-sorted by its first training time; rows not taken come last.

    A source's taken words miss its target by half of one document at most (see :func:`mix`).
    """
    docs = C.table(spark, sf_dir, "documents")
    narrow = C.materialise(docs.select("doc_id", "source", C.space_words().alias("mix_size"), F.xxhash64("text").alias("mix_text")), "sizes")
    out = mix(narrow, narrow.count(), tie=("mix_text",)).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).cast("long").alias("taken"),
        F.col("mix_copies").alias("copies"),
        F.try_element_at("mix_times", F.lit(1)).alias("position"),
    )
    key = F.coalesce("position", F.lit(2.0))
    return out.repartitionByRange(key, F.xxhash64("doc_id", "size")).sortWithinPartitions(key, "doc_id")
