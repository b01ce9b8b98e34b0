"""Helpers shared by the corpus operators: shared-folder tables, row keys, prefix sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import new_path, ship, shared_dir  # noqa: F401

#: Words of the mixing, near-duplicate and quality contracts: runs of anything but ASCII white space.
SPACE_WORDS = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str, sort: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later reads start from files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.sortWithinPartitions(sort) if sort else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files that a table from :func:`materialise` is read from."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


_kept: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]):
    """The one object that a Python worker keeps for the tasks to come; asking for another key drops it."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def slices(batches: Iterator, column: str, most: int = 4 << 20) -> Iterator:
    """Cuts Arrow batches into runs of rows that hold about ``most`` bytes in ``column``."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < b.num_rows:
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + most, side="right")))
            yield b.slice(first, last - first)
            first = last


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def space_words(col: str = "text") -> Column:
    """Number of words between ASCII white space; null and empty texts have none."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(SPACE_WORDS)), F.lit(0)).cast("long")


def source_key(col: str = "source") -> Column:
    """Sorts by code point with null last, and keeps null apart from every text."""
    return F.when(F.col(col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(col).cast("string")))


def bucket_count(n: int) -> int:
    """About the square root of the rows: buckets and rows of a bucket grow alike."""
    return max(16, int(n**0.5))


def hash_bucket(h: Column, buckets: int) -> Column:
    """Cuts the 64-bit hashes, in their order, into equal ranges."""
    return F.floor((h.cast("double") / F.lit(2.0**64) + F.lit(0.5)) * F.lit(buckets)).cast("long")


def prefix_sums(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, out: str, total: str | None = None) -> DataFrame:
    """Adds the exclusive running sum of ``value`` within ``keys`` by (``bucket``, ``order``).

    Two levels: sums of the buckets are added up per key, and rows are added up within their
    bucket, so that no task holds a whole key. ``bucket`` has to rise with ``order``.
    """
    per = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__s"))
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = by_key.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, bucket, F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"), F.sum("__s").over(by_key).alias("__t"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    both = df.withColumn("__i", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(per, [*keys, bucket])
    both = both.withColumn(out, F.col("__o") + F.col("__i"))
    if total:
        both = both.withColumn(total, F.col("__t"))
    return both.drop("__s", "__o", "__i", "__t")
