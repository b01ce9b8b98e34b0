"""Fingerprints of multisets that do not depend on order and can be merged, and runs compared by them.

Of every row the four 32-bit words of a digest are summed, with a count. Sums are partial in every
task, so no group is gathered or sorted, and two tables are equal as multisets if and (but for
collisions of four sums) only if their sums are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = ("w0", "w1", "w2", "w3")


def words(*columns: Column | str) -> list[Column]:
    """The words of a row's digest; nulls differ from empty texts."""
    text = F.concat_ws("|", *[F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns])
    return [F.conv(F.substring(F.md5(text), 8 * k + 1, 8), 16, 10).cast("decimal(20,0)").alias(w) for k, w in enumerate(WORDS)]


def fingerprint(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys``, n_rows and fingerprint of the rows of every key."""
    sums = df.select(*keys, *words(*columns)).groupBy(*keys).agg(F.count("*").alias("n_rows"), *[F.sum(w).alias(w) for w in WORDS])
    return sums.select(*keys, "n_rows", F.sha2(F.concat_ws(":", F.col("n_rows").cast("string"), *[F.col(w).cast("string") for w in WORDS]), 256).alias("fingerprint"))


def compare(a: DataFrame, b: DataFrame, batch: list[str], key: str, columns: list[str]) -> DataFrame:
    """Two runs by batch: status, coverage (share of the first run's keys that the second has) and how many keys differ, with the least.

    Batches with equal fingerprints pass by their sums alone; rows are joined only in the others.
    """
    every = [key, *columns]
    x, y = (fingerprint(t, batch, every).withColumnRenamed("fingerprint", f"f_{s}").withColumnRenamed("n_rows", f"n_{s}") for t, s in ((a, "a"), (b, "b")))
    both = x.join(y, batch, "full").withColumn("same", F.coalesce(F.col("f_a") == F.col("f_b"), F.lit(False)))
    odd = both.where("not same").select(*batch)
    rows = lambda t, s: t.join(odd, batch, "left_semi").select(*batch, key, F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), 256).alias(s))
    told = rows(a, "__a").join(rows(b, "__b"), [*batch, key], "full")
    differs = ~F.col("__a").eqNullSafe(F.col("__b"))
    per = told.groupBy(*batch).agg(F.count_if(differs).alias("n_differ"), F.min(F.when(differs, F.col(key))).alias("first_differing"), F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("__met"))
    out = both.join(per, batch, "left")
    n_a = F.coalesce("n_a", F.lit(0))
    coverage = F.when(F.col("same"), 1.0).when(n_a == 0, 0.0).otherwise(F.col("__met") / n_a)
    return out.select(*batch, F.when(F.col("same"), "PASS").otherwise("FAIL").alias("status"), n_a.alias("n_first"), F.coalesce("n_b", F.lit(0)).alias("n_second"), coverage.alias("coverage"), F.coalesce("n_differ", F.lit(0)).alias("n_differ"), "first_differing")
