"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled with a seed and ranked; the rank over the source's row count
is a row's fractional rank. Sorted by that, every stretch of the corpus has the sources in
their overall proportions, so equal cuts give shards that match the mixture. Row counts of
shards differ by one at most (law ``rows``).

Defined results: a null text has no bytes and the checksum of the empty text; a null source is
a source of its own; repeated rows and null ids are rows like any other; an empty table gives
an empty result; extra columns are carried along (names starting with ``__`` are reserved).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def interleave(docs: DataFrame, n_rows: int, shards: int = 8, seed: int = 29, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds shard and slot (gapless from 0 in each shard). ``docs`` has doc_id and source."""
    b = C.bucket_count(n_rows)
    rows = docs.withColumns({"__key": C.source_key(), "__h": F.xxhash64(F.lit(seed), "doc_id", *ties), "__one": F.lit(1).cast("long")})
    rows = rows.withColumn("__b", C.hash_bucket(F.col("__h"), b))
    rows = C.prefix_sums(rows, ["__key"], "__b", ["__h", "doc_id", *ties], "__one", "__rank", "__of")
    rows = rows.withColumn("__frac", (2 * F.col("__rank") + 1) / (2 * F.col("__of")))
    rows = rows.withColumn("__b", F.floor(F.col("__frac") * b).cast("long"))
    rows = C.prefix_sums(rows, [], "__b", ["__frac", "__key", "__h", "doc_id", *ties], "__one", "__g", "__n")
    # shard s holds the rows from ceil(s n / shards) on
    rows = rows.withColumn("shard", F.floor(F.col("__g") * shards / F.col("__n")).cast("int"))
    first = F.expr(f"(shard * __n + {shards - 1}) div {shards}")
    return rows.withColumn("slot", (F.col("__g") - first).cast("long")).drop("__key", "__h", "__one", "__b", "__rank", "__of", "__frac", "__g", "__n")


def op2_sharding(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    narrow = C.materialise(
        docs.select("doc_id", "source", (F.octet_length(C.text_or_empty()) + 1).cast("long").alias("size"), F.crc32(F.encode(C.text_or_empty(), "UTF-8")).alias("text_crc32")),
        "rows",
    )
    out = interleave(narrow, narrow.count(), ties=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
