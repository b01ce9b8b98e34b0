"""Incremental jobs: intake of new rows without repeats, and a guard against repeated payments.

Both read a folder (or file) as a stream, process what is there and stop; run again with the
same ``state`` folder they take up only what has arrived since.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def _run(writer: DataStreamWriter, state: str) -> None:
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def intake(spark: SparkSession, source: str, schema, keys: list[str], time: str, delay: str, out: str, state: str) -> None:
    """Appends the first row of every key to ``out``; keys are remembered for ``delay`` of event time."""
    stream = spark.readStream.schema(schema).parquet(source).withColumn("__time", F.col(time).cast("timestamp"))
    first = stream.withWatermark("__time", delay).dropDuplicatesWithinWatermark(keys).drop("__time")
    _run(first.writeStream.format("parquet").option("path", out), state)


def duplicate_guard(spark: SparkSession, source: str, schema, history: DataFrame, keys: list[str], out: str, state: str) -> None:
    """Appends arriving payments to ``out``, flagged where ``history`` has their keys."""
    past = history.select(*keys).distinct().withColumn("__seen", F.lit(True))
    stream = spark.readStream.schema(schema).parquet(source)
    flagged = stream.join(past, keys, "left").withColumn("repeated", F.coalesce("__seen", F.lit(False))).drop("__seen")
    _run(flagged.writeStream.format("parquet").option("path", out), state)
