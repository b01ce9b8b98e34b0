"""Transfer files: credit transfers as XML lines in order of their execution dates, in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpointed, new_path

# Lengths that the transfer format allows, and its characters.
CREDITOR, REMITTANCE = 70, 140
PLAIN = r"[^A-Za-z0-9/\-?:().,'+ ]"


def clean(text: Column, most: int) -> Column:
    """``text`` in the format's characters and length; what else it holds becomes a space."""
    return F.left(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), PLAIN, " ")), F.lit(most))


def element(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


def write(rows: DataFrame, path: str | None = None) -> str:
    """Writes transfers (execution_date, end_to_end, creditor, iban, amount, remittance); a blank remittance is an error."""
    path = path or new_path(rows.sparkSession, "transfers")
    remittance = clean(F.col("remittance"), REMITTANCE)
    checked = F.when(remittance == "", F.raise_error(F.lit("a transfer has no remittance"))).otherwise(remittance)
    parts = [("ReqdExctnDt", F.col("execution_date").cast("string")), ("EndToEndId", F.col("end_to_end")), ("InstdAmt", F.col("amount").cast("decimal(28,2)").cast("string")), ("Nm", clean(F.col("creditor"), CREDITOR)), ("IBAN", F.regexp_replace("iban", r"\s", "")), ("Ustrd", F.replace(checked, F.lit("'"), F.lit("&apos;")))]
    line = element("CdtTrfTxInf", F.concat(*[element(n, v) for n, v in parts]))
    # a file holds a range of dates; a date that has very many transfers is split
    # ranges are drawn from the rows before these are dealt, so rows are worked out once, before both
    dealt = checkpointed(rows.select("execution_date", "end_to_end", line.alias("value"))).repartitionByRange("execution_date", "end_to_end")
    dealt.sortWithinPartitions("execution_date", "end_to_end").select("value").write.text(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """The transfers of a folder."""
    got = spark.read.schema("value string").text(path)
    of = lambda name: F.regexp_extract("value", f"<{name}>(.*?)</{name}>", 1)
    return got.select(of("ReqdExctnDt").cast("date").alias("execution_date"), of("EndToEndId").alias("end_to_end"), of("Nm").alias("creditor"), of("IBAN").alias("iban"), of("InstdAmt").cast("decimal(28,2)").alias("amount"), F.replace(of("Ustrd"), F.lit("&apos;"), F.lit("'")).alias("remittance"))
