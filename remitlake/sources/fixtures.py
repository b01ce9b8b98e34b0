"""Payables tables derived from the order tables, at the scale of their inputs.

``lineitem`` grouped by order and supplier gives documents; returned lines make credit notes.
``supplier`` gives the supplier master with valid account numbers. Variants (missing or wrong
accounts, uncertain amounts, repeated files) follow from the order number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    padded = F.lpad(key.cast("string"), 10, "0")
    check = F.lit(98) - (F.concat(F.lit("11102320"), padded, F.lit("232100")).cast("decimal(38,0)") % 97).cast("int")
    return table(spark, sf_dir, "supplier").select(
        key.alias("supplier_id"),
        F.col("s_name").alias("supplier_name"),
        F.concat(F.lit("NL"), F.lpad(check.cast("string"), 2, "0"), F.lit("BANK"), padded).alias("iban"),
        F.concat(F.lit("K"), F.lpad(key.cast("string"), 6, "0")).alias("customer_code"),
        F.concat(F.lit("NL"), F.lpad(key.cast("string"), 9, "0"), F.lit("B01")).alias("vat_number"),
        F.lpad((key + 10_000_000).cast("string"), 8, "0").alias("kvk_number"),
        F.concat(F.lit("sup"), key.cast("string"), F.lit(".example.org")).alias("email_domain"),
        (key % 4).cast("decimal(5,2)").alias("discount_pct"),
        (key % 31).cast("int").alias("term_days"),
        F.when(key % 10 == 0, 0).when(key % 7 == 0, 9).otherwise(21).alias("vat_rate"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    is_credit = F.col("l_returnflag") == "R"
    grouped = line.groupBy(F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("supplier_id"), is_credit.alias("is_credit")).agg(
        F.sum(F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("amount"), F.min("l_shipdate").cast("date").alias("doc_date")
    )
    name = F.concat(F.when(F.col("is_credit"), "CN").otherwise("INV"), F.col("order_id").cast("string"), F.lit("-"), F.col("supplier_id").cast("string"))
    return grouped.select(name.alias("doc_id"), "supplier_id", "order_id", F.when(F.col("is_credit"), "credit_note").otherwise("invoice").alias("doc_type"), "amount", "doc_date")


def credits(docs: DataFrame) -> DataFrame:
    """Credit notes; every third one refers to the supplier's next invoice."""
    # from the last order back, as Spark goes over each frame that ends with its partition anew
    later = Window.partitionBy("supplier_id").orderBy(F.desc("order_id")).rangeBetween(Window.unboundedPreceding, -1)
    ref = F.min(F.when(F.col("doc_type") == "invoice", F.col("order_id"))).over(later)
    return docs.withColumn("ref_order", ref).where("doc_type = 'credit_note'").select(
        F.col("doc_id").alias("credit_id"), "supplier_id", "amount", "doc_date",
        F.when((F.col("order_id") % 3 == 0) & F.col("ref_order").isNotNull(), F.concat(F.lit("INV"), F.col("ref_order").cast("string"), F.lit("-"), F.col("supplier_id").cast("string"))).alias("ref_number"),
    )


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engine rows: documents joined to the supplier master, with variants by order number."""
    o = F.col("order_id")
    joined = documents(spark, sf_dir).join(suppliers(spark, sf_dir), "supplier_id")
    return joined.select(
        "doc_id", "supplier_id", "order_id", "doc_type", "amount", "doc_date", "discount_pct", "vat_rate", "term_days",
        F.concat("doc_id", F.lit(".pdf")).alias("source_file"),
        F.when(o % 97 == 0, F.lit("")).otherwise(F.col("supplier_name")).alias("supplier_name"),
        F.col("iban").alias("db_iban"),
        F.when(o % 11 == 0, F.lit(None)).when(o % 17 == 0, F.replace(F.col("iban"), F.lit("BANK"), F.lit("BANC"))).otherwise(F.col("iban")).alias("iban"),
        F.when(o % 13 == 0, "needs_review").when(o % 13 == 1, "unmatched").when(o % 13 == 2, "load_failed").when(o % 13 == 3, "no_hint").when(o % 13 == 4, "new").when(o % 13 == 5, "reviewed").otherwise("confirmed").alias("match_status"),
        F.when(o % 7 == 0, "ambiguous").when(o % 7 == 1, "failed").when(o % 7 == 2, "tentative").otherwise("confirmed").alias("amount_status"),
        (o % 4).cast("int").alias("n_candidates"),
        (o % 2 == 0).alias("term_trusted"),
        F.when(o % 19 == 0, F.lit(None)).otherwise(F.col("doc_date")).alias("invoice_date"),
        F.when(o % 5 == 0, "no_text").when(o % 5 == 1, "read_failed").alias("load_error"),
        "customer_code", "vat_number", "kvk_number", "email_domain",
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts for the extraction operators."""
    d = documents(spark, sf_dir).join(suppliers(spark, sf_dir), "supplier_id")
    return d.select(
        "doc_id", "supplier_id", "order_id", "doc_type", "amount", "doc_date",
        F.concat_ws(
            "\n",
            F.concat(F.lit("Factuurnummer: "), "doc_id"),
            F.concat(F.lit("Factuurdatum: "), F.date_format("doc_date", "dd-MM-yyyy")),
            F.concat(F.lit("Klantnummer: "), "customer_code"),
            F.concat(F.lit("Totaal te betalen EUR "), F.replace(F.col("amount").cast("string"), F.lit("."), F.lit(","))),
            F.concat(F.lit("IBAN "), "iban"),
            F.concat(F.lit("BTW nr "), "vat_number"),
            F.concat(F.lit("KvK "), "kvk_number"),
            F.concat(F.lit("E-mail info@"), "email_domain"),
        ).alias("text"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule-evaluation rows for the quality analytics."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_type").alias("field_id"), e.alias("attempt_id"),
        F.concat(F.lit("s"), (e % 6).cast("string")).alias("strategy"),
        F.when(e % 3 == 0, "valid").when(e % 3 == 1, "invalid").otherwise("skipped").alias("status"),
        ((e * 37) % 101).cast("int").alias("confidence_pct"),
    )
