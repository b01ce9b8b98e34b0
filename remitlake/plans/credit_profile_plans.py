"""Credit notes read by their suppliers' own rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import credit_profiles as cp
from ..sources import fixtures as fx
from .book import query
from .fixture_sql import DOCS, w

# What the query builds: text "N0mmer: <id>\nBedrag 0<cents>\n<wording>", a confidence of 40 or 90, users' word for every fifth order,
# profiles for two suppliers of three; of these the even ones mend "N0mmer" and know references as "zie <number>".
NOTES = """notes AS (SELECT *, supplier_id % 3 <> 0 AND doc_type = 'credit_note' AND (order_id % 5 = 0 OR order_id % 2 = 0) AS applies, CASE WHEN order_id % 2 = 0 THEN 90 ELSE 40 END AS confidence, lpad(CAST(order_id AS VARCHAR), 6, '0') AS n FROM docs)"""


@query("fn_credit_profile", w(DOCS, NOTES) + """SELECT doc_id, CASE WHEN applies AND supplier_id % 2 = 0 THEN doc_id ELSE 'old' END AS number, CASE WHEN applies AND order_id % 7 <> 0 THEN amount ELSE CAST(1 AS DECIMAL(18,2)) END AS amount, refs, concat_ws(',', CASE WHEN applies AND order_id % 7 <> 0 THEN 'amount' END, CASE WHEN applies AND supplier_id % 2 = 0 THEN 'credit_number' END, CASE WHEN refs <> '' THEN 'references' END) AS fields
  FROM (SELECT *, CASE WHEN NOT applies THEN '' WHEN order_id % 3 = 0 THEN concat('F', n) WHEN supplier_id % 2 = 0 AND confidence < 50 THEN concat('Z', n) ELSE '' END AS refs FROM notes)""")
def fn_credit_profile(spark, sf):
    """Profiles that mend a misread label, rules that find nothing, patterns that do not compile, and documents that no profile may touch."""
    n, lit, k = F.lpad(F.col("order_id").cast("string"), 6, "0"), F.lit, F.col("supplier_id")
    amount = F.concat(F.when(F.col("order_id") % 7 == 0, "Som EUR ").otherwise("Bedrag EUR "), F.replace(F.col("amount").cast("string"), lit("."), lit(",")))
    text = F.concat(lit("N0mmer: "), F.col("doc_id"), lit("\n"), amount, lit("\n"), F.when(F.col("order_id") % 3 == 0, F.concat(lit("onze factuur F"), n)).otherwise(F.concat(lit("zie Z"), n, lit(" en zie z"), n)))
    docs = fx.documents(spark, sf).select(
        "doc_id", "doc_type", k.cast("string").alias("supplier_key"), text.alias("text"), lit(True).alias("is_credit"), F.when(F.col("order_id") % 2 == 0, 90).otherwise(40).alias("confidence"),
        (F.col("order_id") % 5 == 0).alias("user_override"), lit("old").alias("number"), lit(1).cast("decimal(18,2)").alias("amount"), F.array().cast("array<string>").alias("references"),
    )
    even, none = k % 2 == 0, F.array().cast("array<string>")
    rule = lambda strategy, label: F.struct(lit(strategy).alias("strategy"), lit(label).alias("label"))
    profiles = fx.suppliers(spark, sf).where("supplier_id % 3 <> 0").select(
        k.cast("string").alias("supplier_key"), F.when(even, F.array(lit("(N)0(mmer)"), lit("(open"))).otherwise(none).alias("patterns"), F.array(lit(r"\1u\2"), lit("")).alias("replacements"),
        rule("same_line_after_colon", "Nummer").alias("number_rule"), rule("last_token_on_line", "Bedrag").alias("amount_rule"), F.when(even, F.array(lit(r"(?i)\bzie (Z\d+)"), lit("["))).otherwise(none).alias("reference_patterns"),
    )
    return cp.apply(docs, profiles).select("doc_id", "number", "amount", F.array_join("references", ",").alias("refs"), F.array_join("profile_fields", ",").alias("fields"))
