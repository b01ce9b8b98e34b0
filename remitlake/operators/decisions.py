"""Payment decisions: acceptance, warnings, discount, the decision ladder and the export gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, identifiers, money

ACCEPTED = ("matched", "new", "confirmed", "reviewed")


def reject_reason() -> Column:
    """Why a row is not accepted; null for accepted rows."""
    status = F.col("match_status")
    return (
        F.when(status == "load_failed", F.when(F.col("load_error") == "no_text", "pdf_no_text").otherwise("pdf_read_failed"))
        .when(status.isin(*ACCEPTED), F.lit(None))
        .when(status == "no_hint", "no_supplier_hint")
        .when(status == "needs_review", "needs_review")
        .otherwise("unmatched_supplier")
    )


def accept(rows: DataFrame) -> DataFrame:
    """Tags rows with ``reject_reason``; a blank supplier name among accepted rows is a reason too."""
    tagged = rows.withColumn("reject_reason", reject_reason())
    blank = F.trim(F.coalesce("supplier_name", F.lit(""))) == ""
    return tagged.withColumn("reject_reason", F.when(F.col("reject_reason").isNull() & blank, "missing_supplier_name").otherwise(F.col("reject_reason")))


def reject_status(reason: Column) -> Column:
    """Decision on a row that is not accepted: review where a supplier can still be confirmed."""
    return F.when(reason.isin("needs_review", "unmatched_supplier"), "needs_review").otherwise("excluded")


def review_detail(core: Column, iban_match: Column, code_match: Column, alias_match: Column, ocr: Column) -> Column:
    """``core_matches=…;missing=…;ocr=…``; empty parts but the first are left out."""
    missing = F.array_compact(F.array(F.when(~iban_match, "IBAN"), F.when(~code_match, "customer_code"), F.when(~alias_match, "alias")))
    part = lambda name, a: F.when(F.size(a) > 0, F.concat(F.lit(f";{name}="), F.array_join(a, ",")))
    return F.concat_ws("", F.concat(F.lit("core_matches="), F.array_join(core, ",")), part("missing", missing), part("ocr", ocr))


def warnings(mismatch: Column, review: Column | None = None) -> Column:
    """Warnings of a row in their order, parted by bars; null without any."""
    parts = F.array_compact(F.array(
        F.when(mismatch, "iban_mismatch_supplier"),
        F.when(~F.col("term_trusted"), "supplier_term_not_applied"),
        F.when(F.col("invoice_date").isNull(), "missing_invoice_date"),
        F.when(F.col("amount_status") == "tentative", "amount_tentative").when(F.col("amount_status") == "low_confidence", "amount_low_confidence"),
        F.when(F.lit(False) if review is None else review, "credit_match_needs_review"),
    ))
    return F.when(F.size(parts) > 0, F.array_join(parts, "|"))


def with_payable(rows: DataFrame, applied: Column | None = None) -> DataFrame:
    """Adds excl_base, discount and payable: the balance after credits, less the discount on its VAT-free part."""
    saldo = F.col("amount") if applied is None else (F.col("amount") - applied).cast("decimal(18,2)")
    rows = rows.withColumn("saldo", saldo).withColumn("excl_base", money.excl(F.col("saldo"), F.col("vat_rate")))
    rows = rows.withColumn("discount", F.when(F.col("discount_pct") > 0, money.discount(F.col("excl_base"), F.col("discount_pct"))).otherwise(F.lit(0).cast("decimal(18,2)")))
    return rows.withColumn("payable", (F.col("saldo") - F.col("discount")).cast("decimal(18,2)"))


def decision_reason(needs_credit_review: Column | None = None) -> Column:
    """The first rule that applies decides."""
    blank = F.trim(F.coalesce("iban", F.lit(""))) == ""
    status = F.col("amount_status")
    return (
        F.when(F.col("payable") <= 0, "zero_amount")
        .when(blank, "missing_iban")
        .when(~identifiers.iban_valid(F.col("iban")), "invalid_iban")
        .when(status.isin("tentative", "low_confidence"), "low_confidence")
        .when(status == "ambiguous", "ambiguous")
        .when(status == "failed", "missing_amount")
        .when(F.lit(False) if needs_credit_review is None else needs_credit_review, "credit_match_needs_review")
        .otherwise("export_allowed")
    )


def decision_status(reason: Column) -> Column:
    return (
        F.when(reason.isin("zero_amount", "missing_iban", "invalid_iban", "missing_amount"), "excluded")
        .when(reason.isin("low_confidence", "ambiguous", "credit_match_needs_review"), "needs_review")
        .otherwise("included")
    )


def decide(rows: DataFrame, needs_credit_review: Column | None = None) -> DataFrame:
    """Adds reason_code, decision, requires_rerun and a fingerprint of the decision."""
    out = rows.withColumn("reason_code", decision_reason(needs_credit_review))
    out = out.withColumn("decision", decision_status(F.col("reason_code"))).withColumn("requires_rerun", F.col("decision") == "needs_review")
    return out.withColumn("fingerprint", F.sha2(F.concat_ws("|", "doc_id", "decision", "reason_code", F.col("payable").cast("string")), 256))


def effective_amount(cell: Column, status: Column, snapshot: Column, picked: Column) -> Column:
    """A user's pick, else the visible amount where it differs, else the snapshot, else the visible amount."""
    sure = status.isin("confirmed", "tentative") & snapshot.isNotNull()
    return F.when(picked.isNotNull(), picked).when(sure & (cell.isNull() | (cell == snapshot)), snapshot).otherwise(cell)


def execution_date(mode: Column, session: Column) -> Column:
    """``direct``: the session; ``due``: date plus trusted term; anything else is a manual date kept."""
    term = F.when(F.col("term_trusted"), F.col("term_days")).otherwise(0)
    return F.when(mode == "direct", session).when(mode == "due", dates.due(F.col("invoice_date"), term, session)).otherwise(F.col("manual_date"))


def export_gate(payments: DataFrame) -> DataFrame:
    """One row: counts of doubtful payments, the duplicate flag and the gate's status."""
    per = payments.groupBy(F.regexp_replace(F.coalesce("iban", F.lit("")), "\\s", "").alias("iban"), "amount").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("amount_status") == "ambiguous").alias("ambiguous"),
        F.count_if(F.col("amount_status") == "failed").alias("failed"),
        F.count_if(F.col("amount").isNull() | (F.col("amount") <= 0)).alias("invalid"),
    )
    one = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("payment_count"), F.coalesce(F.sum("ambiguous"), F.lit(0)).alias("ambiguous_count"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed_count"),
        F.coalesce(F.sum("invalid"), F.lit(0)).alias("invalid_amount_count"), F.coalesce(F.bool_or((F.col("iban") != "") & (F.col("n") >= 2)), F.lit(False)).alias("duplicate_risk"),
    )
    bad = F.col("ambiguous_count") + F.col("failed_count") + F.col("invalid_amount_count") > 0
    return one.withColumn("gate", F.when(bad, "blocked").when(F.col("duplicate_risk"), "warning").otherwise("valid"))


def error_buckets(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy("reject_reason", "supplier_name").agg(F.count("*").alias("n_docs"), F.sum("amount").cast("decimal(28,2)").alias("amount"))


def first_documents(rows: DataFrame) -> DataFrame:
    """First row per file, then first per (supplier, number) among those."""
    by_file = Window.partitionBy("source_file").orderBy("input_pos")
    by_number = Window.partitionBy("hint", "invoice_number").orderBy("input_pos")
    once = rows.withColumn("__n", F.row_number().over(by_file)).where("__n = 1")
    return once.withColumn("__n", F.row_number().over(by_number)).where("__n = 1").drop("__n")


def trace() -> Column:
    """Why a decided row was decided so, as a JSON text."""
    text = lambda c: F.col(c).cast("string").alias("value" if c == "amount" else c)
    amount = F.struct(text("amount"), F.col("amount_status").alias("status"), text("payable"))
    iban = F.struct((F.trim(F.coalesce("iban", F.lit(""))) != "").alias("present"), F.coalesce(F.col("iban") == F.col("db_iban"), F.lit(False)).alias("matches_master"))
    return F.to_json(F.struct("decision", "reason_code", amount.alias("amount"), iban.alias("iban"), "term_trusted"))
