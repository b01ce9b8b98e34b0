"""Literal cases of settlement, export, overrides and transfer files."""

from __future__ import annotations

import os
import subprocess
import sys
import time
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from remitlake.operators import credits
from remitlake.operators import settlement as st
from remitlake.sources import transfers

ALLOCATION = "credit_id string, invoice_id string, invoice_number string, applied decimal(18,2), remaining decimal(18,2), status string, method string, warnings array<string>"
MEMBER = "doc_id string, doc_type string, amount decimal(18,2), component string"
D = Decimal


def _allocations(spark, rows):
    full = [(c, i, i, D(a), D(r), s, m, w) for c, i, a, r, s, m, w in rows]
    return spark.createDataFrame(full, ALLOCATION)


@pytest.fixture(scope="module")
def group_frames(spark):
    """Groups: a refund, a cent too much, exactly nothing left, something to pay, an open rest, a credit alone."""
    members = [
        ("C1", "credit_note", D("-90.00"), "g1"), ("I1", "invoice", D("50.00"), "g1"), ("C2", "credit_note", D("50.01"), "g2"), ("I2", "invoice", D("50.00"), "g2"), ("C3", "credit_note", D("50.00"), "g3"), ("I3", "invoice", D("50.00"), "g3"),
        ("C4", "credit_note", D("20.00"), "g4"), ("I4", "invoice", D("50.00"), "g4"), ("C5", "credit_note", D("20.00"), "g5"), ("I5", "invoice", D("50.00"), "g5"), ("C6", "credit_note", D("9.00"), "g6"),
    ]
    rows = [(f"C{k}", f"I{k}", a, "0", "applied", "reference", []) for k, a in ((1, "90.00"), (2, "50.01"), (3, "50.00"), (4, "20.00"), (5, "15.00"))]
    rows += [("C5", None, "0", "5.00", "unallocated_partial", "reference", ["remaining_credit_unallocated"]), ("C6", None, "0", "9.00", "unallocated_full", "manual_review", ["no_confident_match"])]
    return spark.createDataFrame(members, MEMBER), _allocations(spark, rows)


def test_statuses(group_frames):
    got = {r["component"]: (r["status"], str(r["final_amount_due"])) for r in st.totals(*group_frames).collect()}
    assert got == {"g1": ("refund_required", "-40.00"), "g2": ("zero_amount", "-0.01"), "g3": ("zero_amount", "0.00"), "g4": ("ok", "30.00"), "g5": ("manual_review", "35.00"), "g6": ("manual_review", "0.00")}


def test_lines(group_frames):
    got = {r["doc_id"]: (str(r["gross"]), str(r["applied"]), str(r["remaining"])) for r in st.lines(*group_frames).collect()}
    assert got["C1"] == ("90.00", "90.00", "0.00") and got["I1"] == ("50.00", "90.00", "0.00") and got["I4"] == ("50.00", "20.00", "30.00") and got["C5"] == ("20.00", "15.00", "5.00") and got["C6"] == ("9.00", "0.00", "9.00")


def test_outcomes(group_frames):
    members, allocations = group_frames
    got = {r["doc_id"]: (r["decision"], r["reason_code"], r["reason_detail"]) for r in st.outcomes(members, st.totals(members, allocations)).collect()}
    assert got == {
        "C1": ("needs_review", "credit_refund_required", "refund_amount=40.00"), "I1": ("needs_review", "credit_refund_required", "refund_amount=40.00"),
        "C5": ("needs_review", "credit_match_needs_review", None), "C6": ("excluded", "unallocated_credit_not_payable", "unallocated_credit"),
    }


def test_only_settled_groups_are_exported(spark, group_frames):
    members, allocations = group_frames
    decisions = spark.createDataFrame([(f"I{k}", f"g{k}", "included", "export_allowed") for k in range(1, 6)], "doc_id string, component string, decision string, reason_code string")
    groups = credits.group_decision(st.totals(members, allocations), decisions)
    assert [r["component"] for r in st.exportable(groups).collect()] == ["g4"]
    blocked = decisions.withColumn("decision", F.when(F.col("doc_id") == "I4", "excluded").otherwise(F.col("decision")))
    assert st.exportable(credits.group_decision(st.totals(members, allocations), blocked)).count() == 0


def test_overrides(spark):
    matches = spark.createDataFrame([(f"C{k}", "b", D("30.00"), "amount_fit") for k in range(1, 8)] + [("C9", "empty", D("5.00"), "manual_review")], "credit_id string, batch string, amount decimal(18,2), method string")
    invoices = spark.createDataFrame([("I1", "b", D("20.00")), ("I2", "b", D("20.00"))], "doc_id string, batch string, amount decimal(18,2)")
    part = lambda *xs: [(i, D(a)) for i, a in xs]
    asked = [
        ("C1", "b", "detach", part()), ("C2", "b", "reassign", part(("I1", "20.00"), ("I2", "10.00"))), ("C3", "b", "reassign", part(("I1", "20.00"))), ("C4", "b", "adjust", part(("I1", "12.00"), ("I7", "9.00"))), ("C5", "b", "adjust", part(("I1", "31.00"))),
        ("C9", "empty", "reassign", part(("I1", "5.00"))),
    ]
    overrides = spark.createDataFrame(asked, "credit_id string, batch string, action string, parts array<struct<doc_id:string,applied:decimal(18,2)>>")
    got = {r["credit_id"]: (r["method"], r["event"], r["skipped"], None if r["remaining"] is None else str(r["remaining"])) for r in st.apply_overrides(matches, overrides, invoices).collect()}
    assert got["C1"] == ("user_override", "user_detached", None, "30.00") and got["C2"] == ("user_override", "user_reassigned", None, "0.00")
    assert got["C3"] == ("amount_fit", "override_skipped", "partial_allocation", None) and got["C4"] == ("user_override", "user_allocation_adjusted", None, "18.00")
    assert got["C5"] == ("amount_fit", "override_skipped", "allocation_exceeds_credit", None) and got["C6"] == ("amount_fit", "auto_matched", None, None)
    assert got["C9"] == ("manual_review", "override_skipped", "insufficient_invoices", None)


def test_reassign_inputs(spark):
    invoices = spark.createDataFrame([("I1", "b", D("20.00"))], "doc_id string, batch string, amount decimal(18,2)")
    cases = {"5,00": None, "5.01": None, "5,02": "exceeds_credit", "4,98": "partial_allocation", "x": "invalid_amount", " ": "empty"}
    rows = [(t, "b", D("5.00"), [("I1", t)]) for t in cases] + [("large", "b", D("50.00"), [("I1", "50")]), ("none", "b", D("5.00"), [])]
    asked = spark.createDataFrame(rows, "credit_id string, batch string, amount decimal(18,2), entries array<struct<doc_id:string,text:string>>")
    assert {r["credit_id"]: r["problem"] for r in st.check_reassign(asked, invoices).collect()} == cases | {"large": "insufficient_invoices", "none": "empty"}


def test_links_by_id_then_number(spark):
    a = spark.createDataFrame([("C1", "I1", "N9", D("1.00")), ("C2", "zz", "N2", D("2.00")), ("C3", None, "N3", D("3.00")), ("C4", None, None, D("4.00")), ("C1", "I1", None, D("5.00"))], "credit_id string, invoice_id string, invoice_number string, applied decimal(18,2)")
    inv = spark.createDataFrame([(f"I{k}", f"N{k}") for k in (1, 2, 3, 9)], "doc_id string, invoice_number string")
    assert {(r["doc_id"], r["credit_id"], str(r["applied"])) for r in st.links(a, inv).collect()} == {("I1", "C1", "6.00"), ("I2", "C2", "2.00"), ("I3", "C3", "3.00")}


TRANSFER = "execution_date date, end_to_end string, creditor string, iban string, amount decimal(28,2), remittance string"


def test_transfer_files(spark):
    rows = [(date(2024, 1, 5), "e1", "Jansen & Zn <BV>", "NL91 ABNA 0417 1643 00", D("12.50"), "K1 / O'Neill é"), (date(2024, 1, 6), "e2", "x" * 90, "NL91ABNA0417164300", D("1.00"), "y" * 200)]
    path = transfers.write(spark.createDataFrame(rows, TRANSFER))
    got = {r["end_to_end"]: r for r in transfers.read(spark, path).collect()}
    assert (got["e1"]["creditor"], got["e1"]["iban"], got["e1"]["amount"], got["e1"]["remittance"], got["e1"]["execution_date"]) == ("Jansen   Zn  BV", "NL91ABNA0417164300", D("12.50"), "K1 / O'Neill", date(2024, 1, 5))
    assert len(got["e2"]["creditor"]) == 70 and len(got["e2"]["remittance"]) == 140


def test_a_transfer_needs_a_remittance(spark):
    with pytest.raises(Exception, match="no remittance"):
        transfers.write(spark.createDataFrame([(date(2024, 1, 5), "e1", "x", "NL1", D("1.00"), " ")], TRANSFER))


def test_one_supplier_with_very_many_documents(spark):
    inv = spark.range(50_000).select(F.concat(F.lit("I"), F.col("id").cast("string")).alias("doc_id"), F.lit("b").alias("batch"), (F.col("id") * 7 % 9973 + 10).cast("decimal(18,2)").alias("amount"))
    cred = spark.range(20_000).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("credit_id"), F.lit("b").alias("batch"), (F.col("id") * 11 % 9973 + F.lit("10.50").cast("decimal(18,2)")).cast("decimal(18,2)").alias("amount"), F.lit(None).cast("string").alias("ref_number"))
    began = time.time()
    assert credits.match_one(cred, inv).where("method = 'amount_fit'").count() > 19_000
    assert credits.match_batches(cred.limit(3000), inv).count() >= 3000
    assert time.time() - began < 120


def test_workers_find_the_package(tmp_path):
    """A driver that finds the package by itself, in another folder: its workers get it sent."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from remitlake.operators import credits
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
c = spark.createDataFrame([("C1", "b", 5, None)], "credit_id string, batch string, amount int, ref_number string").selectExpr("credit_id", "batch", "cast(amount as decimal(18,2)) as amount", "ref_number")
i = spark.createDataFrame([("I1", "b", 9)], "doc_id string, batch string, amount int").selectExpr("doc_id", "batch", "cast(amount as decimal(18,2)) as amount")
print("rows", credits.match_batches(c, i).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert "rows 1" in out.stdout, out.stderr[-2000:]


def test_transfers_and_components_are_worked_out_once(spark, monkeypatch):
    """Ranges of dates are drawn from written rows; an invoice and the credits that refer to it are a component without rounds of labels."""
    from remitlake.operators import credits as cr
    from remitlake.plans import settlement_plans as sp
    from remitlake.sources import transfers

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.sql("select date'2024-01-01' + cast(id as int) as execution_date, concat('e', id) as end_to_end, 'c' as creditor, 'NL1' as iban, cast(id + 1 as decimal(18,2)) as amount, 'r' as remittance from range(20)").repartition(4)
    back = transfers.read(spark, transfers.write(rows.mapInArrow(counted, rows.schema)))
    assert back.count() == 20 and seen.value == 20
    monkeypatch.setattr(cr, "connected", None)
    docs = spark.createDataFrame([("INV1", "invoice"), ("CN1", "credit_note"), ("CN2", "credit_note"), ("CN3", "credit_note")], "doc_id string, doc_type string")
    alloc = spark.createDataFrame([("CN1", "INV1"), ("CN2", "INV1"), ("CN2", None), ("CN3", None)], "credit_id string, invoice_id string")
    got = {r["doc_id"]: r["component"] for r in sp._with_components(alloc, docs).collect()}
    assert got == {"INV1": "CN1", "CN1": "CN1", "CN2": "CN1", "CN3": "CN3"}
