"""Literal cases of credit allocation."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from remitlake.operators import credits


def _frames(spark, cs, inv):
    c = spark.createDataFrame([(n, "b", Decimal(a), r) for n, a, r in cs], "credit_id string, batch string, amount decimal(18,2), ref_number string")
    i = spark.createDataFrame([(n, "b", Decimal(a)) for n, a in inv], "doc_id string, batch string, amount decimal(18,2)")
    return c, i


CASES = [
    ("reference", [("C1", "14.08", "I1")], [("I1", "100.00")], "reference", 1),
    ("exact", [("C1", "66.67", None)], [("I1", "66.67"), ("I2", "5.00")], "amount_exact", 1),
    ("fit", [("C1", "50.00", None)], [("I1", "200.00")], "amount_fit", 1),
    ("subset", [("C1", "150.00", None)], [("I1", "100.00"), ("I2", "50.00")], "amount_subset", 2),
    ("span", [("C1", "66.67", None)], [("I1", "65.51"), ("I2", "41.16")], "amount_span", 2),
    ("exceeds", [("C1", "500.00", None)], [("I1", "100.00")], "manual_review", 0),
    ("missing reference", [("C1", "50.00", "X9")], [("I1", "200.00")], "amount_fit", 1),
]


@pytest.mark.parametrize(("cs", "inv", "method", "linked"), [c[1:] for c in CASES], ids=[c[0] for c in CASES])
def test_one(spark, cs, inv, method, linked):
    r = credits.match_one(*_frames(spark, cs, inv)).collect()[0]
    assert (r["method"], r["n_linked"]) == (method, linked)
    if cs[0][2] == "X9":
        assert "referenced_invoices_not_in_batch" in r["warnings"]


@pytest.mark.parametrize(("cs", "inv", "method", "linked"), [c[1:] for c in CASES], ids=[c[0] for c in CASES])
def test_batch_agrees_for_a_single_credit(spark, cs, inv, method, linked):
    rows = credits.match_batches(*_frames(spark, cs, inv)).collect()
    assert {r["method"] for r in rows} == {method}
    assert sum(r["invoice_id"] is not None for r in rows) == linked


def test_span_nets_and_pools(spark):
    c, i = _frames(spark, [("C1", "66.67", None), ("C2", "30.00", None)], [("I1", "65.51"), ("I2", "41.16")])
    rows = credits.match_batches(c, i).collect()
    assert {(r["credit_id"], r["invoice_id"], r["applied_cents"]) for r in rows} == {("C1", "I2", 4116), ("C1", "I1", 2551), ("C2", "I1", 3000)}
    docs = spark.createDataFrame([("C1", "credit_note", Decimal("66.67")), ("C2", "credit_note", Decimal("30.00")), ("I1", "invoice", Decimal("65.51")), ("I2", "invoice", Decimal("41.16"))], "doc_id string, doc_type string, amount decimal(18,2)")
    g = credits.settle(credits.match_batches(c, i), docs).collect()
    assert len(g) == 1 and g[0]["status"] == "ok" and g[0]["final_amount_due"] == Decimal("10.00")


def test_batches_know_their_components(spark):
    cs = [("C1", "66.67", None), ("C2", "30.00", None), ("C3", "999.00", None)]
    c, i = _frames(spark, cs, [("I1", "65.51"), ("I2", "41.16"), ("I3", "70.00")])
    linked = credits.match_batches(c, i, linked=True)
    plain = credits.match_batches(c, i)
    docs = c.select(F.col("credit_id").alias("doc_id")).unionByName(i.select("doc_id"))
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "component").collect())
    assert key(credits.components(linked, docs)) == key(credits.components(plain, docs))
    assert sorted(map(str, linked.drop("component").collect())) == sorted(map(str, plain.collect()))


def test_least_linked():
    assert credits._least_linked([("C5", "I1"), ("C2", "I1"), ("C2", "A9"), ("C7", None), ("C8", "I3")]) == ["A9", "A9", "A9", "C7", "C8"]


def test_cut_works_a_stage_out_once(spark, tmp_path):
    from remitlake.sources.shared import checkpointed

    seen = str(tmp_path)

    def note(batches):
        import uuid

        for b in batches:
            open(f"{seen}/{uuid.uuid4().hex}", "w").close()
            yield b

    cut = checkpointed(spark.range(4, numPartitions=1).mapInPandas(note, "id long"))
    assert sorted(r["id"] for r in cut.collect()) == [0, 1, 2, 3] and len(list(tmp_path.iterdir())) == 1


def test_pour_takes_every_credit(spark):
    c, i = _frames(spark, [("C1", "30.00", None), ("C2", "70.00", None), ("C3", "70.00", None), ("C4", "25.00", None)], [("I1", "50.00"), ("I2", "90.00"), ("I3", "40.00")])
    rows = {(r["credit_id"], r["doc_id"], str(r["applied"])) for r in credits.pour(c, i).collect()}
    assert rows == {("C2", "I3", "40.00"), ("C2", "I1", "30.00"), ("C3", "I1", "20.00"), ("C3", "I2", "50.00"), ("C1", "I2", "30.00"), ("C4", "I2", "10.00")}


def test_no_invoices(spark):
    c, i = _frames(spark, [("C1", "10.00", None)], [])
    assert credits.match_one(c, i).collect()[0]["warnings"] == "no_same_supplier_invoices"
    assert credits.match_batches(c, i).collect()[0]["method"] == "manual_review"


ENGINE_ROW = "doc_id string, doc_type string, amount decimal(18,2), supplier_name string, match_status string, load_error string, iban string, amount_status string, vat_rate int, discount_pct decimal(5,2)"
GOOD = "NL91ABNA0417164300"


def test_engine_decides_by_component(spark):
    """Groups are named by their credit, which sorts before its invoices; rejected documents stay rows of their own."""
    row = lambda n, a, iban=GOOD, status="confirmed", name="S", amount="confirmed", error=None: (n, "credit_note" if n.startswith("CN") else "invoice", Decimal(a), name, status, error, iban, amount, 21, Decimal(0))
    rows = [
        row("CN1", "50.00"), row("INV1", "200.00", iban=None), row("CN2", "30.00"), row("INV2", "300.00", amount="ambiguous"), row("CN3", "20.00"), row("INV3", "400.00"),
        row("CN4", "10.00"), row("INV4", "500.00", status="unmatched"), row("INV5", "5.00", status="load_failed", error="no_text"), row("INV6", "6.00", name=" "), row("CN7", "1.00", status="no_hint"), row("INV7", "70.00"), row("INV8", "80.00", iban="NL00ABNA0417164300"),
    ]
    frame = spark.createDataFrame(rows, ENGINE_ROW)
    batch = lambda n: "b" + n[-1]
    c = spark.createDataFrame([(r[0], batch(r[0]), r[2], None) for r in rows if r[0].startswith("CN")], "credit_id string, batch string, amount decimal(18,2), ref_number string")
    i = spark.createDataFrame([(r[0], batch(r[0]), r[2]) for r in rows if r[0].startswith("INV")], "doc_id string, batch string, amount decimal(18,2)")
    got = credits.decided_groups(frame, c, i).collect()
    assert {(r["component"], r["status"], r["decision"], r["reason_code"]) for r in got} == {
        ("CN1", "ok", "excluded", "missing_iban"), ("CN2", "ok", "needs_review", "ambiguous"), ("CN3", "ok", "included", "export_allowed"),
        ("CN4", "manual_review", "needs_review", "credit_match_needs_review"), ("INV4", "rejected", "needs_review", "unmatched_supplier"),
        ("INV5", "rejected", "excluded", "pdf_no_text"), ("INV6", "rejected", "excluded", "missing_supplier_name"),
        ("CN7", "rejected", "excluded", "no_supplier_hint"), ("INV7", "ok", "included", "export_allowed"), ("INV8", "ok", "excluded", "invalid_iban"),
    }
    assert sum(r["n_invoices"] + r["n_credits"] for r in got) == len(rows)
    assert {r["component"]: r["final_amount_due"] for r in got}["CN1"] == Decimal("150.00")
