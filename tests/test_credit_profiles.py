"""Suppliers' credit profiles: what they change, what they may not touch, and rows that are odd."""

from __future__ import annotations

from decimal import Decimal

import pytest

from remitlake.operators import credit_profiles as cp
from remitlake.operators import joins

DOCS = "doc_id int, doc_type string, supplier_key string, text string, is_credit boolean, confidence int, user_override boolean, number string, amount decimal(18,2), references array<string>, extra int"
RULES = [("a", ["[oO](\\d)", "(", "x"], ["0\\1", "", "\\7"], ("same_line_after_colon", "Nummer"), ("last_token_on_line", "Bedrag"), ["zie (\\w+)", ")"]), ("b", None, None, None, None, None)]


def _doc(text, kind="credit_note", key="a", credit=True, confidence=90, user=False):
    return (1, kind, key, text, credit, confidence, user, "old", Decimal(1), ["R1"], 5)


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize(("doc", "number", "amount", "refs", "fields"), [
    (_doc("Nummer: Co12\nx\nBedrag EUR 1.234,56"), "C012", "1234.56", ["R1"], ["amount", "credit_number"]),
    (_doc("onze factuur F12\nzie G99"), "old", "1.00", ["F12"], ["references"]),
    (_doc("zie G99 zie g99 zie H1 zie H12", confidence=40, user=True), "old", "1.00", ["G99", "H12"], ["references"]),
    (_doc("zie G99", confidence=90), "old", "1.00", ["R1"], []),
    (_doc("Nummer: C1", confidence=40), "old", "1.00", ["R1"], []),
    (_doc("Nummer: C1", credit=False), "old", "1.00", ["R1"], []),
    (_doc("Nummer: C1", kind="invoice", user=True), "old", "1.00", ["R1"], []),
    (_doc("Nummer: C1", key=" "), "old", "1.00", ["R1"], []),
    (_doc("Nummer: C1", key=None), "old", "1.00", ["R1"], []),
    (_doc("Nummer: C1", key="z"), "old", "1.00", ["R1"], []),
    (_doc("Nummer: C1", key="b"), "old", "1.00", ["R1"], []),
    (_doc(None), "old", "1.00", ["R1"], []),
    (_doc("Nummer:\nBedrag geen", kind=None), "old", "1.00", ["R1"], []),
])
def test_apply(spark, monkeypatch, small, doc, number, amount, refs, fields):
    if not small:
        monkeypatch.setattr(joins, "SMALL", 0)
    got = cp.apply(spark.createDataFrame([doc], DOCS), spark.createDataFrame(RULES, cp.PROFILE)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["number"], str(r["amount"]), r["references"], r["profile_fields"], r["extra"]) == (number, amount, refs, fields, 5)


def test_mended_text_stays(spark):
    r = cp.apply(spark.createDataFrame([_doc("o1 O2 x")], DOCS), spark.createDataFrame(RULES, cp.PROFILE)).first()
    assert r["text"] == "01 02 x"
    assert cp.apply(spark.createDataFrame([], DOCS), spark.createDataFrame([], cp.PROFILE)).count() == 0
