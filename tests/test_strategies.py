"""String and amount strategies on literal texts, and places of amounts against plain Python."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from remitlake.operators import strategies as st


def _strings(spark, text, value, field="invoice_number"):
    df = st.strings(spark.createDataFrame([(1, text)], "doc_id int, text string"), spark.createDataFrame([(1, field, value)], "doc_id int, field_id string, confirmed string"))
    rows = {r["strategy"]: r for r in df.collect()}
    assert tuple(rows) == st.STRING_STRATEGIES
    return {k: (r["rule"], r["label"], r["candidate"]) if r["status"] == "proposed" else (r["status"], r["reason"]) for k, r in rows.items()}


def test_value_after_a_label(spark):
    got = _strings(spark, "kop\nFactuur nr: ab-12\nx", " AB-12 ")
    assert got["token_matching_confirmed_value"] == ("same_line_after_colon", "Factuur nr:", "ab-12")
    assert got["generic_label_same_line_after_colon"] == ("same_line_after_colon", "Factuur nr", "ab-12")
    assert got["label_then_next_line"] == ("next_line_first_token", "kop", "ab-12")
    assert got["last_token_on_line"] == ("last_token_on_line", "Factuur nr", "ab-12")
    assert got["factuur_inline_pagina"] == ("invalid", "pattern_not_found") and got["slash_compound_split"] == ("skipped", None)


def test_slash_tag_and_page(spark):
    got = _strings(spark, "Klant: 1234 / zie 99\nCode [O+3] 1234/99", "1234/99", "customer_number")
    assert got["slash_compound_split"] == ("same_line_after_colon", "Klant", "1234/99")
    assert got["ocr_tag_extraction"] == ("ocr_tag_extraction", "Code", "1234/99")
    assert got["factuur_inline_pagina"] == ("skipped", None)
    assert _strings(spark, "Factuur VF-777 pagina 2", "vf-777")["factuur_inline_pagina"] == ("factuur_inline_pagina", "Factuur", "VF-777")


def test_values_that_are_not_there(spark):
    for text, value in [(None, "x1"), ("", "x1"), ("abc", "x1"), ("abc", None), ("abc", " ")]:
        got = _strings(spark, text, value)
        assert {v[0] for v in got.values()} == {"invalid", "skipped"}
        assert got["same_line_value_after_label"] == ("invalid", "value_not_in_text")
    assert _strings(spark, "x1 b", "x1")["label_then_next_line"] == ("invalid", "no_line_above")


def _amounts(spark, text, cents, context=None):
    df = st.amounts(spark.createDataFrame([(1, text)], "doc_id int, text string"), spark.createDataFrame([(1, cents, context)], "doc_id int, cents long, context string"))
    rows = {r["strategy"]: r for r in df.collect()}
    assert tuple(rows) == st.AMOUNT_STRATEGIES
    return {k: (r["rule"], r["label"]) if r["status"] == "proposed" else (r["status"], r["reason"]) for k, r in rows.items()}


def test_amounts(spark):
    got = _amounts(spark, "Totaal EUR 12,00 1.234,50\nTe betalen\n9,99 1.234,50", 123450)
    assert got == {
        "token_matching_confirmed_amount": ("same_line_last_amount", "Totaal"), "amount_label_next_line": ("next_line_last_amount", "Te betalen"), "derived_excl_plus_vat": ("invalid", "derived_components_missing"),
        "unlabeled_prefix_amount": ("same_line_last_amount", "Totaal EUR 12,00"), "amount_from_context": ("skipped", None), "amount_fallback_scan": ("same_line_last_amount", "Totaal"),
    }
    got = _amounts(spark, "btw 9% 3,00\nexcl. btw 10,00\nbtw 21% 2,10\nsom € 12,10 0,00", 1210, "som € 12,10")
    assert got["derived_excl_plus_vat"] == ("derived_excl_plus_vat", "excl. btw + btw 21%")
    assert got["amount_from_context"] == got["amount_fallback_scan"] == ("same_line_first_amount", "EUR")
    assert got["token_matching_confirmed_amount"] == ("invalid", "amount_not_on_labeled_line")
    assert _amounts(spark, "excl. btw 10,00\nbtw 21% 2,10", 1211)["derived_excl_plus_vat"] == ("invalid", "derived_mismatch")
    for text, cents in [(None, 5), ("", 5), ("1,00", None), ("11,00", 100)]:
        assert {v[0] for v in _amounts(spark, text, cents).values()} == {"invalid", "skipped"}


def test_prefix_is_what_stands_before_the_last_equal_amount(spark):
    draw = random.Random(2)
    texts = [(i, " ".join(draw.choice(["abc", "x", "1,00", "11,00", "2,50", "1.001,00"]) for _ in range(draw.randint(1, 9)))) for i in range(200)]
    df = st.amounts(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame([(i, 100, None) for i, _ in texts], "doc_id int, cents long, context string"))
    got = {r["doc_id"]: r["label"] for r in df.where("strategy = 'unlabeled_prefix_amount' and status = 'proposed'").collect()}
    want = {}
    for i, t in texts:
        places = [m.start() for m in re.finditer(st.AMOUNT, t) if re.sub(r"\D", "", m.group()) == "100"]
        if places and len(t[: places[-1]].strip()) >= 3:
            want[i] = t[: places[-1]].strip()
    assert got == want and len(want) > 50


def test_patterns_are_tried_on_lines_with_the_amount_only(spark):
    """What stands between amounts is worked out for lines that hold the confirmed one; each label is sought once."""
    t = spark.createDataFrame([("a", 100, "Totaal 1,00\n9,00")], "doc_id string, cents long, text string")
    df = st.amounts(t, t.select("doc_id", "cents", F.lit(None).cast("string").alias("context")))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(.*?)(") == 2 and "proposed" in {r["status"] for r in df.collect()}
