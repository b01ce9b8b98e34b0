"""Scalar functions on literal inputs."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from remitlake.functions import dates, identifiers, money


def _one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).collect()[0]["y"]


@pytest.mark.parametrize(("text", "want"), [("EUR 1.234,56", "1234.56"), ("€ 1,234.56", "1234.56"), ("-12,50", "-12.50"), ("1234", None), ("", None), (None, None), ("12,", None), ("abc", None)])
def test_european(spark, text, want):
    got = _one(spark, money.european, text)
    assert got == (None if want is None else Decimal(want))


@pytest.mark.parametrize(("text", "want"), [("12,345", "12.35"), (" 7 ", "7.00"), ("", None), ("x", None), (None, None)])
def test_strict(spark, text, want):
    assert _one(spark, money.strict, text) == (None if want is None else Decimal(want))


@pytest.mark.parametrize(("text", "want"), [("NL91 ABNA 0417 1643 00", True), ("nl91abna0417164300", True), ("NL92ABNA0417164300", False), ("NL91", False), ("", False), (None, False)])
def test_iban(spark, text, want):
    assert _one(spark, identifiers.iban_valid, text) is want


@pytest.mark.parametrize(("text", "want"), [("2026-07-02", (2026, 7, 2)), ("2/7/26", (2026, 7, 2)), ("02.07.2026", (2026, 7, 2)), ("31-02-2026", None), ("op 2-7-2026 te", (2026, 7, 2)), ("", None), (None, None)])
def test_dates(spark, text, want):
    assert _one(spark, dates.parse, text) == (datetime.date(*want) if want else None)


@pytest.mark.parametrize(("text", "want"), [("2 juli 2026", (2026, 7, 2)), ("Jul 2, 2026", (2026, 7, 2)), ("2 foo 2026", None)])
def test_named_dates(spark, text, want):
    assert _one(spark, dates.parse_named, text) == (datetime.date(*want) if want else None)


@pytest.mark.parametrize(("text", "want"), [("2/2 Wavin Nederland B.V.", "wavin nederland bv"), ("Wavin-Nederland", "wavin nederland"), ("", "")])
def test_names(spark, text, want):
    assert _one(spark, identifiers.clean_name, text) == want
