"""Amounts: strict and European notations, VAT and discount arithmetic, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

MONEY = "decimal(18,2)"


def strict(text: Column) -> Column:
    """Two decimals, half up; a comma is a point; anything else is null."""
    return F.round(F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("decimal(24,6)"), 2).cast(MONEY)


def european(text: Column) -> Column:
    """The last separator is the decimal one, others part thousands; without one there is no amount."""
    def read(kept: Column) -> Column:
        part = lambda i: F.regexp_extract(kept, "^(-?)([0-9.,]*)[.,]([^.,]*)$", i)
        parts = F.struct(F.regexp_extract(kept, "^(-?)", 1).alias("sign"), F.regexp_replace(part(2), "[.,]", "").alias("digits"), F.regexp_replace(part(3), "[^0-9]", "").alias("decimals"))
        made = lambda p: F.when(p["digits"].rlike("^[0-9]+$") & p["decimals"].rlike("^[0-9]+$"), F.concat(p["sign"], p["digits"], F.lit("."), p["decimals"]))
        return let(parts, made).try_cast("decimal(24,6)")

    return let(F.regexp_replace(F.regexp_replace(text, "(?i)\\bEUR\\b", ""), "[^0-9,.\\-]", ""), read)


def vat_rate(rate: Column) -> Column:
    """A whole rate of 0 to 100, else 21."""
    n = rate.try_cast("int")
    return F.when(n.between(0, 100), n).otherwise(F.lit(21))


def excl(amount: Column, rate: Column) -> Column:
    """Amount without VAT, half up."""
    return F.round(amount.cast("decimal(20,2)") * 100 / (100 + rate).cast("decimal(5,0)"), 2).cast(MONEY)


def discount(base: Column, pct: Column) -> Column:
    """Percentage of an amount, half to even."""
    return F.bround(base.cast("decimal(20,2)") * pct.cast("decimal(5,2)") / F.lit(100).cast("decimal(3,0)"), 2).cast(MONEY)


def dutch(amount: Column) -> Column:
    return F.replace(amount.cast(MONEY).cast("string"), F.lit("."), F.lit(","))
