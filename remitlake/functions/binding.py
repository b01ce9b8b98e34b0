"""Values that an expression or later steps read more than once, worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``; without this Spark writes ``value`` out at each place, and methods grow beyond what it compiles.

    A fold of one step: an element taken from a transformed array has its type worked out anew, from all
    that ``use`` holds, for each row.
    """
    return F.aggregate(F.array(F.lit(0)), value, lambda kept, _: kept, use)


def settle(rows: DataFrame, *columns: Column) -> DataFrame:
    """``rows`` with ``columns``; without this Spark writes them out again in each filter, and in those it adds to an explode."""
    return rows.select("*", F.inline(F.array(F.struct(*columns))))
