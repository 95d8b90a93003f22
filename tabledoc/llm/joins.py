"""Joins of large tables with sides that may be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabledoc.session import materialise


def small_side(df: DataFrame, weight: Column | None = None, most: int = 1_000_000) -> DataFrame:
    """``df`` written once, and broadcast only if its counted size allows; else left to Spark's choice.

    The size is the number of rows, or the sum of ``weight`` over them.
    """
    side = materialise(df, "side")
    size = side.agg(F.sum(weight) if weight is not None else F.count("*")).first()[0] or 0
    return F.broadcast(side) if size <= most else side
