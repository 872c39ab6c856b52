"""Arrays turned into rows.

A plain explode lets the optimizer infer a filter on the array's size and push it below the projections that make the
array, which are then computed twice, and whatever they name again and again inside their lambdas. The outer form has no
such filter; the rows of empty arrays are dropped afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(df: DataFrame, keep: list, array: Column | str, pos: str = "pos", value: str = "col") -> DataFrame:
    """keep, pos, value: a row per item of array, with its place from 0; none for null and empty arrays."""
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).where(F.col(pos).isNotNull())


def each_struct(df: DataFrame, keep: list, array: Column | str, required: str) -> DataFrame:
    """keep and the fields of each struct of array; required is a field that is never null in it."""
    return df.select(*keep, F.inline_outer(array)).where(F.col(required).isNotNull())
