"""Evaluate an expression once a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later filters and projections refer to and do not repeat.

    The optimizer pushes filters through projections by copying expressions, which multiplies costly
    ones (patterns over a text); it does not push them through this one-row explode.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def once_each(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """df with several such columns, all evaluated once a row."""
    return df.select("*", F.inline(F.array(F.struct(*(v.alias(n) for n, v in values.items())))))
