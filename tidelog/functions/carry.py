"""What was last known before each row of an ordered stream, however long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of the order, the most that one window task holds of a key.
BLOCK = 1 << 16


def last_before(rows: DataFrame, keys: list[str], order: str, values: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """rows with, for each name, the value of the latest row of equal keys and smaller order that has one; null where none has.

    Wrap a value in a struct where its own null is to be carried. The order is a whole number, one row of a key has it at
    most. Carried on two levels: the last value of each block of the order, from block to block (a row a key and block),
    and inside a block, so that no task gets a whole key.
    """
    held = rows.withColumns({f"_own_{n}": v for n, v in values.items()}).withColumn("_block", F.floor(F.col(order) / block))
    last = held.groupBy(*keys, "_block").agg(*(F.max_by(F.col(f"_own_{n}"), F.when(F.col(f"_own_{n}").isNotNull(), F.col(order))).alias(f"_last_{n}") for n in values))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select(*keys, "_block", *(F.last(f"_last_{n}", ignorenulls=True).over(earlier).alias(f"_before_{n}") for n in values))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumns({f"_in_{n}": F.last(f"_own_{n}", ignorenulls=True).over(inside) for n in values})
    out = held.join(before, [*keys, "_block"])
    return out.select(*(F.col(c) for c in rows.columns), *(F.coalesce(f"_in_{n}", f"_before_{n}").alias(n) for n in values))
