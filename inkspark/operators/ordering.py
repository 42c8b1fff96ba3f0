"""Positions and running sums over a whole table's order, without one task for all rows.

Rows are dealt by ranges of the order and sorted within each, and written once:
what a row's range is then is data, the same for all later steps, whatever is
planned, adapted or run again. One row a range, moved on by the ranges before,
gives what to add; that table is bounded by the number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspark.stored import written

#: An id's upper bits are its partition, its lower ones its place there.
_PLACE_BITS = 33


def _ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with __part (range) and __row (place in it, from 0), as stored data."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    stored = written(ranged, "ranged")
    return stored.withColumns({"__part": F.shiftright("__id", _PLACE_BITS), "__row": F.col("__id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))}).drop("__id")


def _before(stored: DataFrame, amount: Column) -> DataFrame:
    """Sum of the amounts in the ranges before each range: one row a range."""
    sizes = stored.groupBy("__part").agg(F.sum(amount).alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")


def numbered(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Adds the 0-based position in a total order. The rows are written when this is called."""
    stored = _ranged(rows, order)
    # One row a partition of the shuffle, so it is broadcast.
    moved = stored.join(F.broadcast(_before(stored, F.lit(1))), "__part")
    return moved.withColumn(name, F.col("__before") + F.col("__row")).select(*rows.columns, name)


def sums_before(rows: DataFrame, order: list[str], amount: str, name: str = "before") -> DataFrame:
    """Adds the sum of ``amount`` over all rows before in a total order. The rows are written when this is called."""
    stored = _ranged(rows, order)
    within = Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    moved = stored.withColumn("__within", F.coalesce(F.sum(amount).over(within), F.lit(0))).join(F.broadcast(_before(stored, F.col(amount))), "__part")
    return moved.withColumn(name, F.col("__before") + F.col("__within")).select(*rows.columns, name)
