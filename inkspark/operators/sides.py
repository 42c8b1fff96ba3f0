"""Small sides of joins: sent to all executors only behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 10_000


def small(side: DataFrame, most: int = ROWS) -> DataFrame:
    """The side marked for broadcast if it has at most so many rows, else as it is. At most one row more than that is counted."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side
