"""Pages of a long list, each read from the ranges it lies in.

Rows are written once in read order, a folder for each range of the order, each
with its rows' places. How many rows a range has, and so where it starts, is a
table of one row a range. A page's range comes from that table, and only
that range's files are opened; so page 10,000 costs what page 1 does,
where offset and limit sort all rows up to the page.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.operators.screenings import DEFAULT_PAGE, MAX_PAGE


class Pages:
    """A list under one folder. It is a snapshot: rows that come later are in the next one that is built."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._starts: list[int] | None = None

    def build(self, rows: DataFrame, order: list[str], ranges: int | None = None) -> Pages:
        """Writes the rows. ``ranges``: how many, by default as many as a shuffle has partitions."""
        dealt = rows.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
        # A task's rows are one range; its place is the lower bits of an id that counts within the task.
        placed = dealt.withColumn("__id", F.monotonically_increasing_id()).withColumns({"__range": F.shiftright("__id", 33).cast("int"), "__place": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id")
        placed.write.partitionBy("__range").parquet(f"{self.folder}/rows")
        rows.limit(0).write.parquet(f"{self.folder}/columns")
        stored = self.spark.read.schema(placed.schema).parquet(f"{self.folder}/rows")
        stored.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{self.folder}/ranges")
        return self

    def _ranges(self) -> tuple[list[int], list[int]]:
        """Ranges that have rows, in order, and at which position each starts (and the end)."""
        if self._starts is None:
            found = sorted((r["__range"], r["n"]) for r in self.spark.read.parquet(f"{self.folder}/ranges").collect())
            self._names = [k for k, _ in found]
            self._starts = list(accumulate((n for _, n in found), initial=0))
        return self._names, self._starts

    def count(self) -> int:
        return self._ranges()[1][-1]

    def page(self, offset: int = 0, limit: int = DEFAULT_PAGE) -> DataFrame:
        """Rows from a position on, in read order, as ``offset`` and ``limit`` give them."""
        if offset < 0 or not 1 <= limit <= MAX_PAGE:
            raise ValueError(f"offset from 0, limit from 1 to {MAX_PAGE}")
        names, starts = self._ranges()
        first = max(0, bisect_right(starts, offset) - 1)
        mine = [(k, s) for k, s in zip(names[first:], starts[first:], strict=False) if s < offset + limit]
        if not mine:
            return self.spark.read.parquet(f"{self.folder}/columns").limit(0)
        rows = self.spark.read.option("basePath", f"{self.folder}/rows").parquet(*(f"{self.folder}/rows/__range={k}" for k, _ in mine))
        position = F.create_map(*(F.lit(x) for pair in mine for x in pair))[F.col("__range")] + F.col("__place")
        kept = rows.filter((position >= offset) & (position < offset + limit))
        return kept.orderBy("__range", "__place").drop("__range", "__place")
