"""Decisions, traces and progress from an append-only trail of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decisions(events: DataFrame, key: str) -> DataFrame:
    """Each decision with the one it supersedes and whether it is current: the last by (created_at, id)."""
    order = Window.partitionBy(key).orderBy("created_at", "id")
    return events.withColumns({"supersedes": F.lag("id").over(order), "status": F.when(F.lead("id").over(order).isNull(), "current").otherwise("superseded")})


def current(events: DataFrame, key: str) -> DataFrame:
    """The last row of each key. An aggregate, so a key of many rows is combined before the shuffle."""
    return events.groupBy(key).agg(F.max_by(F.struct(*events.columns), F.struct("created_at", "id")).alias("last")).select("last.*")


def contradicts(action: str, band: str):
    """A rejection of what the system didn't find high; without a band, nothing contradicts."""
    return F.coalesce((F.col(action) == "reject") & (F.col(band) != "high"), F.lit(False))


def trail_order(events: DataFrame, key: str, created_type: str) -> DataFrame:
    """Position in a run: events from its creation on first, then earlier ones, which a clock put wrong."""
    opened = F.min(F.when(F.col("event_type") == created_type, F.col("created_at"))).over(Window.partitionBy(key))
    rows = events.withColumn("__late", F.coalesce(F.col("created_at") < opened, F.lit(False)))
    order = Window.partitionBy(key).orderBy("__late", "created_at", "id")
    return rows.withColumn("position", F.row_number().over(order) - 1).drop("__late")


def stage_trace(events: DataFrame, key: str, created_type: str, tier_type: str) -> DataFrame:
    """Milliseconds of each tier since the one before, or since creation; never below 0, halves to even."""
    opened = F.min(F.when(F.col("event_type") == created_type, F.col("created_at"))).over(Window.partitionBy(key))
    rows = events.withColumn("__opened", opened).filter(F.col("event_type") == tier_type)
    order = Window.partitionBy(key).orderBy("created_at", "id")
    before = F.coalesce(F.lag("created_at").over(order), F.col("__opened"))
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    elapsed = F.greatest(F.bround((micros(F.col("created_at")) - micros(before)) / 1000), F.lit(0)).cast("long")
    return rows.withColumns({"stage": F.row_number().over(order), "elapsed_ms": elapsed}).drop("__opened")


def first_seen(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct values of a key with position, in the order in which they were first seen."""
    firsts = rows.groupBy(key, value).agg(F.min(F.struct("created_at", "id")).alias("__first"))
    return firsts.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("__first")) - 1).drop("__first")


def steps(completed: DataFrame, reported: DataFrame, key: str, value: str) -> DataFrame:
    """Completed values in order, then those that were only reported."""
    only = reported.join(completed.select(key, value), [key, value], "left_anti")
    rows = completed.select(key, value, "position", F.lit(0).alias("__part")).unionByName(only.select(key, value, "position", F.lit(1).alias("__part")))
    order = Window.partitionBy(key).orderBy("__part", "position", value)
    return rows.select(key, value, (F.row_number().over(order) - 1).alias("step"), (F.col("__part") == 0).alias("completed"))
