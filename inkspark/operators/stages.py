"""Tiers of checks in order: each takes what the one before let through and gives flags.

A stage is any function from documents to flags (see evidence.COLUMNS), so
checks of other origin plug in by being listed. Documents with a hard failure
don't reach the next, dearer stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.operators import evidence

Stage = Callable[[DataFrame], DataFrame]


def cascade(documents: DataFrame, key: str, stages: list[tuple[str, Stage]], isolate: bool = False) -> tuple[DataFrame, DataFrame]:
    """All flags with their stage, and one row a document and stage it reached: stage, position, flags_added, hard_failed, failed.

    With ``isolate``, a stage that can't be planned is left out and marked as
    failed for every document that reached it; otherwise its error is raised.
    """
    flags, traces, rows = [], [], documents
    for position, (name, stage) in enumerate(stages):
        reached = rows.select(F.col(key).alias("key"))
        try:
            found = stage(rows).select(*evidence.COLUMNS)
        except AnalysisException:
            if not isolate:
                raise
            traces.append(reached.select("key", F.lit(name).alias("stage"), F.lit(position).alias("position"), F.lit(0).cast("long").alias("flags_added"), F.lit(False).alias("hard_failed"), F.lit(True).alias("failed")))
            continue
        counts = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bool_or("hard").alias("h"))
        joined = reached.join(counts, "key", "left")
        traces.append(joined.select("key", F.lit(name).alias("stage"), F.lit(position).alias("position"), F.coalesce("n", F.lit(0)).alias("flags_added"), F.coalesce("h", F.lit(False)).alias("hard_failed"), F.lit(False).alias("failed")))
        flags.append(found.withColumn("stage", F.lit(name)))
        rows = evidence.survivors(rows, key, found)
    if not flags:
        raise ValueError("no stage could be planned")
    return reduce(DataFrame.unionByName, flags), reduce(DataFrame.unionByName, traces)
