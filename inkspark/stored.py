"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where it is unset and all runs on one machine, as in tests, a local one
    is set. On a cluster executors would write to their own disks, so that is an
    error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scope:
    """The intermediate tables of one run, which alone owns and deletes them."""

    def __init__(self) -> None:
        self.tables: list[tuple[DataFrame, str]] = []

    def discard(self, *keep: DataFrame) -> int:
        """Deletes the scope's tables but for those given; how many there were."""
        gone = [(t, path) for t, path in self.tables if not any(t is k for k in keep)]
        self.tables = [(t, path) for t, path in self.tables if any(t is k for k in keep)]
        n = 0
        for table, name in gone:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        return n


_current: ContextVar[Scope | None] = ContextVar("tables", default=None)


@contextmanager
def scope() -> Iterator[Scope]:
    """Tables written inside belong to the scope, by thread; what is left of them at the end, to the scope around.

    A result that still reads them can be used after the end, until the scope
    around, or the caller, discards them.
    """
    own, around = Scope(), _current.get()
    token = _current.set(own)
    try:
        yield own
    finally:
        _current.reset(token)
        if around is not None:
            around.tables += own.tables


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Later steps prune its columns and, when an executor is lost, read files
    that all machines share instead of running the lineage again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if (own := _current.get()) is not None:
        own.tables.append((table, path))
    return table
