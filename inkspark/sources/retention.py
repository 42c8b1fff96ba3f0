"""Stored contents by day, and retention that deletes them: mark, then sweep.

A content is stored once for each digest, in the folder of the day it was written
(``day=YYYY-MM-DD``), so what a window can touch is found by partition pruning.

Mark: contents of days before the window whose digest no live row refers to. That
is an anti-join over digests; contents aren't read. What is marked is written as a
report before anything is deleted.

Sweep: a day of which nothing stays is removed as a folder. Of others the rows
that stay are written aside and take the day's place. A digest is reported only by
the sweep that found it stored, so a second one reports nothing. A sweep that is
killed leaves each day as it was or as it should be, or, between the two steps of
taking a place, aside under the day's name, which the next sweep puts back first.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.sources.blobs import parsed_reference

#: Days that evidence is kept.
EVIDENCE_DAYS = 90


class DailyStore:
    """Contents (digest, size, more columns) under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self._path("")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def add(self, rows: DataFrame, day: datetime.date) -> None:
        """Stores contents whose digest isn't stored yet, under a day."""
        self.put(rows.withColumn("day", F.lit(day)))

    def put(self, rows: DataFrame) -> None:
        """The same of rows that have their day; of equal digests the earliest day's is stored."""
        columns = [c for c in rows.columns if c not in ("digest", "day")]
        new = rows.groupBy("digest").agg(F.min(F.struct("day", *columns)).alias("r")).select("digest", *(f"r.{c}" for c in columns), "r.day")
        if self._days():
            new = new.join(self.read().select("digest"), "digest", "left_anti")
        new.repartition("day").write.mode("append").partitionBy("day").parquet(f"{self.folder}/contents")

    def _days(self) -> list[str]:
        fs = self._fs()
        if not fs.exists(self._path("contents")):
            return []
        return sorted(n.removeprefix("day=") for x in fs.listStatus(self._path("contents")) if (n := x.getPath().getName()).startswith("day="))

    def read(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/contents").parquet(*(f"{self.folder}/contents/day={d}" for d in self._days()))

    def marked(self, references: DataFrame, now: datetime.datetime, days: int = EVIDENCE_DAYS) -> DataFrame:
        """digest, size and day of contents that are over the window's days old and that no row (reference: sha256:digest:size, null: none) refers to."""
        if days < 1:
            raise ValueError("a window has a day at least")
        if now.tzinfo is None:
            raise ValueError("a moment needs a time zone")
        held = references.select(parsed_reference(F.col("reference"))["digest"].alias("digest")).filter("digest is not null").distinct()
        last = (now.astimezone(datetime.timezone.utc) - datetime.timedelta(days=days)).date()
        return self.read().filter(F.col("day") < F.lit(last)).select("digest", "size", "day").join(held, "digest", "left_anti")

    def sweep(self, references: DataFrame, now: datetime.datetime, days: int = EVIDENCE_DAYS) -> DataFrame:
        """Deletes what is marked; gives the digests it deleted."""
        self._recover()
        if not self._days():
            return self.spark.createDataFrame([], "digest string, size long, day date")
        report = f"{self.folder}/sweeps/{uuid.uuid4().hex}"
        self.marked(references, now, days).write.parquet(report)
        gone = self.spark.read.schema("digest string, size long, day date").parquet(report)
        for row in gone.select("day").distinct().orderBy("day").collect():
            self._rewrite(row["day"].isoformat(), gone.filter(F.col("day") == F.lit(row["day"])).select("digest"))
        return gone

    def _rewrite(self, day: str, gone: DataFrame) -> None:
        fs, place, aside = self._fs(), self._path(f"contents/day={day}"), self._path(f"aside/day={day}")
        stays = self.spark.read.parquet(f"{self.folder}/contents/day={day}").join(gone, "digest", "left_anti")
        if stays.isEmpty():
            fs.delete(place, True)
            return
        draft = f"drafts/{uuid.uuid4().hex}"
        stays.write.parquet(f"{self.folder}/{draft}")
        fs.mkdirs(self._path("aside"))
        fs.rename(self._path(draft), aside)
        fs.delete(place, True)
        fs.rename(aside, place)

    def _recover(self) -> None:
        """What stands aside is whole: it takes its day's place."""
        fs = self._fs()
        if not fs.exists(self._path("aside")):
            return
        for x in fs.listStatus(self._path("aside")):
            name = x.getPath().getName()
            fs.delete(self._path(f"contents/{name}"), True)
            fs.rename(x.getPath(), self._path(f"contents/{name}"))
