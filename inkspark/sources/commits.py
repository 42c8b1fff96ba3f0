"""Tables under one folder that change by numbered commits, so that writers exclude each other and readers see whole states.

A commit is one small file, ``_commits/<number>.json``, that is put only if no
file of that number is there: it names the data files that each table gains, and
the range of their first key column. A reader lists the commits and reads what
they name: a snapshot. What a writer left without a commit isn't in any snapshot.

An append reads a snapshot, refuses if one of its keys is in it, writes its data
files and puts the next number. If another writer was faster, it looks only at
what was committed meanwhile, refuses if a key came in, and tries the number after.
So of two writers of one key, one is refused, whatever their order is. Only files
whose range of keys meets that of the new rows are looked at.

An append may also leave out keys that are there instead, which makes it safe to
run again; of new rows with one key the least by all columns is taken.

An append may carry the name of a transaction (a stream's batch, say): one that is
committed already isn't done again.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class KeyRefused(ValueError):
    """A key of an append is in the table already, or twice among its rows."""


class CommitLog:
    """``tables``: by name, the schema and the key columns. All tables of a commit change together."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, tuple[str, list[str]]]):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.tables = {name: (StructType.fromDDL(schema), keys) for name, (schema, keys) in tables.items()}
        self._known: list[dict] = []

    # Files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _put(self, number: int, body: str) -> bool:
        """Writes commit ``number`` whole, unless there is one; whether it did."""
        files, jvm = self._files(), self.spark._jvm
        target, beside = self._path(f"_commits/{number:012d}.json"), self._path(f"_commits/.{uuid.uuid4().hex}")
        out = files.create(beside, False)
        try:
            out.write(bytearray(body.encode()))
            out.hsync()
        finally:
            out.close()
        try:
            if files.getScheme() == "file":  # a hard link is what a local file system refuses to put over another file
                os.link(beside.toUri().getPath(), target.toUri().getPath())
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                context.rename(beside, target, options)
            return True
        except FileExistsError:
            return False
        except Exception as e:  # the gateway has one kind of error for all of Java's
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            files.delete(beside, False)

    def create(self) -> None:
        self._files().mkdirs(self._path("_commits"))

    def exists(self) -> bool:
        return self._files().exists(self._path("_commits"))

    def commits(self) -> list[dict]:
        """All commits in order. Those read before aren't read again, since they never change."""
        if not self.exists():
            return []
        files, folder = self._files(), self._path("_commits")
        names = sorted(x.getPath().getName() for x in files.listStatus(folder))
        for name in [x for x in names if x.endswith(".json")][len(self._known) :]:
            stream = files.open(self._path(f"_commits/{name}"))
            try:
                body = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            self._known.append(json.loads(body))
        return list(self._known)

    # Reading

    def version(self) -> int:
        """The number of commits."""
        return len(self.commits())

    def _load(self, name: str, parts: list[dict]) -> DataFrame:
        schema, _ = self.tables[name]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{p['path']}" for p in parts))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as it is after so many commits, or after all there are."""
        commits = self.commits()[:version]
        return self._load(name, [c["tables"][name] for c in commits if name in c["tables"]])

    # Appending

    def _written(self, name: str, rows: DataFrame) -> dict | None:
        """Data files of rows, and the range of their first key; None of no rows."""
        schema, keys = self.tables[name]
        path = f"{name}/{uuid.uuid4().hex}"
        cast = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
        cast.write.parquet(f"{self.folder}/{path}")
        own = self.spark.read.schema(schema).parquet(f"{self.folder}/{path}")
        low, high, n, different = own.agg(F.min(keys[0]).cast("string"), F.max(keys[0]).cast("string"), F.count(F.lit(1)), F.count_distinct(*keys)).first()
        if different != n:
            raise KeyRefused(f"{name}: keys stand twice or are null among the new rows")
        return {"path": path, "low": low, "high": high, "n": n} if n else None

    def _clashes(self, name: str, part: dict, others: list[dict]) -> bool:
        """Whether keys of new files are in others; only those whose ranges meet are read."""
        schema, keys = self.tables[name]
        value = lambda x: F.lit(x).cast(schema[keys[0]].dataType)
        there = [o["tables"][name] for o in others if name in o["tables"]]
        if not there:
            return False
        flags = self.spark.range(1).select(*(((value(o["low"]) <= value(part["high"])) & (value(part["low"]) <= value(o["high"]))).alias(str(i)) for i, o in enumerate(there))).first()
        near = [o for o, meets in zip(there, flags, strict=True) if meets]
        if not near:
            return False
        return not self._load(name, [part]).join(self._load(name, near).select(*keys), keys, "left_semi").isEmpty()

    def append(self, rows: dict[str, DataFrame], transaction: str | None = None, skip_known: bool = False) -> int:
        """Adds rows to tables, all or nothing: the commit's number. KeyRefused if a key is known (or it is left out); the number of before if the transaction is."""
        seen = 0
        parts: dict[str, dict] | None = None
        while True:
            commits = self.commits()
            for number, c in enumerate(commits):
                if transaction is not None and c["transaction"] == transaction:
                    return number
            if parts is None:
                given = {name: self._fresh(name, df, len(commits)) for name, df in rows.items()} if skip_known else rows
                parts = {name: part for name, df in given.items() if (part := self._written(name, df))}
                seen = len(commits) if skip_known else 0
            if any(self._clashes(name, part, commits[seen:]) for name, part in parts.items()):
                if not skip_known:
                    raise KeyRefused(f"{', '.join(parts)}: a key is there already")
                parts = None  # another writer brought it in meanwhile
                continue
            seen = len(commits)
            if self._put(seen, json.dumps({"transaction": transaction, "tables": parts}, sort_keys=True)):
                return seen

    def _fresh(self, name: str, rows: DataFrame, version: int) -> DataFrame:
        """Rows of keys that a snapshot doesn't have, one for each key. Rows without a key are none."""
        schema, keys = self.tables[name]
        cast = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema)).dropna(subset=keys)
        whole = F.struct(*cast.columns)
        one = cast.groupBy(*keys).agg(F.min_by(whole, F.to_json(whole)).alias("r")).select("r.*")
        return one.join(self.read(name, version).select(*keys), keys, "left_anti")

    def unreferenced(self) -> list[str]:
        """Data folders that no commit names, which failed or refused writers left."""
        named = {p["path"] for c in self.commits() for p in c["tables"].values()}
        files = self._files()
        found = [f"{name}/{x.getPath().getName()}" for name in self.tables if files.exists(self._path(name)) for x in files.listStatus(self._path(name))]
        return sorted(set(found) - named)

