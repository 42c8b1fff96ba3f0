"""Append-only tables of screenings, events and ledger entries, and where they may be.

Tables are Parquet under one commit log (``commits``). Appends leave out keys that
are there already, so a batch that is run again after a loss adds nothing twice,
and two writers at once don't either; entries of the ledger may be refused
instead. There is no update and no delete: a deletion is a tombstone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from inkspark.sources.commits import CommitLog

SCHEMAS = {
    "screenings": "id string, created_at timestamp, document_type string, status string, score double, band string, mode string, filename string, image_width int, image_height int, image_blob_ref string, ruleset_version string, model_versions map<string,string>, quality string, summary string, request_id string",
    "events": "id string, screening_id string, event_type string, actor string, payload string, record_hash string, record_salt string, created_at timestamp",
    "ledger": "batch bigint, merkle_root string, signature string, anchored_at timestamp",
    "tombstones": "id string, at timestamp",
    "tier_latency": "screening_id string, tier string, elapsed_ms bigint, flags_found int, hard_failed boolean",
    "cascade_outcome": "screening_id string, tiers int, elapsed_ms bigint, flags_found int, hard_failed boolean, escalated boolean",
}
KEYS = {"screenings": ["id"], "events": ["id"], "ledger": ["batch"], "tombstones": ["id", "at"], "tier_latency": ["screening_id", "tier"], "cascade_outcome": ["screening_id"]}
#: Tables whose rows are never changed or removed.
APPEND_ONLY = ["events", "ledger"]
# The vocabulary of the trail.
EVENT_TYPES = ["screening_created", "tier_completed", "analysis_completed", "officer_decision", "override_recorded", "screening_deleted"]


def checked_url(url: str) -> str:
    """A JDBC or file URL of a known kind; others are refused."""
    if not re.match(r"^(jdbc:(postgresql|sqlite):|file:|hdfs:|s3a?:|abfss?:|gs:|viewfs:|/)", url):
        raise ValueError("not a store this engine knows")
    return url


# The tiers of a run.
TIERS = ["tier0", "tier1", "tier2"]


def observed_trace(trace: DataFrame, tiers: list[str] = TIERS) -> tuple[DataFrame, Observation]:
    """The same rows, and what an action over them will have observed: number, time, flags and hard failures of each tier."""
    found = []
    for k, tier in enumerate(tiers):
        own = F.col("tier") == tier
        amount = lambda c, own=own: F.sum(F.when(own, c).otherwise(0))
        found += [
            F.count_if(own).alias(f"{k}.runs"), amount(F.col("elapsed_ms")).alias(f"{k}.elapsed_ms"), F.max(F.when(own, F.col("elapsed_ms"))).alias(f"{k}.slowest_ms"),
            amount(F.col("flags_found")).alias(f"{k}.flags"), F.count_if(own & F.col("hard_failed")).alias(f"{k}.hard_failures"),
        ]
    observation = Observation()
    return trace.observe(observation, *found), observation


def by_tier(observation: Observation, tiers: list[str] = TIERS) -> dict[str, dict[str, int]]:
    """Waits for the action and gives its metrics by tier, those of no row as 0."""
    got = observation.get
    return {tier: {name.split(".")[1]: value or 0 for name, value in got.items() if name.startswith(f"{k}.")} for k, tier in enumerate(tiers)}


class Store:
    """Tables under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, checked_url(folder)
        self.log = CommitLog(spark, folder, {name: (schema, KEYS[name]) for name, schema in SCHEMAS.items()})

    def _known(self, name: str) -> str:
        if name not in SCHEMAS:
            raise ValueError(f"no table {name}")
        return name

    def create(self) -> None:
        """Makes the folder, which may be there."""
        self.log.create()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as it is now, or as it was after so many commits."""
        return self.log.read(self._known(name), version)

    def append(self, name: str, rows: DataFrame) -> int:
        """Rows whose key isn't in the table, one for each key; the number of the commit."""
        return self.log.append({self._known(name): rows}, skip_known=True)

    def anchor(self, entries: DataFrame) -> int:
        """Ledger entries, all or none: a batch that is there is refused."""
        return self.log.append({"ledger": entries})

    def emit(self, rows: DataFrame) -> None:
        """Events (id, screening_id, event_type, actor, payload, record_salt, created_at), sealed and appended."""
        from inkspark.functions.hashing import canonical, json_text, record_hash

        known = F.col("event_type").isin(EVENT_TYPES)
        event = F.when(known, F.col("event_type")).otherwise(F.raise_error(F.concat(F.lit("unknown event "), "event_type")).cast("string"))
        record = canonical({"actor": json_text(F.col("actor")), "event_type": json_text(event), "payload": F.col("payload"), "screening_id": json_text(F.col("screening_id"))})
        self.append("events", rows.withColumn("record_hash", record_hash(F.col("record_salt"), record)))

    def amend(self, name: str, *_: object) -> None:
        """There is no way to change or remove rows of the trail and the log; elsewhere rows are superseded by new ones."""
        raise PermissionError(f"{name} is append-only" if name in APPEND_ONLY else f"{name} takes new rows or tombstones")

    def screening(self, key: str) -> DataFrame:
        """One live screening, or none."""
        return self.live().filter(F.col("id") == key)

    def event(self, key: str) -> DataFrame:
        return self.read("events").filter(F.col("id") == key)

    def batch(self, number: int) -> DataFrame:
        return self.read("ledger").filter(F.col("batch") == number)

    def batches(self) -> Iterator[Row]:
        """The log's entries in their order, one partition at a time in memory."""
        return self.read("ledger").orderBy("batch").toLocalIterator()

    def measured(self, trace: DataFrame) -> dict[str, dict[str, int]]:
        """Appends the latency of each tier from a trace (screening_id, tier, elapsed_ms, flags_found, hard_failed, escalated); the run's metrics by tier.

        Metrics are observed while the rows are written, so the trace is computed once.
        """
        rows, observed = observed_trace(trace)
        self.append("tier_latency", rows)
        return by_tier(observed)

    def outcomes(self, trace: DataFrame) -> None:
        """Appends the outcome of each run of a trace."""
        total = trace.groupBy("screening_id").agg(F.count(F.lit(1)).cast("int").alias("tiers"), F.sum("elapsed_ms").alias("elapsed_ms"), F.sum("flags_found").cast("int").alias("flags_found"), F.bool_or("hard_failed").alias("hard_failed"), F.bool_or("escalated").alias("escalated"))
        self.append("cascade_outcome", total)

    def live(self) -> DataFrame:
        """Screenings without a tombstone."""
        return self.read("screenings").join(self.read("tombstones").select("id").distinct(), "id", "left_anti")

    def pending(self) -> DataFrame:
        """Ids of screenings that no analysis has completed: what a micro-batch takes next."""
        done = self.read("events").filter("event_type = 'analysis_completed'").select(F.col("screening_id").alias("id")).distinct()
        return self.live().join(done, "id", "left_anti")

    def ready(self) -> bool:
        """Whether the tables answer."""
        self.spark.sql("select 1").collect()
        if not self.log.exists():
            raise FileNotFoundError(self.folder)
        self.read("ledger").limit(1).collect()
        return True


def guards(dialect: str) -> list[str]:
    """Statements that make a database itself refuse changes to the trail and the log, for tables kept there."""
    if dialect not in ("sqlite", "postgresql"):
        raise ValueError("not a database this engine knows")
    out = []
    for table in APPEND_ONLY:
        for act in ("UPDATE", "DELETE"):
            name = f"refuse_{act.lower()}_{table}"
            if dialect == "sqlite":
                out.append(f"CREATE TRIGGER IF NOT EXISTS {name} BEFORE {act} ON {table} BEGIN SELECT RAISE(ABORT, '{table} is append-only'); END")
            else:
                out.append(f"CREATE OR REPLACE FUNCTION {name}() RETURNS trigger LANGUAGE plpgsql AS $$ BEGIN RAISE EXCEPTION '{table} is append-only'; END $$")
                out.append(f"CREATE OR REPLACE TRIGGER {name} BEFORE {act} ON {table} FOR EACH STATEMENT EXECUTE FUNCTION {name}()")
    return out


def tables(dialect: str) -> list[str]:
    """Statements that create the tables in a database, with an index for each way they are read."""
    kinds = {"string": "TEXT", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE PRECISION", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "map<string,string>": "TEXT"}
    out = []
    for name, schema in SCHEMAS.items():
        columns = [c.rsplit(" ", 1) if not c.endswith(">") else c.split(" ", 1) for c in re.split(r", (?=[a-z_]+ )", schema)]
        out.append(f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(f'{c} {kinds[t]}' for c, t in columns)}, PRIMARY KEY ({', '.join(KEYS[name])}))")
    out += [f"CREATE INDEX IF NOT EXISTS ix_{t}_{c} ON {t} ({c})" for t, c in (("screenings", "band"), ("screenings", "created_at"), ("events", "screening_id"))]
    return [x.replace("DOUBLE PRECISION", "REAL") for x in out] if dialect == "sqlite" else out


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int) -> DataFrame:
    """A table of a database, read in ranges of a key so that executors share it. Its driver must be on the class path."""
    reader = spark.read.format("jdbc").option("url", checked_url(url)).option("dbtable", table)
    return reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", partitions).load()
