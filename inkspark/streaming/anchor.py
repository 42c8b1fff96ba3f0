"""Anchoring as a running job: a stream of sealed events, each micro-batch put into ledger batches once.

A micro-batch's events go, in order of (created_at, id), into consecutive batches
of at most ``size``; roots are signed, and entries and stamps are one commit of a
``CommitLog`` under the name of the stream and the micro-batch. A run that is
killed before its commit leaves nothing in any snapshot; one that is killed after
it finds its transaction when the micro-batch comes again, and does nothing. So
each event is in one batch, once, whatever is restarted. Events that are stamped
already (another stream, or a source that repeats rows) are left out; two streams
that take the same event at once are told apart by the log, which refuses the
second's key.

A digest that isn't one is refused: the stream ends with an error and nothing of
that micro-batch is anchored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkspark.functions import ed25519
from inkspark.functions.hashing import digest_or_null
from inkspark.operators import ledger
from inkspark.sources.commits import CommitLog, KeyRefused

TABLES = {
    "ledger": ("batch bigint, n_leaves int, merkle_root string, signature string, anchored_at timestamp", ["batch"]),
    "stamps": ("id bigint, batch bigint, batch_index bigint", ["id"]),
}


def open_log(spark: SparkSession, folder: str) -> CommitLog:
    return CommitLog(spark, folder, TABLES)


def anchor_once(log: CommitLog, events: DataFrame, secret: bytes, transaction: str, size: int = ledger.BATCH) -> int:
    """Anchors what isn't anchored yet of events (id, created_at, digest) in one commit: its number."""
    sound = F.coalesce(digest_or_null(F.col("digest")), F.raise_error(F.concat(F.lit("no digest: event "), F.col("id").cast("string"))).cast("string"))
    events = events.select("id", "created_at", sound.alias("digest")).dropDuplicates(["id"])
    while True:
        version = log.version()
        try:
            return log.append(_anchored(log, version, events, secret, size), transaction)
        except KeyRefused:
            if log.version() == version:  # nobody was faster, so trying again gives the same
                raise


def _anchored(log: CommitLog, version: int, events: DataFrame, secret: bytes, size: int) -> dict[str, DataFrame]:
    """Stamps and entries of events that are open in a snapshot, which also says what the next batch is."""
    stamps, entries = log.read("stamps", version), log.read("ledger", version)
    last = entries.agg(F.coalesce(F.max("batch"), F.lit(-1)).alias("m")).first()["m"]
    fresh = events.join(stamps.select("id"), "id", "left_anti")
    batched = ledger.batches(fresh, ["created_at", "id"], size).withColumn("batch", F.col("batch") + F.lit(last + 1))
    roots = ledger.roots(batched, size=size).withColumns({"signature": ed25519.signed(F.col("merkle_root"), secret), "anchored_at": F.current_timestamp()})
    return {"stamps": batched.select("id", "batch", "batch_index"), "ledger": roots}


def anchoring(events: DataFrame, log: CommitLog, secret: bytes, checkpoint: str, name: str = "anchoring", size: int = ledger.BATCH, **trigger) -> StreamingQuery:
    """Starts the stream. ``trigger`` is what ``DataStreamWriter.trigger`` takes, as availableNow=True."""

    def each(batch: DataFrame, number: int) -> None:
        anchor_once(log, batch, secret, f"{name}:{number}", size)

    return events.writeStream.foreachBatch(each).queryName(name).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()
