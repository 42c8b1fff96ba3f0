"""Anchoring audit events: pending ones in order, batches, roots, signatures, and the stamp on each event.

All steps give new tables. What an update with a guard refuses (an event that is
missing, stands in a batch already or is named twice) is a row of a refusal
table, or an error where the caller asks for all or nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.functions import ed25519
from inkspark.functions.hashing import digest_or_null
from inkspark.operators import ledger

# What a verification's steps say.
CHECK_SENTENCES = {
    "root": "The root of the batch this record belongs to was read back from the log, which is never amended.",
    "record": "The stored record was hashed again from its own row and compared with the digest stored beside it.",
    "proof": "The path from this record's own place in its batch was walked up to that root, and the two were compared.",
}


def pending(events: DataFrame) -> DataFrame:
    """Events without a batch, in the order in which they are anchored."""
    return events.filter(F.col("batch").isNull()).orderBy("created_at", "id")


def refused(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of wanted (id, pos): those that can't be anchored, and why: twice, missing, batched or no_digest."""
    often = wanted.groupBy("id").agg(F.count(F.lit(1)).alias("__n"), F.min("pos").alias("pos"))
    rows = often.join(events.select("id", "batch", "digest"), "id", "left").join(events.select("id").withColumn("__there", F.lit(True)), "id", "left")
    why = F.when(F.col("__n") > 1, "twice").when(F.col("__there").isNull(), "missing").when(F.col("batch").isNotNull(), "batched").when(digest_or_null(F.col("digest")).isNull(), "no_digest")
    return rows.select("id", "pos", why.alias("why")).filter("why is not null")


def digests_of(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """Digests of wanted events (id, pos) in the caller's order, without those refused."""
    sound = wanted.join(refused(events, wanted).select("id"), "id", "left_anti")
    return sound.join(events.select("id", "digest"), "id").select("pos", "id", "digest").orderBy("pos")


def anchored(events: DataFrame, secret: bytes, size: int = ledger.BATCH) -> tuple[DataFrame, DataFrame]:
    """Stamps (id, batch, batch_index) and ledger entries (batch, n_leaves, merkle_root, signature) of all pending events.

    Batches are consecutive in order of (created_at, id) and numbered after the
    greatest batch there is. Roots are signed in Python, one a batch.
    """
    last = events.agg(F.coalesce(F.max("batch"), F.lit(-1)).alias("m")).first()["m"]
    open_ones = events.filter(F.col("batch").isNull()).drop("batch", "batch_index")
    new = ledger.batches(open_ones, ["created_at", "id"], size).withColumn("batch", F.col("batch") + F.lit(last + 1))
    roots = ledger.roots(new, size=size)
    return new.select("id", "batch", "batch_index"), roots.withColumn("signature", ed25519.signed(F.col("merkle_root"), secret))


def stamped(events: DataFrame, stamps: DataFrame) -> DataFrame:
    """Events with their batch and place in it. A stamp of an event that has another one is an error, and so is one without an event."""
    marks = stamps.select(F.col("id").alias("__id"), F.col("batch").alias("__batch"), F.col("batch_index").cast("long").alias("__at"))
    rows = events.join(marks, events["id"] == marks["__id"], "full_outer")
    clash = F.col("__id").isNotNull() & (F.col("id").isNull() | (F.col("batch").isNotNull() & (F.col("batch") != F.col("__batch"))))
    batch = F.when(clash, F.raise_error(F.concat(F.lit("can't stamp "), F.col("__id").cast("string"))).cast("long")).otherwise(F.coalesce("batch", "__batch"))
    out = rows.withColumns({"batch": batch, "batch_index": F.coalesce(F.col("batch_index").cast("long"), "__at")})
    return out.select(*events.columns)


def entries(ledger_rows: DataFrame) -> DataFrame:
    """The log in its own order."""
    return ledger_rows.orderBy("batch")


def entry(ledger_rows: DataFrame, batch: int) -> DataFrame:
    """One entry, or none."""
    return ledger_rows.filter(F.col("batch") == batch)


def salts(key: Column, seed: str | None = None) -> Column:
    """16 bytes in hexadecimal for each row: random, or fixed by a seed for tests."""
    if seed is None:
        return F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 32)


def sentences(checked: Column) -> Column:
    """A sentence for each check of an array, in its order. A check without one is an error."""
    known = F.create_map(*(F.lit(x) for kv in CHECK_SENTENCES.items() for x in kv))
    return F.transform(checked, lambda c: F.coalesce(known[c], F.raise_error(F.concat(F.lit("no sentence for "), F.coalesce(c, F.lit("null")))).cast("string")))


def explained(verified: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked id: outcome, batch and what was checked, in sentences. An id that no event has is unknown."""
    rows = asked.select("id").distinct().join(verified.select("id", "batch", "outcome", F.split("checked", ",").alias("c")), "id", "left")
    checked = F.filter(F.coalesce("c", F.array().cast("array<string>")), lambda x: x != "")
    return rows.select("id", F.coalesce("outcome", F.lit("unknown")).alias("status"), F.when(F.col("outcome") != "unknown", F.col("batch")).alias("batch"), sentences(checked).alias("checked"))
