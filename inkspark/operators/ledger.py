"""Batches of audit events, Merkle trees over them, proofs and verification.

A tree is built level by level; each level halves the rows, and a level's last
node without a sibling moves up unchanged, which is the same tree as splitting
at the largest power of two. A batch has a bounded size, so the number of
levels is fixed by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.functions.hashing import digest_or_null, leaf_hash, node_hash
from inkspark.operators.ordering import numbered

BATCH = 25


def batches(events: DataFrame, order: list[str], size: int = BATCH) -> DataFrame:
    """Consecutive chunks: batch and batch_index."""
    rows = numbered(events, order, "__at")
    return rows.withColumns({"batch": F.floor(F.col("__at") / size), "batch_index": F.pmod("__at", F.lit(size))}).drop("__at")


def _levels(size: int) -> int:
    n, levels = size, 0
    while n > 1:
        n, levels = (n + 1) // 2, levels + 1
    return levels


def leaves(events: DataFrame, batch: str = "batch", index: str = "batch_index", digest: str = "digest", size: int = BATCH) -> DataFrame:
    """Leaves of each batch in order, in one row: a batch is at most ``size`` digests, so the row is bounded."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), leaf_hash(F.col(digest)).alias("h"))))
    n = F.count(F.lit(1))
    rows = events.groupBy(batch).agg(pairs.alias("p"), n.alias("n"))
    sound = F.when(F.col("n") <= size, F.col("p")).otherwise(F.raise_error(F.lit("a batch is over its size")).cast("array<struct<i:bigint,h:string>>"))
    return rows.select(batch, F.transform(sound, lambda x: x["h"]).alias("leaves"))


def _up(level):
    """The level above: neighbours paired, the last one without a sibling as it is."""
    half = F.ceil(F.size(level) / 2).cast("int")
    return F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.coalesce(node_hash(F.get(level, 2 * i), F.get(level, 2 * i + 1)), F.get(level, 2 * i)))


def roots(events: DataFrame, batch: str = "batch", index: str = "batch_index", digest: str = "digest", size: int = BATCH) -> DataFrame:
    """Merkle root of each batch."""
    rows = leaves(events, batch, index, digest, size).withColumn("__level", F.col("leaves"))
    for _ in range(_levels(size)):
        rows = rows.withColumn("__level", F.when(F.size("__level") > 1, _up(F.col("__level"))).otherwise(F.col("__level")))
    return rows.select(batch, F.size("leaves").alias("n_leaves"), F.get("__level", 0).alias("merkle_root"))


def proofs(events: DataFrame, batch: str = "batch", index: str = "batch_index", digest: str = "digest", size: int = BATCH) -> DataFrame:
    """For each event, siblings from leaf to root with their side; no sibling, no step."""
    levels = leaves(events, batch, index, digest, size).withColumn("__l0", F.col("leaves"))
    n = _levels(size)
    for k in range(n):
        levels = levels.withColumn(f"__l{k + 1}", F.when(F.size(f"__l{k}") > 1, _up(F.col(f"__l{k}"))).otherwise(F.col(f"__l{k}")))
    rows = levels.select("*", F.posexplode("leaves").alias("__i", "leaf"))
    steps = []
    for k in range(n):
        at = F.floor(F.col("__i") / (1 << k)).cast("int")
        sibling = F.get(F.col(f"__l{k}"), F.when(at % 2 == 0, at + 1).otherwise(at - 1))
        step = F.concat(F.when(at % 2 == 0, "R:").otherwise("L:"), sibling)
        steps.append(F.when((F.size(f"__l{k}") > 1), step))
    return rows.select(batch, F.col("__i").cast("long").alias(index), "leaf", F.array_compact(F.array(*steps)).alias("proof"))


def folded(leaf, proof):
    """The root that a proof leads a leaf to; null if a step is malformed."""
    sound = F.forall(proof, lambda s: s.rlike("^[LR]:[0-9a-f]{64}$"))
    step = lambda h, s: F.when(F.substring(s, 1, 1) == "L", node_hash(F.substring(s, 3, 64), h)).otherwise(node_hash(h, F.substring(s, 3, 64)))
    return F.when(sound, F.aggregate(proof, leaf, step))


def verification(events: DataFrame, ledger: DataFrame, size: int = BATCH) -> DataFrame:
    """unknown, altered or verified for each event, with the checks made, in their fixed order.

    events: id, batch, batch_index, digest (stored), recomputed (null if it
    can't be); ledger: batch, merkle_root.
    """
    batched = events.filter(F.col("batch").isNotNull())
    sound = batched.groupBy("batch").agg(
        (F.max("batch_index") == F.count(F.lit(1)) - 1).alias("__dense"),
        (F.count_distinct("batch_index") == F.count(F.lit(1))).alias("__distinct"),
        F.bool_and(digest_or_null(F.col("digest")).isNotNull()).alias("__digests"),
    )
    whole = sound.select("batch", (F.col("__dense") & F.col("__distinct") & F.col("__digests")).alias("__sound"))
    computed = roots(batched, size=size).select("batch", F.col("merkle_root").alias("__root"))
    joined = events.join(ledger.select("batch", F.col("merkle_root").alias("__anchored")), "batch", "left").join(whole, "batch", "left").join(computed, "batch", "left")
    anchored = digest_or_null(F.col("__anchored")).isNotNull()
    hashed = anchored & F.col("recomputed").isNotNull()
    same = hashed & (F.col("recomputed") == F.col("digest"))
    proved = same & F.coalesce("__sound", F.lit(False))
    outcome = (
        F.when(~anchored | ~hashed, "unknown").when(~same, "altered").when(~proved, "unknown")
        .when(F.col("__root") == F.col("__anchored"), "verified").otherwise("altered")
    )
    checked = F.array_compact(F.array(F.when(anchored, "root"), F.when(hashed, "record"), F.when(proved, "proof")))
    return joined.select("id", "batch", outcome.alias("outcome"), F.array_join(checked, ",").alias("checked"))


def append_batches(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """New ledger rows whose batch isn't there yet."""
    return new.join(ledger.select("batch"), "batch", "left_anti")
