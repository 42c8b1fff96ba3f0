"""Near copies: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

SimHash only proposes pairs; each is verified by the exact similarity of the two
texts before it links them, so what links is similar, and groups are chains of
similar pairs.

Nodes: documents of the same words (bytes, A-Z in lower case) are one node, so
a group of exact copies is one row in all later steps.

Candidates: each node has fingerprints of ``views`` views over 3-word shingles,
which differ less than longer ones. Pairs that meet in a part of one of them
(generalised pigeonhole of 3 bits over four parts, so all pairs within 3 bits
do) and are within ``reach`` bits there may be candidates; the parts find most
pairs that are farther apart too. Of these, the join lets only those pass whose
further fingerprints, over 5-word shingles, differ in no more bits than texts of
similarity 0.8 do but for three standard deviations, first of 256 bits, then of
2,048. That is one rule for all pairs. Where a bucket has over ``CROWD`` nodes the
2,048 bits are compared in the join, so a family of texts that are alike, but
less, doesn't leave it as a table of all pairs; elsewhere after it.

Groups: each node is first verified against a few nodes that share a part of a
fingerprint, and what is similar is made components. Only pairs of different
components are candidates then, so a large group of copies isn't compared pair
by pair. Pairs of a family of texts that are alike but less than ``LEAST``
similar have all to be verified.

Defined results: one row stays of each group, the one of the smallest doc_id
and, of equal ones, the smallest hash of its text; null doc_ids come last. Rows
equal in doc_id and text are one. Null texts, empty ones and those of
white space are copies of each other. Hashes of nodes and shingles have 64 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.llm.common import scope, written
from inkspark.llm.graph import components
from inkspark.llm.simhash import BITS, bit_counts, fingerprint_views, near_links, plan_search
from inkspark.operators.sides import small

VIEWS = 10
REACH = 12
SHINGLE = 5
LEAST = 0.8
#: Fingerprints of SHINGLE words, 64 bits each, that estimate the similarity in the join: of all nodes, and more of crowded ones.
MARKS, WIDE = 4, 28
MARK_NAMES = [f"mark{i}" for i in range(MARKS)]
CROWD = 64
#: Largest number of rows' keys that are sent to all executors: some 40 bytes each.
KEYS = 200_000
#: Views in which nodes are first compared to one other of each bucket.
STAR_VIEWS = 4


def most_differing(least: float = LEAST, bits: int = MARKS * BITS) -> int:
    """So many bits of fingerprints differ at most if sets have a Jaccard similarity, but for three standard deviations over the mean.

    A bit differs with the share of the angle between the sets; their cosine is
    2 J / (1 + J) at least.
    """
    p = math.acos(2 * least / (1 + least)) / math.pi
    return int(bits * p + 3 * math.sqrt(bits * p * (1 - p)))


def words(text: str | None) -> list[bytes]:
    """As fingerprints have them."""
    return (text or "").encode().lower().split()


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Different hashes of the text's shingles. A shorter text is one shingle."""
    import xxhash

    found = words(text)
    grams = map(b" ".join, zip(*(found[k:] for k in range(shingle)), strict=False)) if len(found) > shingle else [b" ".join(found)][: len(found)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64)).view(np.int64)


def row_key() -> list[Column]:
    """What names a row, without nulls and in the order in which rows are kept."""
    return [F.col("doc_id").isNull().alias("__none"), F.coalesce("doc_id", F.lit(0)).alias("__id"), F.xxhash64("text").alias("__hash")]


KEY = ["__none", "__id", "__hash"]


def _nodes(documents: DataFrame, views: int) -> DataFrame:
    """__none, __id, __hash, node, fps, marks and wide (more marks) of each row."""

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        import xxhash

        one = lambda t: np.concatenate([np.uint64([xxhash.xxh64_intdigest(b" ".join(words(t)))]), fingerprint_views(t, views=views), fingerprint_views(t, SHINGLE, views=MARKS + WIDE)])
        return pd.Series([one(t).view(np.int64) for t in texts], dtype=object)

    rows = documents.select(*row_key(), of("text").alias("all"))
    return rows.select(*KEY, F.get("all", 0).alias("node"), F.slice("all", 2, views).alias("fps"), *(F.get("all", 1 + views + i).alias(m) for i, m in enumerate(MARK_NAMES)), F.slice("all", 2 + views + MARKS, WIDE).alias("wide"))


def differing() -> Column:
    """Bits in which the marks of two nodes (the second's names end in 2) differ."""
    few = F.lit(0)
    for m in MARK_NAMES:
        few = few + F.bit_count(F.col(m).bitwiseXOR(F.col(f"{m}2")))
    return few


def alike() -> Column:
    """Whether the marks of two nodes differ as little as those of similar texts."""
    many = F.aggregate(F.zip_with("wide", "wide2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (differing() <= most_differing()) & (F.col("wide").isNull() | F.col("wide2").isNull() | (differing() + many <= most_differing(bits=(MARKS + WIDE) * BITS)))


def verified(pairs: DataFrame, documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of (u, v) whose marks and texts are similar enough. One text of each node is read."""
    seen = nodes.select(F.col("node").alias("u"), *MARK_NAMES, "wide")
    others = seen.withColumnsRenamed({c: f"{c}2" for c in (*MARK_NAMES, "wide")} | {"u": "v"})
    pairs = written(pairs.join(seen, "u").join(others, "v").filter(alike()).select("u", "v"), "near-alike")

    @F.pandas_udf("array<long>")
    def shingles(own: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t) for t in own], dtype=object)

    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = written(nodes.join(ends, "node", "left_semi").select("node", "rep.*"), "near-wanted")
    texts = documents.select(*row_key(), "text").join(small(wanted, KEYS), KEY).select("node", "text")
    sets = written(texts.dropDuplicates(["node"]).select("node", shingles("text").alias("set")), "near-shingles")
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("set_u")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("set_v")), "v")
    shared, total = F.size(F.array_intersect("set_u", "set_v")), F.size("set_u") + F.size("set_v")
    return both.filter(shared >= LEAST * (total - shared)).select("u", "v")


def _buckets(own: DataFrame, columns: list[str], parts: int = 4) -> DataFrame:
    """Each node under the value of each part of each fingerprint."""
    size = BITS // parts
    values = F.array(*(F.shiftrightunsigned("fp", i * size).bitwiseAND(F.lit((1 << size) - 1)) for i in range(parts)))
    return own.select("view", *columns, F.posexplode(values).alias("part", "value"))


def stars(own: DataFrame, reach: int) -> DataFrame:
    """Each node (rep) with others (head) that share a part of a fingerprint, one a bucket, and whether the bucket is a crowd.

    A bucket's other is its first by a hash that differs from view to view, so a
    member of a large group is compared to few, and to different ones. Only
    candidates, and members of crowds, are rows; head is null where the two are no
    candidates.
    """
    columns = ["rep", "fp", *MARK_NAMES]
    buckets = _buckets(own, columns)
    heads = buckets.groupBy("view", "part", "value").agg(F.min(F.struct(F.xxhash64("rep", "view").alias("h"), *columns)).alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    heads = heads.select("view", "part", "value", *(F.col(f"head.{c}").alias(f"{c}2") for c in columns), (F.col("n") > CROWD).alias("crowd"))
    near = (F.col("rep") != F.col("rep2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= reach) & (differing() <= most_differing())
    rows = buckets.join(heads, ["view", "part", "value"]).select("rep", F.when(near, F.col("rep2")).alias("head"), "crowd")
    return rows.filter("head is not null or crowd").distinct()


def near_firsts(documents: DataFrame, views: int = VIEWS, reach: int = REACH) -> tuple[DataFrame, DataFrame]:
    """The key of the row that stays, of each group, and the keys of all rows, each as often as it stands there."""
    with scope() as tables:
        rows = written(_nodes(documents, views), "near-rows")
        nodes = written(rows.groupBy("node").agg(F.min(F.struct(*KEY)).alias("rep"), *(F.first(c).alias(c) for c in ("fps", *MARK_NAMES, "wide"))), "near-nodes")
        plain = nodes.select(F.col("node").alias("rep"), *MARK_NAMES, F.posexplode("fps").alias("view", "fp"))
        met = written(stars(plain.filter(F.col("view") < STAR_VIEWS), reach), "near-stars")
        seen = met.filter("head is not null").select(F.greatest("rep", "head").alias("u"), F.least("rep", "head").alias("v")).distinct()
        sure = written(verified(seen, documents, nodes), "near-sure")
        found = components(sure)
        crowd = met.filter("crowd").select(F.col("rep").alias("__rep")).distinct()
        # What only crowds need is null for the others, so that it costs their rows nothing.
        narrow = nodes.join(crowd, nodes["node"] == crowd["__rep"], "left").join(found.select(F.col("node").alias("__node"), "component"), nodes["node"] == F.col("__node"), "left")
        in_crowd = lambda c: F.when(F.col("__rep").isNotNull(), F.col(c))
        own = written(narrow.select(F.col("node").alias("rep"), "fps", *MARK_NAMES, in_crowd("wide").alias("wide"), in_crowd("fps").alias("every"), F.coalesce("component", "node").alias("group")), "near-own")
        plans = {view: plan_search(n, both, 3, (4,)) for view, (n, both) in bit_counts(own.select(F.posexplode("fps").alias("view", "fp"))).items()}
        if plans:
            more = (*MARK_NAMES, "wide", "every", "group")
            links = near_links(own.select("rep", *more, F.posexplode("fps").alias("view", "fp")), plans, reach, more, (F.col("group") != F.col("group2")) & alike(), "every")
            pairs = written(links.join(seen, ["u", "v"], "left_anti"), "near-pairs")
            found = components(sure.union(verified(pairs, documents, nodes)))
        labels = nodes.join(found, nodes["node"] == found["node"], "left").select("rep", F.coalesce("component", nodes["node"]).alias("component"))
        keys = written(rows.select(*KEY), "near-keys")
        firsts = written(labels.groupBy("component").agg(F.min("rep").alias("rep")).select("rep.*"), "near-firsts")
        tables.discard(firsts, keys)
        return firsts, keys


def drop_copies(documents: DataFrame, views: int = VIEWS, reach: int = REACH) -> DataFrame:
    """One row of each group of near copies. Texts aren't shuffled if few rows go and none is there twice, which keys alone say."""
    firsts, keys = near_firsts(documents, views, reach)
    keyed = documents.select(F.struct(*documents.columns).alias("row"), *row_key())
    if keys.groupBy(*KEY).count().filter("count > 1").isEmpty():
        gone = written(keys.join(firsts, KEY, "left_anti"), "near-gone")
        return keyed.join(small(gone, KEYS), KEY, "left_anti").select("row.*")
    return keyed.join(firsts, KEY, "left_semi").dropDuplicates(KEY).select("row.*")
