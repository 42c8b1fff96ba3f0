"""SimHash near-dedup with the generalised pigeonhole principle.

Fingerprints: 64 bits over word shingles, hashed in Python workers batch by
batch. Equal fingerprints are one from then on, so a group of exact copies is
one row in all later steps.

Search: bits are grouped into m parts, correlated bits together, so that the
parts vary independently of each other. If the parts' thresholds t add up to
k - m + 1, two fingerprints within k bits are within t of each other in at least
one part (t = -1 leaves a part out). Dynamic programming over the parts picks
the thresholds of least cost: rows probed plus candidates expected from each
bit's frequency, over all fingerprints, and from how close the fingerprints of a
bounded sample are; m is chosen by the same cost. Every
fingerprint is stored under its part's value and probes all values within t
bits; one equi-join finds candidates and its condition verifies whole distances,
so only true links leave the join. Any choice of parts finds every link; the
estimate only sets the cost.

Groups: links between representatives go to connected components.

Views: one fingerprint misses many near copies, since its distance scatters
about what the similarity makes it. Several fingerprints of the same shingles,
each by other hashes, miss those that all of them miss. One join searches all
views, each by its own plan.

Defined results: null and empty texts have fingerprint zero and link like any
other; rows with the same doc_id are one document with several fingerprints
only if their texts differ; a row without doc_id links like any other, by its
fingerprint, and gets the smallest doc_id of its component, null if nobody there
has one. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.llm.common import written
from inkspark.llm.graph import components

BITS = 64
#: Fingerprints from which the costs of a search are estimated; all are searched.
SAMPLE = 2_048
#: Shingles hashed at once, which bounds memory for very long texts.
BLOCK = 1 << 13
#: A candidate compared costs so much of a row probed, which is shuffled and sorted.
CANDIDATE_COST = 0.05


def _mixed(hashes: np.ndarray, views: int) -> np.ndarray:
    """Hashes of the same shingles for each view (splitmix64), one row a view; view 0 is the hashes themselves."""
    steps = np.arange(1, views, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    z = hashes[None] + steps
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.concatenate([hashes[None], z ^ (z >> np.uint64(31))])


def fingerprint_views(text: str | None, shingle: int = 3, seed: int = 42, views: int = 1) -> np.ndarray:
    """Unsigned fingerprints: a bit is set if it is in over half of the shingles' hashes. View 0 hashes by XXH64."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and breaks are space and \t to \r
    if not words:
        return np.zeros(views, np.uint64)
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros((views, BITS), np.int64)
    for start in range(0, n, BLOCK):
        part = words[start : start + BLOCK + shingle - 1]
        if len(part) <= shingle:
            grams = iter([b" ".join(part)])
            size = 1
        else:
            size = min(BLOCK, n - start)
            grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, size)
        ones += np.unpackbits(_mixed(hashes, views).astype(">u8").view(np.uint8)).reshape(views, -1, BITS).sum(1, dtype=np.int32)
    return np.packbits(2 * ones > n, axis=1).reshape(-1).view(">u8").astype(np.uint64)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    return int(fingerprint_views(text, shingle, seed)[0])


def fingerprints(documents: DataFrame, shingle: int = 3, seed: int = 42, views: int = 1) -> DataFrame:
    """doc_id and fps (the fingerprints of all views as signed longs)."""

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_views(t, shingle, seed, views).view(np.int64) for t in texts], dtype=object)

    return documents.select("doc_id", of("text").alias("fps"))


def bit_counts(nodes: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """By view, the number of fingerprints and, for each pair of bits, how many have both. 4,097 numbers a view come to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for view, own in batch.groupby("view")["fp"]:
                total = sums.setdefault(int(view), np.zeros(BITS * BITS + 1))
                for at in range(0, len(own), BLOCK):
                    bits = np.unpackbits(own.to_numpy()[at : at + BLOCK].astype(">i8").view(np.uint8)).reshape(-1, BITS).astype(np.float32)
                    total[:-1] += (bits.T @ bits).ravel()
                    total[-1] += len(bits)
        for view, total in sums.items():
            yield pd.DataFrame({"view": view, "i": np.arange(BITS * BITS + 1), "n": total.astype(np.int64)})

    rows = nodes.select("view", "fp").mapInPandas(count, "view int, i int, n long").groupBy("view", "i").agg(F.sum("n").alias("n")).collect()
    flat: dict[int, np.ndarray] = {}
    for r in rows:
        flat.setdefault(r["view"], np.zeros(BITS * BITS + 1, np.int64))[r["i"]] = r["n"]
    return {view: (int(x[-1]), x[:-1].reshape(BITS, BITS)) for view, x in sorted(flat.items())}


def grouped_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Bits (0 is the highest) in m parts of nearly equal size, the most correlated together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    close = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(close, 0)
    left, parts = set(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        first = max(left, key=lambda b: (close[b, sorted(left)].sum(), -b))
        part = [first]
        left.remove(first)
        while len(part) < size:
            best = max(left, key=lambda b: (close[b, part].sum(), -b))
            part.append(best)
            left.remove(best)
        parts.append(sorted(part))
    return parts


def _within(differ: np.ndarray, most: int) -> list[float]:
    """Chance that at most 0, 1, ... ``most`` of independent bits differ."""
    dist = np.zeros(most + 2)
    dist[0] = 1
    for d in differ:
        dist[1:] = dist[1:] * (1 - d) + dist[:-1] * d
        dist[0] *= 1 - d
    return list(np.cumsum(dist)[: most + 1])


def _seen_within(sample: np.ndarray, part: list[int], most: int) -> np.ndarray:
    """Share of a sample's pairs that differ in at most 0, 1, ... ``most`` bits of a part: bits of a part are correlated, which frequencies don't tell."""
    own = sample & np.uint64(sum(1 << (BITS - 1 - b) for b in part))
    counts = np.zeros(most + 1)
    for at in range(0, len(own), 256):
        apart = np.bitwise_count(own[at : at + 256, None] ^ own[None])
        counts += [(apart <= t).sum() for t in range(most + 1)]
    return (counts - len(own)) / max(1, len(own) * (len(own) - 1))


def thresholds(parts: list[list[int]], n: int, p: np.ndarray, k: int, sample: np.ndarray | None = None) -> tuple[float, list[int]]:
    """Least cost and the parts' thresholds, which add up to k - m + 1, by dynamic programming.

    The chance that two fingerprints are close in a part is the greater of that
    of independent bits and that seen in the sample.
    """
    m = len(parts)
    price = []
    for part in parts:
        chance = _within(2 * p[part] * (1 - p[part]), k)
        if sample is not None and len(sample) > 1:
            chance = np.maximum(chance, _seen_within(sample, part, k))
        price.append([0.0] + [n * sum(comb(len(part), j) for j in range(t + 1)) + n + CANDIDATE_COST * n * n * chance[t] for t in range(k + 1)])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(m):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, k + 1):
                key, value = used + t + 1, cost + price[i][t + 1]
                if key <= k + 1 and (key not in step or value < step[key][0]):
                    step[key] = (value, [*chosen, t])
        best = step
    return best[k + 1]  # thresholds + 1 add up to k - m + 1 + m


def plan_search(n: int, both: np.ndarray, k: int, tried: tuple[int, ...] = (2, 3, 4), sample: np.ndarray | None = None) -> list[tuple[list[int], int]]:
    """Parts and thresholds of least cost among numbers of parts."""
    p = np.diag(both) / max(n, 1)
    options = []
    for m in tried:
        parts = grouped_bits(n, both, m)
        cost, ts = thresholds(parts, n, p, k, sample)
        options.append((cost, m, [(part, t) for part, t in zip(parts, ts, strict=True) if t >= 0]))
    return min(options, key=lambda x: x[:2])[2]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(nodes: DataFrame, plans: dict[int, list[tuple[list[int], int]]], k: int, more: tuple[str, ...] = (), also: Column | None = None, once: str | None = None) -> DataFrame:
    """Of fingerprints of each view (view, rep, fp): all pairs of a view that meet in a part and are within k bits as (u, v), u > v.

    One join serves all views; the plan of each is its own. ``also`` is a further
    condition, on columns ``more`` of one node and the same with a 2 at the end of
    their names of the other. ``once`` names a column, one of ``more``, with the
    array of a node's fingerprints by view, or null: a pair that both have it
    leaves the join only at the first part in which it meets.
    """
    stored = probes = None
    places = []  # all parts in order: view, bits, threshold
    for view, plan in sorted(plans.items()):
        kept, asked = [], []
        for part, t in plan:
            bits = [1 << (BITS - 1 - b) for b in part]
            place, value = F.lit(len(places)), F.col("fp").bitwiseAND(F.lit(_signed(sum(bits))))
            places.append((view, _signed(sum(bits)), t))
            near = [_signed(sum(c)) for j in range(t + 1) for c in combinations(bits, j)]
            kept.append(F.struct(place.alias("place"), value.alias("value")))
            asked += [F.struct(place.alias("place"), (value.bitwiseXOR(F.lit(x)) if x else value).alias("value")) for x in near]
        here = F.col("view") == view
        stored = F.when(here, F.array(*kept)) if stored is None else stored.when(here, F.array(*kept))
        probes = F.when(here, F.array(*asked)) if probes is None else probes.when(here, F.array(*asked))
    # With thresholds of 0 both sides are the same rows, which are shuffled once.
    at = lambda rows: nodes.select("rep", "fp", F.explode(rows).alias("at"), *more).select("at.place", "at.value", "rep", "fp", *more)
    asked, index = at(probes), at(stored)
    index = index.select(F.col("place").alias("place2"), F.col("value").alias("value2"), F.col("rep").alias("rep2"), F.col("fp").alias("fp2"), *(F.col(c).alias(f"{c}2") for c in more))
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= k) & (F.col("rep") > F.col("rep2"))
    near = near if also is None else near & also
    if once:
        table = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(v).alias("v"), F.lit(m).alias("m"), F.lit(t).alias("t")) for i, (v, m, t) in enumerate(places)))
        apart = lambda x: F.get(once, x["v"]).bitwiseXOR(F.get(f"{once}2", x["v"]))
        met = lambda x: (F.bit_count(apart(x).bitwiseAND(x["m"])) <= x["t"]) & (F.bit_count(apart(x)) <= k)
        earlier = F.exists(table, lambda x: (x["i"] < F.col("place")) & met(x))
        near = near & (F.col(once).isNull() | F.col(f"{once}2").isNull() | ~earlier)
    same = (F.col("place") == F.col("place2")) & (F.col("value") == F.col("value2"))
    return asked.join(index, same & near).select(F.col("rep").alias("u"), F.col("rep2").alias("v")).distinct()


def near_groups(documents: DataFrame, k: int = 3, shingle: int = 3, seed: int = 42, views: int = 1) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (smallest doc_id reachable) of each row.

    With several views, documents link that are within k bits in any of them.
    """
    fps = written(fingerprints(documents, shingle, seed, views), "simhash-fps")
    nodes = fps.groupBy("fps").agg(F.min("doc_id").alias("first"))
    # Fingerprints of rows without doc_id only are named by a hash, among numbers over all doc_ids that are in use.
    unnamed = F.xxhash64("fps").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    nodes = written(nodes.withColumn("rep", F.coalesce("first", unnamed)), "simhash-nodes")
    own = nodes.select("rep", F.posexplode("fps").alias("view", "fp"))
    heads = written(own.groupBy("view", "fp").agg(F.min("rep").alias("rep")), "simhash-heads")
    drawn = heads.orderBy(F.xxhash64("rep", "view"), "rep", "view").limit(SAMPLE).collect()
    of_view = lambda view: np.array([r["fp"] for r in drawn if r["view"] == view], np.int64).view(np.uint64)
    plans = {view: plan_search(n, both, k, sample=of_view(view)) for view, (n, both) in bit_counts(heads).items()}
    if plans:
        links = near_links(heads, plans, k)
        if views > 1:  # documents that are equal in a view link to their smallest
            equal = own.join(heads.withColumnRenamed("rep", "head"), ["view", "fp"]).filter("rep > head")
            links = links.union(equal.select(F.col("rep").alias("u"), F.col("head").alias("v")))
        found = components(links)
    else:
        found = heads.select(F.col("rep").alias("node"), F.col("rep").alias("component"))
    labels = nodes.join(found, nodes["rep"] == found["node"], "left").select("fps", "first", F.coalesce("component", "rep").alias("component"))
    firsts = labels.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = labels.join(firsts, "component").select("fps", "component_id")
    return fps.join(labels, "fps").select("doc_id", F.lower(F.lpad(F.hex(F.get("fps", 0)), 16, "0")).alias("fingerprint"), "component_id")
