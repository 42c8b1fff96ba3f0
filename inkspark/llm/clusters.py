"""Centroid clustering of integer vectors with Hamerly's bounds.

Each vector keeps one upper bound on the distance to its own centroid and one
lower bound on the distance to any other. When centroids move, the upper bound
grows by the drift of its own and the lower one shrinks by the greatest drift of
the others. A vector whose upper bound stays below the lower one, or below half
the distance from its centroid to the nearest other, can't change and isn't
compared to anything. The others get their exact distance, and those still in
doubt an exact integer scan over all centroids. Bounds are loosened by a margin
for rounding and compared strictly, so ties always come to a scan, where the
smaller number wins: clusters are those of a full scan in every round.

One round is one Arrow pass over the stored vectors and bounds. Python workers
see a batch at a time and give, with each row, whether it moved. Centroids are
exact: sums of whole clusters are kept on the driver (``k`` rows) and changed by
what moved, which tasks add up themselves before anything is shuffled. Nothing
is dealt by cluster, so one vector or cluster of a third of all rows costs no
more than others. A round's table replaces the one before in the shared folder.

Defined results: vectors of another number of components, with null, NaN or
infinite ones, or null, have no row. Nor have those with a component of 2^18 or
more, for which exact distances don't fit a long. Repeated rows are vectors each;
where they are drawn as first centroids, ties go by components. A null vec_id
counts as last of all. With fewer vectors than ``k``, each starts a cluster.
Empty clusters keep their centroid. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.llm.common import scope, written

DIMENSIONS = 64
#: Components of this size or more leave no room for exact distances.
LIMIT = 1 << 18
#: Bounds are loosened by so much of themselves for rounding.
MARGIN = 1e-9
STATE = "vec_id long, x array<int>, cluster int, was int, upper double, lower double"


def quantized(embedding: Column, dimensions: int = DIMENSIONS) -> Column:
    """floor(256 x) of each component, null for vectors that aren't kept."""
    sound = (F.size(embedding) == dimensions) & F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < LIMIT), F.lit(False)))
    return F.when(sound, F.transform(embedding, lambda x: F.floor(x.cast("double") * 256).cast("int")))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the ``k`` smallest hashes of seed and vec_id: a top-k, of which k rows come to the driver."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64).reshape(len(rows), DIMENSIONS)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids. Products of doubles are exact while they stay below 2^53."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if largest * largest * x.shape[1] < 1 << 53:
        cross = (x.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)
    else:
        cross = x @ centroids.T
    return (x * x).sum(1)[:, None] - 2 * cross + (centroids * centroids).sum(1)[None]


def scanned(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equals), and the bounds: distance to it, and to the second nearest."""
    d = squared(x, centroids)
    own = d.argmin(1)
    rows = np.arange(len(x))
    nearest = d[rows, own]
    d[rows, own] = np.iinfo(np.int64).max
    second = d.min(1, initial=np.iinfo(np.int64).max)
    return own, np.sqrt(nearest) * (1 + MARGIN), np.sqrt(second) * (1 - MARGIN)


def moved(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters and bounds after centroids went from ``before`` to ``centroids``, and how many vectors were scanned."""
    k = len(centroids)
    drift = np.sqrt(((centroids - before) ** 2).sum(1)) * (1 + MARGIN)
    most = np.full(k, drift.max(initial=0))
    if k > 1:  # of the other centroids
        top = int(drift.argmax())
        most[top] = np.delete(drift, top).max()
    apart = squared(centroids, centroids)
    np.fill_diagonal(apart, np.iinfo(np.int64).max)
    half = np.sqrt(apart.min(1, initial=np.iinfo(np.int64).max)) / 2 * (1 - MARGIN)
    own, upper, lower = own.copy(), upper + drift[own], lower - most[own]
    safe = np.maximum(half[own], lower)
    doubt = np.flatnonzero(upper >= safe)
    upper[doubt] = np.sqrt(((x[doubt] - centroids[own[doubt]]) ** 2).sum(1)) * (1 + MARGIN)
    doubt = doubt[upper[doubt] >= safe[doubt]]
    if len(doubt):
        own[doubt], upper[doubt], lower[doubt] = scanned(x[doubt], centroids)
    return own, upper, lower, len(doubt)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64) if len(column) else np.zeros((0, DIMENSIONS), np.int64)


def assigned(rows: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """One round: every vector's cluster, the one it was in, and its bounds. ``before`` None scans all."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            if before is None:
                was = np.full(len(x), -1)
                own, upper, lower = scanned(x, centroids)
            else:
                was = batch.column("cluster").to_numpy()
                own, upper, lower, _ = moved(x, was, batch.column("upper").to_numpy(), batch.column("lower").to_numpy(), before, centroids)
            columns = [batch.column("vec_id"), batch.column("x"), *(pa.array(v, t) for v, t in ((own, pa.int32()), (was, pa.int32()), (upper, pa.float64()), (lower, pa.float64())))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "cluster", "was", "upper", "lower"])

    return rows.mapInArrow(of, STATE)


def changes(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """By how much clusters' sums and sizes change: what moved is added here and taken away there. At most ``k`` rows a task are shuffled."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = _matrix(batch.column("x"))
            x = np.concatenate([x, np.ones((len(x), 1), np.int64)], 1)
            for name, sign in (("cluster", 1), ("was", -1)):
                own = batch.column(name).to_numpy()
                for c in np.unique(own[own >= 0]):
                    sums[int(c)] = sums.get(int(c), 0) + sign * x[own == c].sum(0)
        for c, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(s), pa.int32()), pa.array(range(len(s)), pa.int32()), pa.array(s, pa.int64())], names=["cluster", "i", "s"])

    parts = rows.filter("cluster <> was").select("x", "cluster", "was").mapInArrow(of, "cluster int, i int, s long")
    got = parts.groupBy("cluster", "i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros((k, max((r["i"] for r in got), default=0) + 1), np.int64)
    for r in got:
        out[r["cluster"], r["i"]] = r["s"]
    return out[:, :-1], out[:, -1]


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clusters(embeddings: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance (squared, to its centroid), cluster_inertia, inertia, centroid_sha256 of each kept vector.

    ``k`` is a bound on what the driver and each task hold: k centroids.
    """
    spark = embeddings.sparkSession
    with scope() as tables:
        kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), quantized(F.col("embedding")).alias("x")).filter("x is not null")
        centroids = first_centroids(kept, k, seed)
        rows, before = kept, None
        sums, sizes = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for _ in range(rounds if len(centroids) else 0):
            rows = written(assigned(rows, centroids, before), "clusters")
            tables.discard(rows)
            more, n = changes(rows, len(centroids))
            if n.any() or more.any():
                sums, sizes = sums + more, sizes + n
            before, centroids = centroids, np.where(sizes[:, None] > 0, sums // np.maximum(sizes, 1)[:, None], centroids)
        if not len(centroids):
            return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
        rows = assigned(rows, centroids, before)
        final = written(_with_distance(rows, centroids), "clusters-final")
        tables.discard(final)
        totals = {r["cluster"]: r["s"] for r in final.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    whole = None if None in totals.values() else sum(totals.values())
    whole = whole if whole is not None and whole < 1 << 63 else None
    facts = spark.createDataFrame([(c, s, whole, digest(centroids[c])) for c, s in totals.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _with_distance(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("cluster").to_numpy()
            distance = ((_matrix(batch.column("x")) - centroids[own]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "x", "cluster").mapInArrow(of, "vec_id long, cluster int, distance long")


def clusters_sql(k: int = 40, rounds: int = 5, seed: int = 2, embeddings: str = "embeddings") -> str:
    """The same in DuckDB SQL by full scans, for tables whose vec_id are distinct and not null."""
    steps = [f"""kept as materialized (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x from {embeddings}
  where len(embedding) = {DIMENSIONS} and coalesce(list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x) and abs(x) < {LIMIT})), false)),
parts as materialized (select vec_id, unnest(x) as v, generate_subscripts(x, 1) as i from kept),
c0 as materialized (select cast(row_number() over (order by h) - 1 as integer) as c, x from (select x, sha256('{seed}:' || vec_id) as h from kept order by h limit {k}))"""]  # fmt: skip
    for r in range(rounds + 1):
        steps.append(f"""d{r} as materialized (select vec_id, c, list_sum(list_transform(list_zip(k.x, o.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from kept k, c{r} o),
a{r} as materialized (select vec_id, c, cast(d as bigint) as d from d{r} qualify row_number() over (partition by vec_id order by d, c) = 1)""")
        if r < rounds:
            steps.append(f"""s{r} as (select c, i, cast(sum(v) as bigint) as s, count(*) as n from parts join a{r} using (vec_id) group by c, i),
m{r} as (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as x from s{r} group by c),
c{r + 1} as materialized (select o.c, coalesce(m.x, o.x) as x from c{r} o left join m{r} m using (c))""")
    return "with " + ",\n".join(steps) + f"""
select vec_id, c as cluster, d as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
  sha256(array_to_string(x, ',')) as centroid_sha256 from a{rounds} join c{rounds} using (c)"""
