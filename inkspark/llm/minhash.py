"""MinHash near-dedup by an inverted join of signature coordinates.

Nodes: rows of the same word sequence are one node, named by 128 bits of it, so a
group of exact copies is one row in all later steps.

Signature: ``COORDINATES`` minima of a node's shingle hashes under as many orders.
Two sets agree in a coordinate with the chance of their similarity. A node is
posted under each coordinate-value pair. Pairs that agree in ``matches`` or more
coordinates are candidates; ``matches`` is set so that a pair at the limit agrees
in fewer with a chance of some 10^-6 (``needed``; exact, not estimated).

Prefix and skip merging: lists are ordered by length, the shortest first. Two
nodes that agree in ``matches`` of n coordinates share one of each node's n -
matches + 1 shortest lists, so only these are merged; a node that stands in
fewer than ``matches`` lists of two or more is skipped. A pair is counted once, in
the first list that both have in their prefix. The join counts collisions by two
bits of each of ``FINE`` coordinates, the posted ones among them, and retains pairs
that fall short with a chance of some 10^-6 at the limit (together some 10^-5 of
pairs at the limit are lost, none of them by a size).

Crowds: first each node is compared to two members of each of its lists, and the
best matches are verified and made components. Then lists are merged, but only
between different components: in long lists they are told apart by a hash's bits,
and two rows meet under the first bit in which their components differ, so those
of one component never meet. A large group of copies costs its number of rows.
Nodes of longer lists carry their sets, so that they are verified in the join and
nothing but links leaves it; others are verified after it, to the same result.
A family of texts that are alike, but less than the limit, still has as many
comparisons as pairs in the join.

Verification: each pair that is left is compared by both whole sets of shingle
hashes (64 bits) before it links. Links go to connected components.

Defined results: null texts and those without words have an empty set, size 0,
and link with nothing, each row by itself. Fewer words than a shingle are one
shingle. Rows of the same words are linked, whatever their doc_ids. A component's
id is its smallest doc_id that isn't null; a row without one gets it too, and is
kept only if nobody has one. Rows with equal doc_id are rows each. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from inkspark.llm.common import scope, written
from inkspark.llm.graph import components
from inkspark.llm.near_copies import KEY, KEYS, row_key
from inkspark.operators.sides import small

SHINGLE = 5
#: Per cent of the union that the intersection has at least.
LEAST = 85
#: Coordinates that are posted, and all, of which two bits are kept to count agreements.
COORDINATES, FINE = 32, 288
#: Chance that a pair at the limit is lost by each of the two counts, at most.
LOSS = 5e-6
#: Heads that a node is verified against at first.
HEADS = 3
#: Nodes of lists over this size carry their sets through the join, if they are not larger than that.
CROWD, CARRIED = 64, 4_096
#: Lists over this size are merged by the bits in which components differ, and how many bits of their hash.
PLAIN, GROUP_BITS = 4_096, 16
#: A list is dealt over a salt for so many rows, up to so many salts.
SALTED, SALTS = 256, 64
#: An odd number whose powers weigh a shingle's words.
POLYNOMIAL = np.uint64(0x9E3779B97F4A7C15)
#: Shingles put in order at once, which bounds memory for very long texts.
BLOCK = 1 << 10


def needed(coordinates: int, least: float, loss: float = LOSS) -> int:
    """The largest number of agreeing coordinates that pairs at the limit fall short of with at most that chance."""
    p = Fraction(least).limit_denominator(10**6)
    chance, m = Fraction(0), 0
    while True:
        chance += comb(coordinates, m) * p**m * (1 - p) ** (coordinates - m)
        if chance > loss:
            return m
        m += 1


MATCHES = needed(COORDINATES, LEAST / 100)
#: Two bits agree by chance, too.
FINE_MATCHES = needed(FINE, LEAST / 100 + (1 - LEAST / 100) / 4)
FINE_NAMES = [f"fine{i}_" for i in range(FINE // 32)]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # of bytes: A-Z only, and breaks are space and \t to \r


def shingle_set(found: list[bytes]) -> np.ndarray:
    """Different hashes of the shingles, in order. Words are hashed, and a shingle's hash is a polynomial of its words', folded."""
    import xxhash

    if len(found) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found))] if found else [], np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = len(own) - SHINGLE + 1
    h = own[:n].copy()
    for k in range(1, SHINGLE):
        h *= POLYNOMIAL
        h += own[k : k + n]
    h ^= h >> np.uint64(32)
    h *= POLYNOMIAL
    h ^= h >> np.uint64(29)
    return np.unique(h)


def _orders(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and terms, one of each for an order."""
    drawn = np.random.default_rng(11).integers(0, 1 << 32, (2, n, 1), dtype=np.uint32)
    return drawn[0] | np.uint32(1), drawn[1]


FACTORS, TERMS = _orders(FINE)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The shingle hash that is first under each order: an order multiplies and moves the upper half of the bits."""
    best = np.zeros(len(FACTORS), np.uint64)
    least = None
    rows = np.arange(len(FACTORS))
    for start in range(0, len(hashes), BLOCK):
        part = hashes[start : start + BLOCK]
        z = (part >> np.uint64(32)).astype(np.uint32)[None] * FACTORS
        z += TERMS
        at = z.argmin(1)
        value = z[rows, at]
        better = value < least if least is not None else slice(None)
        best[better] = part[at][better]
        least = np.minimum(value, least) if least is not None else value
    return best


ROW = StructType([StructField("node", BinaryType()), StructField("n", LongType()), StructField("posts", ArrayType(LongType())), StructField("fine", ArrayType(LongType()))])


def _signed(texts: pd.Series) -> pd.DataFrame:
    """The node, its set's size, its posts (coordinate in the low byte, the value above), and two bits of all coordinates, of 32 a long."""
    import xxhash

    rows = []
    for t in texts:
        found = words(t)
        hashes = shingle_set(found)
        if not len(hashes):
            rows.append((None, 0, None, None))
            continue
        values = signature(hashes)
        posts = (values[:COORDINATES] << np.uint64(8)) | np.arange(COORDINATES, dtype=np.uint64)
        pairs = (values & np.uint64(3)).reshape(-1, 32) << np.arange(0, 64, 2, dtype=np.uint64)
        fine = np.bitwise_or.reduce(pairs, 1)
        rows.append((xxhash.xxh3_128_digest(b" ".join(found)), len(hashes), posts.view(np.int64), fine.view(np.int64)))
    return pd.DataFrame(rows, columns=["node", "n", "posts", "fine"]).astype({"n": "int64"})


def differing(a: Column, b: Column) -> Column:
    """In how many of 32 pairs of bits two longs differ."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def _apart() -> Column:
    """In how many coordinates two rows (the second's names end in 2) differ, as far as two bits tell."""
    return reduce(lambda n, c: n + differing(F.col(c), F.col(f"{c}2")), FINE_NAMES, F.lit(0))


def _agree() -> Column:
    """Whether two rows agree often enough. Kept short, since the join compiles it as a whole."""
    return _apart() <= FINE - FINE_MATCHES


def _lists(nodes: DataFrame) -> DataFrame:
    """Each node with its prefix: the lengths and posts of its shortest lists that others are in, shortest first; and how many it meets in all its lists. Nodes that meet too few have no row."""
    posted = nodes.select("node", F.explode("posts").alias("post"))
    lists = written(posted.groupBy("post").agg(F.count(F.lit(1)).alias("length")).filter("length > 1"), "minhash-lists")
    shared = posted.join(lists, "post").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("length", "post"))).alias("l"))
    width = F.size("l") - (MATCHES - 1)  # lists of one come before the others and are in every prefix
    met = F.aggregate("l", F.lit(0).cast("long"), lambda n, x: n + x["length"])
    return shared.filter(width > 0).select("node", F.slice("l", F.lit(1), width).alias("lists"), met.alias("met"))


def _second(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"{c}2") for c in columns))


def _heads(posts: DataFrame) -> DataFrame:
    """Pairs of each node with the few best agreeing of its lists' heads.

    A list has two: the node that meets most others in all its lists, which is what
    a group of copies was copied from if that is there, and the first by a hash that
    differs from list to list.
    """
    columns = ["node", *FINE_NAMES]
    lists = posts.groupBy("post").agg(F.max(F.struct("met", *columns)).alias("hub"), F.min(F.struct(F.xxhash64("node", "post").alias("h"), *columns)).alias("any"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    both = F.array(*(F.struct(*(F.col(f"{end}.{c}").alias(c) for c in columns)) for end in ("hub", "any")))
    heads = lists.select("post", F.explode(F.array_distinct(both)).alias("head")).select("post", *(F.col(f"head.{c}").alias(f"{c}2") for c in columns))
    met = posts.select("post", *columns).join(heads, "post").filter((F.col("node") != F.col("node2")) & _agree())
    best = met.groupBy("node").agg(F.slice(F.sort_array(F.collect_set(F.struct(_apart().alias("apart"), F.col("node2").alias("other")))), 1, HEADS).alias("l"))
    pairs = best.select("node", F.explode("l.other").alias("other"))
    return pairs.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct()


CARRIED_COLUMNS = ["node", "prefix", "group", "n", "set", *FINE_NAMES]


def _levels(posts: DataFrame, second: bool) -> DataFrame:
    """Rows of lists that hold several components, as one side of the join or as the second.

    Those of long lists stand under each bit of their component's code (from 1):
    what is above the bit, and the bit (side); under 0 the whole code; those of
    others under -1. A list of more than ``SALTED`` rows is dealt over several
    salts: a row of one side has one, of the second all.
    """
    groups = posts.groupBy("post").agg(F.min("group").alias("least"), F.max("group").alias("most")).filter("least <> most").select("post")
    code = F.pmod(F.xxhash64("group"), F.lit(1 << GROUP_BITS)).cast("int")
    row = lambda bit, above, side: F.struct(F.lit(bit).alias("bit"), above.alias("above"), side.alias("side"))
    zero = F.lit(0)
    at = [row(0, code, zero)] + [row(b + 1, F.shiftright(code, b + 1), F.shiftright(code, b).bitwiseAND(F.lit(1))) for b in range(GROUP_BITS)]
    every = F.when(F.col("length") <= PLAIN, F.array(row(-1, zero, zero))).otherwise(F.array(*at))
    rows = posts.join(groups, "post", "left_semi").withColumn("at", F.explode(every)).filter("at.side = 1 or at.bit <= 0" if second else "at.side = 0")
    salts = F.least(F.lit(SALTS), F.ceil(F.col("length") / SALTED)).cast("int")
    salt = F.explode(F.sequence(F.lit(0), salts - 1)) if second else F.pmod(F.xxhash64("node"), salts).cast("int")
    return rows.withColumn("salt", salt).select("post", "at.bit", "at.above", "salt", *CARRIED_COLUMNS)


def similar(a: Column, b: Column) -> Column:
    """Whether two whole sets are similar enough."""
    return (100 + LEAST) * F.size(F.array_intersect(a, b)) >= LEAST * (F.size(a) + F.size(b))


def _merged(posts: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes of different components that agree often enough, each from the first list that is in both prefixes; sure says that their sets were compared here."""
    key = ["post", "bit", "above", "salt"]
    one, two = _levels(posts, False), _second(_levels(posts, True), [*key, *CARRIED_COLUMNS])
    same = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"{c}2") for c in key))
    apart = (F.col("bit") > 0) | ((F.col("node") > F.col("node2")) & (F.col("group") != F.col("group2")))
    sizes = (100 * F.col("n") >= LEAST * F.col("n2")) & (100 * F.col("n2") >= LEAST * F.col("n"))
    first = F.get(F.array_intersect("prefix", "prefix2"), 0) == F.col("post")
    sure = F.col("set").isNotNull() & F.col("set2").isNotNull()
    met = one.join(two, same & apart & sizes & _agree() & first & (~sure | similar(F.col("set"), F.col("set2"))))
    return met.select(F.greatest("node", "node2").alias("u"), F.least("node", "node2").alias("v"), sure.alias("sure"))


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of (u, v) whose whole sets are similar enough."""
    own = lambda end: sets.select(F.col("node").alias(end), F.col("set").alias(f"set_{end}"))
    both = pairs.join(own("u"), "u").join(own("v"), "v")
    return both.filter(similar(F.col("set_u"), F.col("set_v"))).select("u", "v")


def _sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sets of the nodes wanted, each from one row, which its key names. Other texts aren't shuffled if few are wanted."""

    @F.pandas_udf(ArrayType(LongType()))
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(words(t)).view(np.int64) for t in texts], dtype=object)

    texts = documents.select(*row_key(), "text").join(small(wanted, KEYS), KEY).select("node", "text")
    return texts.dropDuplicates(["node"]).select("node", of("text").alias("set"))


def near_components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    with scope() as tables:
        signed = F.pandas_udf(_signed, ROW)
        rows = written(documents.select("doc_id", *row_key(), signed("text").alias("s")).select("doc_id", *KEY, "s.*"), "minhash-rows")
        own = rows.filter("node is not null").groupBy("node")
        nodes = written(own.agg(F.min("doc_id").alias("rep"), F.min(F.struct(*KEY)).alias("key"), F.first("n").alias("n"), F.first("posts").alias("posts"), F.first("fine").alias("fine")), "minhash-nodes")
        lean = written(rows.select("doc_id", "n", "node"), "minhash-lean")
        tables.discard(nodes, lean)
        prefixes = written(_lists(nodes), "minhash-prefixes")
        wide = nodes.join(prefixes, "node").select("node", "key", "n", *(F.get("fine", i).alias(c) for i, c in enumerate(FINE_NAMES)), "lists", F.col("lists.post").alias("prefix"), "met")
        wide = written(wide, "minhash-wide")
        posted = lambda rows: rows.withColumn("at", F.explode("lists")).select("*", "at.length", "at.post").drop("at", "lists", "key")
        sets = written(_sets(documents, wide.select("node", "key.*")), "minhash-sets")
        first = written(_heads(posted(wide)), "minhash-heads")
        sure = written(linked(first, sets), "minhash-sure")
        found = components(sure)
        crowded = F.array_max("lists")["length"] > CROWD
        carried = sets.filter(F.size("set") <= CARRIED).select("node", "set")
        grouped = wide.join(found, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
        grouped = grouped.join(carried, "node", "left").withColumn("set", F.when(crowded, F.col("set")))
        pairs = written(_merged(posted(grouped)), "minhash-pairs")
        rest = linked(pairs.filter("not sure").select("u", "v").join(first, ["u", "v"], "left_anti"), sets)
        found = components(sure.union(pairs.filter("sure").select("u", "v")).union(rest))
        labels = nodes.select("node", "rep").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        firsts = labels.groupBy("component").agg(F.min("rep").alias("component_id"))
        labels = written(labels.join(firsts, "component").select("node", "component_id"), "minhash-labels")
        tables.discard(labels, lean)
    got = lean.join(labels, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return got.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_components_sql(documents: str = "documents") -> str:
    """The same in DuckDB SQL by counting shared shingles of all pairs that share one, for tables whose doc_id are distinct and not null."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') as ws from {documents}),
s as materialized (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) <= {SHINGLE} then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' ')) end) as g from w),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as u, b.doc_id as v, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
l as materialized (select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v where 100 * k >= {LEAST} * (x.n + y.n - k)),
r as (select doc_id, doc_id as other from w union select r.doc_id, l.v from r join l on l.u = r.other)
select r.doc_id, cast(coalesce(max(n.n), 0) as bigint) as n_shingles, min(other) as component_id, r.doc_id = min(other) as kept from r left join n on n.doc_id = r.doc_id group by r.doc_id"""
