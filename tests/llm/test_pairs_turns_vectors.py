"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspark.llm import clusters, conversations, minhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


# 11: MinHash near-dedup


def words(n, seed):
    rng = random.Random(seed)
    return [f"{rng.choice('shore lamp river stone quiet meadow copper seven'.split())}{rng.randint(0, 999)}" for _ in range(n)]


def altered(found, n, seed):
    rng, out = random.Random(seed), list(found)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randint(0, 10**9)}"
    return out


def shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def all_pairs(rows):
    sets = [shingles(t) for _, t in rows]
    head = list(range(len(rows)))

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                head[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        c = min(ids, default=None)
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def near(spark, rows, schema=DOCS):
    return rows_of(minhash.near_components(spark.createDataFrame(rows, schema).repartition(3)))


def test_minhash_by_all_pairs(spark):
    base, other = words(300, 1), words(60, 2)
    chain = [words(200, 3)]
    for k in range(5):  # each is near to the one before, the ends aren't near
        chain.append(altered(chain[-1], 2, k))
    texts = [" ".join(t) for t in [base, base, altered(base, 3, 1), altered(base, 30, 2), other, altered(other, 1, 3), *chain]]
    texts += [None, "", " \n\t", "one", "ONE", "one two", "one  two", "a b c d e", "a b c d e f", "É " * 9, "é " * 9, " ".join(base).upper(), "x" * 100_000, " ".join(words(60_000, 5))]
    rows = list(enumerate(texts)) + [(None, texts[0]), (None, "lonely words here"), (None, None), (3, texts[0]), (0, texts[0])]
    got, want = near(spark, rows), all_pairs(rows)
    assert got == want
    assert len({r[2] for r in want}) < len(texts) - 8


def test_minhash_crowds(spark):
    """Large groups of different near copies, and families alike below the limit, keep exactly the links of all pairs."""
    base, family = words(150, "crowd"), words(150, "family")
    texts = [altered(base, 1, k) for k in range(120)]
    members = [altered(family, 8, k) for k in range(60)]
    texts += members + [altered(m, 1, f"again{k}") for k, m in enumerate(members[:20])]
    rows = [(1000 - k, " ".join(t)) for k, t in enumerate(texts)]
    assert near(spark, rows) == all_pairs(rows)


def test_minhash_merging_keeps_components_apart(spark, monkeypatch):
    """With codes of one bit, components of equal codes still meet, and nodes of one component never do."""
    monkeypatch.setattr(minhash, "GROUP_BITS", 1)
    monkeypatch.setattr(minhash, "PLAIN", 0)
    family = words(100, "family")
    rows = [(k, " ".join(altered(family, 2, k % 9 if k % 2 else k))) for k in range(40)]
    assert near(spark, rows) == all_pairs(rows)
    posts = spark.createDataFrame([(1, b"a", 7), (1, b"b", 7), (1, b"c", 8), (2, b"a", 7), (2, b"b", 7)], "post long, node binary, group long")
    levels = minhash._levels(posts.select("*", *(F.lit(1).alias(c) for c in ("n", "prefix", "set", "length", *minhash.FINE_NAMES))), True)
    assert {r["post"] for r in levels.collect()} == {1}  # a list of one component has nothing to merge


@pytest.mark.parametrize("crowd, carried", [(0, 4096), (10**6, 4096), (2, 60)])
def test_minhash_is_the_same_wherever_sets_are_compared(spark, monkeypatch, crowd, carried):
    monkeypatch.setattr(minhash, "CROWD", crowd)
    monkeypatch.setattr(minhash, "CARRIED", carried)
    family = words(70, "family")
    rows = [(k, " ".join(altered(family, k % 3, k // 2))) for k in range(50)]
    assert near(spark, rows) == all_pairs(rows)


def test_needed_matches():
    """The exact chance of falling short, by its definition."""
    from math import comb

    short = lambda n, p, m: sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(m))
    for n, p in ((32, 0.85), (288, 0.8875), (10, 0.5)):
        m = minhash.needed(n, p)
        assert short(n, p, m) <= minhash.LOSS < short(n, p, m + 1)


def test_differing_pairs_of_bits(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(200):
        a = [rng.randrange(4) for _ in range(32)]
        b = [x if rng.random() < 0.5 else rng.randrange(4) for x in a]
        long = lambda xs: int.from_bytes(sum(x << 2 * i for i, x in enumerate(xs)).to_bytes(8), signed=True)
        rows.append((long(a), long(b), sum(x != y for x, y in zip(a, b, strict=True))))
    frame = spark.createDataFrame(rows, "a long, b long, want int")
    assert frame.filter(minhash.differing(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_minhash_sql_and_other_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.execute(minhash.near_components_sql()).fetchall(), key=str)
    assert rows_of(minhash.near_components(docs)) == want
    clashing = docs.select("*", *(F.lit(1).alias(c) for c in ("node", "n", "posts", "s", "set", "kept", "component_id", "u", "rep")))
    assert rows_of(minhash.near_components(clashing)) == want
    assert minhash.near_components(docs.limit(0)).collect() == []


# 12: conversation repair

NEXT = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}


def cheapest(turns, faults):
    """Dijkstra over (cost, audit): the first way out is the cheapest and least."""
    heap, least = [(0, "", 0, "0", ())], {}
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(turns) and state in "0A":
            return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()
        if least.setdefault((i, state), cost) < cost:
            continue
        to = [(r, NEXT[state, r[0]]) for r in ("user", "assistant") if (state, r[0]) in NEXT]
        for role, s in to:
            heapq.heappush(heap, (cost + 2, audit + "I", i, s, (*lines, f"{role}:")))
        if i < len(turns):
            (_, role, text), fault = turns[i], faults[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                more = cost + (fault == "truncated")
                if (state, role[:1]) in NEXT:
                    heapq.heappush(heap, (more, audit + "K", i + 1, NEXT[state, role[:1]], (*lines, f"{role}:{text}")))
                for r, s in to:
                    heapq.heappush(heap, (more + 2, audit + "R", i + 1, s, (*lines, f"{r}:{text}")))


def repaired_by_force(rows):
    by_conv = {}
    for conv, turn, role, text in rows:
        own = by_conv.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    out = []
    for conv, own in by_conv.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            rest = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, *cheapest(own, faults)))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"


def odd_turns(seed, n=900, conversations=120):
    rng = random.Random(seed)
    texts = ["a.", "b", "", "  ", "a.", "c!", "d?", "e. ", None, "x.y", "\x0b", "é", "long " * 3000]
    roles = ["user", "assistant", "system", "tool", None, "user", "assistant", "", "usher"]
    rows = [(None if rng.random() < 0.05 else rng.randrange(conversations), None if rng.random() < 0.1 else rng.randrange(9), rng.choice(roles), rng.choice(texts)) for _ in range(n)]
    return rows + rows[:50]


@pytest.mark.parametrize("bits", [9, 1])
def test_repair_by_force(spark, monkeypatch, bits):
    """In whole pieces and in pieces of two turns, conversations dealt over several ranges."""
    monkeypatch.setattr(conversations, "PIECE_BITS", bits)
    rows = odd_turns(bits)
    frame = spark.createDataFrame(rows, TURNS).repartition(5)
    assert rows_of(conversations.repaired(frame)) == repaired_by_force(rows)


def test_repair_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    want = repaired_by_force([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert rows_of(conversations.repaired(table)) == want
    clashing = table.select("*", *(F.lit(1).alias(c) for c in ("at", "n", "kind", "edits", "fate", "forced", "blank", "first", "digest")))
    assert rows_of(conversations.repaired(clashing)) == want
    assert conversations.repaired(table.limit(0)).collect() == []


def test_repair_of_a_long_conversation(spark):
    """One conversation over many pieces, with a turn that stands thousands of times."""
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["fine.", "cut", f"own {t}."])) for t in range(3000)] + [(1, 1500, "user", "again.")] * 4000
    got = conversations.repaired(spark.createDataFrame(rows, TURNS)).collect()
    turns = conversations._in_order(conversations.damaged(spark.createDataFrame(rows, TURNS)))
    assert turns.count() < 3010
    assert len(got) == 1
    audit = got[0]["audit"]
    n = sum({0: 0, 3: 2}.get(zlib.crc32(f"1:{t}".encode()) % 20, 1) for _, t, _, _ in rows)
    assert len(audit) - audit.count("I") == n
    kept = conversations.least_edits([conversations.U, conversations.A] * 4000, [0, 4, 2, 0], (conversations.START,))[conversations.START]
    assert kept[0] == 0 and set(kept[2]) == {"K"}


def test_pieces_equal_the_whole():
    """Costs between states of pieces, put together, are those of the whole."""
    rng = random.Random(4)
    for _ in range(150):
        kinds = [rng.choice([-1, 0, 1, 2, 3, 4, 5, 6, 7]) for _ in range(rng.randint(1, 12))]
        cut = rng.randint(1, len(kinds))
        parts = [k for k in (kinds[:cut], kinds[cut:]) if k]
        ends = conversations.costs_after([conversations.costs_between(k) for k in parts], [k.count(-1) for k in parts])
        whole = conversations.least_edits(kinds, [0, 4, 2, 0])
        first = conversations.least_edits(parts[0], ends[0])
        for s in conversations.STATES:
            later = 3 * sum(k.count(-1) for k in parts[1:])
            assert first[s][0] - later == whole[s][0]


# 13: centroid clustering

VECTORS = "vec_id long, embedding array<double>"


def by_scans(rows, k=40, rounds=5):
    kept = [(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]
    if not centroids:
        return []
    x = np.array([v for _, v in kept], object)

    def nearest():
        d = np.array([((x - np.array(c, object)) ** 2).sum(1) for c in centroids])
        return d.argmin(0), d.min(0)

    for _ in range(rounds):
        own, _ = nearest()
        for c in range(len(centroids)):
            if (own == c).any():
                centroids[c] = [int(s) // int((own == c).sum()) for s in x[own == c].sum(0)]
    own, d = nearest()
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, int(c), int(e), int(d[own == c].sum()), int(d.sum()), digests[c]) for (i, _), c, e in zip(kept, own, d, strict=True)], key=str)


def odd_vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (9, 64))
    rows = [(i, (centres[i % 9] + rng.normal(0, 0.2, 64)).round(2).tolist()) for i in range(300)]
    rows += [(1000 + i, [float(i % 3)] * 64) for i in range(30)]  # ties
    rows += [(2000, None), (2001, []), (2002, [0.5] * 63), (2003, [0.5] * 65), (2004, [None] + [0.5] * 63), (2005, [float("nan")] + [0.5] * 63), (2006, [float("inf")] * 64)]
    return rows + rows[:40] + [(None, [0.25] * 64)] + [(7, [0.125] * 64)] * 200


def test_clusters_by_scans(spark):
    rows = odd_vectors()
    assert rows_of(clusters.clusters(spark.createDataFrame(rows, VECTORS).repartition(5))) == by_scans(rows)


def test_clusters_of_few_and_no_vectors(spark):
    rows = [(1, [0.1] * 64), (2, [0.1] * 64), (3, [-0.9] * 64)]
    assert rows_of(clusters.clusters(spark.createDataFrame(rows, VECTORS))) == by_scans(rows)
    assert clusters.clusters(spark.createDataFrame([], VECTORS)).collect() == []
    assert clusters.clusters(spark.createDataFrame([(1, None), (2, [1e300] * 64)], VECTORS)).collect() == []


def test_clusters_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = sorted(con.execute(clusters.clusters_sql()).fetchall(), key=str)
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert rows_of(clusters.clusters(table)) == want
    clashing = table.select("*", *(F.lit(1).alias(c) for c in ("x", "cluster", "was", "upper", "lower", "distance")))
    assert rows_of(clusters.clusters(clashing)) == want


def test_bounds_hold_and_spare_scans():
    rng = np.random.default_rng(2)
    centres = rng.integers(-400, 400, (20, 64))
    x = (centres[rng.integers(0, 20, 3000)] + rng.integers(-60, 60, (3000, 64))).astype(np.int64)
    before = x[:20].copy()
    own, upper, lower = clusters.scanned(x, before)
    scans = []
    for _ in range(6):
        after = np.array([x[own == c].sum(0) // max(1, (own == c).sum()) if (own == c).any() else before[c] for c in range(20)])
        own, upper, lower, n = clusters.moved(x, own, upper, lower, before, after)
        d = clusters.squared(x, after)
        assert (own == d.argmin(1)).all()
        nearest = np.sort(d, 1)
        assert (upper >= np.sqrt(nearest[:, 0])).all() and (lower <= np.sqrt(nearest[:, 1])).all()
        before = after
        scans.append(n)
    assert scans[-1] < 0.15 * len(x)


def test_large_components_are_exact():
    x = np.array([[clusters.LIMIT * 256 - 1] * 64, [-clusters.LIMIT * 256] * 64], np.int64)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v, strict=True)) for v in x] for u in x]
    assert clusters.squared(x, x).tolist() == want
