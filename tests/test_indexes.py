"""Spelling join, page and text indexes, retention, observed metrics, fields by place: equal to the plain way, and what they read."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from inkspark.functions import names
from inkspark.operators import regions, screenings, spelling
from inkspark.sources import store
from inkspark.sources.pages import Pages
from inkspark.sources.retention import DailyStore
from inkspark.sources.text_index import TextIndex

UTC = datetime.timezone.utc


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


# Names


def misspelt(rng, name):
    words = name.split()
    rng.shuffle(words)
    text = " ".join(words)
    for _ in range(rng.choice([0, 1, 1, 2, 3])):
        at = rng.randrange(len(text) or 1)
        text = rng.choice([text[:at] + text[at + 1 :], text[:at] + rng.choice("AEIOUX") + text[at:], text[:at] + "Q" + text[at + 1 :]])
    return text


def name_tables():
    rng = random.Random(6)
    syllables = "MA RI KO VAN DER SEN BERG LOU ANN TO UEB SS PH ZIM".split()
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    made = [" ".join(word(rng.choice([1, 2, 3, 4])) for _ in range(rng.choice([1, 2, 2, 3, 4, 5]))) for _ in range(120)]
    made += [" ".join(word(4) for _ in range(20)), word(9) + " " + word(12), word(30) + " JO", word(31), word(33) + " X"]  # a word may be left over; words that differ themselves; words beyond that
    made += ["MARIA " + word(3) for _ in range(20)]  # a common word
    left = list(enumerate(made)) + [(900, None), (901, ""), (902, " - "), (903, made[0].lower()), (904, made[0])]
    right = [(i, misspelt(rng, n)) for i, n in enumerate(made * 2)] + [(900, None), (901, "."), (902, made[120].split(" ", 1)[1]), (903, made[1])]
    return left, right


@pytest.mark.parametrize("tolerance", [0.95, 0.88, 1.0])
def test_spelling_join_by_all_pairs(spark, tolerance):
    left, right = name_tables()
    l, r = (spark.createDataFrame(x, "k int, name string") for x in (left, right))
    got = {(x["name_l"], x["name_r"]): x for x in spelling.spelling_join(l, r, "k", "name", tolerance).collect()}
    words = [{" ".join(x["words_s"]): (x["words_s"], x["key_s"], x["n_s"]) for x in spelling.distinct_names(df, "k", "name", "s").collect()} for df in (l, r)]
    want = {}
    for (a, (wa, ka, na)), (b, (wb, kb, nb)) in itertools.product(words[0].items(), words[1].items()):
        score, pairs = names.paired(wa, wb)
        if score >= tolerance:
            want[a, b] = (ka, na, kb, nb, score, [tuple(p) for p in pairs if p[0] != p[1]])
    assert got.keys() == want.keys() and len(want) > 40
    for key, x in got.items():
        assert (x["key_l"], x["n_l"], x["key_r"], x["n_r"], x["similarity"], [tuple(p) for p in x["differing"]]) == want[key]


def test_spelling_join_has_no_nested_loop(spark):
    left, right = name_tables()
    l, r = (spark.createDataFrame(x, "k int, name string") for x in (left, right))
    frame = spelling.spelling_join(l, r, "k", "name")
    assert "NestedLoop" not in plan(frame) and "Cartesian" not in plan(frame)
    # A common word brings no candidates by itself.
    common = spark.createDataFrame([(i, f"MARIA {c}{d}TOKOVA") for i, (c, d) in enumerate(itertools.product("ABCDEFGHIJ", repeat=2))], "k int, name string")
    few = spelling.candidates(spelling.distinct_names(common, "k", "name", "l"), spelling.distinct_names(common.filter("k < 50"), "k", "name", "r"))
    assert few.count() < 50 * 25


def test_numbered_names_meet_their_copies_only(spark):
    """A word of 18 letters lets another of 20 differ in two, but one of 17 in one only: names that differ in a digit too don't become candidates."""
    rows = [(i, f"Customer#{i:09} {s}") for i in range(300) for s in ("FURNITURE", "BUILDING")]
    copies = [(i, n[: i % 9] + n[i % 9 + 1 :]) for i, n in rows]
    l, r = (spelling.distinct_names(spark.createDataFrame(x, "k int, name string"), "k", "name", s) for x, s in ((rows, "l"), (copies, "r")))
    assert spelling.candidates(l, r).filter("key_l = key_r").count() == spelling.candidates(l, r).count() == len(rows)


def test_pairing_of_names():
    score, pairs = names.paired(["ANNA", "BERG"], ["ANNA", "BERGA"])
    assert score == 0.9 and sorted(map(sorted, pairs)) == [["ANNA", "ANNA"], ["BERG", "BERGA"]]
    assert names.paired([], []) == (None, [])
    score, pairs = names.paired(["A", "B"], ["A"])
    assert score == 0.5 and sorted(map(sorted, pairs)) == [["", "B"], ["A", "A"]]


# Pages


def test_pages_equal_offset(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 7919 % 1000).alias("created_at"), F.col("id"))
    pages = Pages(spark, str(tmp_path)).build(rows, ["created_at", "id"], 16)
    assert pages.count() == 5000
    for offset, limit in ((0, 20), (4980, 20), (4990, 20), (1234, 200), (6000, 20), (313, 1)):
        want = rows.orderBy("created_at", "id").offset(offset).limit(limit).collect()
        assert Pages(spark, str(tmp_path)).page(offset, limit).collect() == want
    with pytest.raises(ValueError, match="limit"):
        pages.page(0, 201)
    empty = Pages(spark, str(tmp_path / "none")).build(rows.limit(0), ["created_at", "id"])
    assert empty.count() == 0 and empty.page(0).collect() == []


def test_a_late_page_reads_one_range(spark, tmp_path):
    rows = spark.range(20_000).select(F.col("id").alias("created_at"), "id")
    pages = Pages(spark, str(tmp_path)).build(rows, ["created_at", "id"], 16)
    for number in (0, 500, 999):
        assert 1 <= len(pages.page(number * 20, 20).inputFiles()) <= 2
    assert len(spark.read.parquet(str(tmp_path / "rows")).inputFiles()) == 16


# Search


def test_search_reads_the_files_that_may_hold_it(spark, tmp_path):
    kinds = ["passport", "Visa Größe", "id card"]
    rows = spark.createDataFrame([(i, f"case-{i:05d}", kinds[i * 3 // 3000], None if i % 5 else "low") for i in range(3000)], "id int, name string, kind string, band string")
    columns = ["name", "kind", "band"]
    index = TextIndex(spark, str(tmp_path), columns).build(rows, ["id"], 250)
    n = len(spark.read.parquet(str(tmp_path / "rows")).inputFiles())
    for term in ("case-00777", "PASSPORT", "größe", "GRÖSSE", "low", "se", "", "no such thing", "01 visa gr", "card low"):
        want = sorted(r["id"] for r in screenings.search(rows, columns, term).collect())
        assert sorted(r["id"] for r in index.search(term).collect()) == want, term
    assert n >= 12
    assert len(index.files("case-00777")) <= 2
    assert n / 4 <= len(index.files("passport")) <= n / 2
    assert index.files("no such thing") == [] and index.files("se") is None
    assert len(index.search("case-00777").inputFiles()) == len(index.files("case-00777"))


# Retention


def test_sweep_deletes_what_nothing_refers_to(spark, tmp_path):
    day = datetime.date(2024, 1, 1)
    digest = lambda k: f"{k:064x}"
    content = lambda *ks: spark.createDataFrame([(digest(k), 3, f"body {k}") for k in ks], "digest string, size long, body string")
    kept = DailyStore(spark, str(tmp_path / "store"))
    assert kept.sweep(spark.createDataFrame([], "reference string"), datetime.datetime(2024, 5, 1, tzinfo=UTC)).count() == 0
    kept.add(content(1, 2, 3), day)
    kept.add(content(4), day + datetime.timedelta(days=1))
    kept.add(content(3, 5, 5), day + datetime.timedelta(days=40))  # 3 is stored already
    refs = spark.createDataFrame([(f"sha256:{digest(2)}:3",), (None,), ("not a reference",)], "reference string")
    now = datetime.datetime(2024, 1, 31, 12, tzinfo=UTC)
    swept = lambda days: sorted(int(r["digest"], 16) for r in kept.sweep(refs, now, days).collect())
    assert swept(30) == []  # exactly thirty days old is not over it
    assert swept(29) == [1, 3]
    assert swept(29) == []  # a second sweep deletes nothing
    assert sorted((int(r["digest"], 16), r["body"]) for r in kept.read().collect()) == [(2, "body 2"), (4, "body 4"), (5, "body 5")]
    assert swept(28) == [4] and kept._days() == ["2024-01-01", "2024-02-10"]
    for bad in (lambda: kept.sweep(refs, now, 0), lambda: kept.sweep(refs, now.replace(tzinfo=None), 5)):
        with pytest.raises(ValueError):
            bad()


def test_a_killed_sweep_is_taken_up(spark, tmp_path):
    """Killed after a day was removed and before what stays took its place."""
    kept = DailyStore(spark, str(tmp_path / "store"))
    kept.add(spark.createDataFrame([("0" * 64, 1), ("1" * 64, 1)], "digest string, size long"), datetime.date(2024, 1, 1))
    refs = spark.createDataFrame([("sha256:" + "1" * 64 + ":1",)], "reference string")
    fs, steps = kept._fs(), []

    class Dying:
        def __getattr__(self, name):
            def call(*args):
                steps.append(name)
                if steps.count("rename") == 2:
                    raise OSError("killed")
                return getattr(fs, name)(*args)

            return call

    dying = DailyStore(spark, str(tmp_path / "store"))
    dying._fs = lambda: Dying()
    now = datetime.datetime(2024, 5, 1, tzinfo=UTC)
    with pytest.raises(OSError, match="killed"):
        dying.sweep(refs, now)
    assert kept._days() == []
    assert kept.sweep(refs, now).count() == 0
    assert [r["digest"] for r in kept.read().collect()] == ["1" * 64]


# Metrics


def test_metrics_are_observed_while_writing(spark, tmp_path):
    kept = store.Store(spark, f"file://{tmp_path}/store")
    kept.create()
    rows = [("a", "tier0", 5, 1, False, True), ("a", "tier1", 7, 2, True, False), ("b", "tier0", 9, 0, False, False)]
    computed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            computed.add(b.num_rows)
            yield b

    schema = "screening_id string, tier string, elapsed_ms bigint, flags_found int, hard_failed boolean, escalated boolean"
    trace = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    got = kept.measured(trace)
    assert computed.value == 3  # each row was computed once
    assert got["tier0"] == {"runs": 2, "elapsed_ms": 14, "slowest_ms": 9, "flags": 1, "hard_failures": 0}
    assert got["tier1"] == {"runs": 1, "elapsed_ms": 7, "slowest_ms": 7, "flags": 2, "hard_failures": 1}
    assert set(got["tier2"].values()) == {0}
    assert kept.read("tier_latency").count() == 3


# Fields by place


def test_fields_by_place_equal_all_pairs(spark):
    rng = random.Random(2)
    blobs = [(k % 3, rng.uniform(-200, 900), rng.uniform(-200, 900), rng.randint(1, 9)) for k in range(400)] + [(9, 64.0, 0.0, 1), (9, 128.0, 64.0, 1)]
    fields = [(f"f{k}", rng.randrange(-100, 800), rng.randrange(-100, 800), 10, 4) for k in range(60)] + [("edge", -5, -2, 10, 4)]
    b = spark.createDataFrame(blobs, "doc int, cx double, cy double, area int")
    t = spark.createDataFrame(fields, "field string, x int, y int, width int, height int")
    own = {}
    for doc, cx, cy, area in blobs:
        near = sorted((((cx - x - w / 2) ** 2 + (cy - y - h / 2) ** 2) ** 0.5, f, x + w / 2, y + h / 2) for f, x, y, w, h in fields)[0]
        if near[0] <= 64:
            own.setdefault((doc, near[1], near[2], near[3]), []).append((cx, cy, area))
    want = {}
    for (doc, f, fx, fy), found in own.items():
        total = sum(a for *_, a in found)
        mx, my = (sum(p[i] * p[2] for p in found) / total for i in (0, 1))
        want[doc, f] = ((mx - fx) ** 2 + (my - fy) ** 2) ** 0.5
    frame = regions.layout_deviations(b, t, "doc")
    got = {(r["doc"], r["field"]): r["deviation"] for r in frame.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    from unittest import mock

    with mock.patch("inkspark.operators.sides.ROWS", 0), mock.patch.object(regions, "small", lambda side: side):
        large = regions.layout_deviations(b, t, "doc")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            assert "NestedLoop" not in plan(large) and "Cartesian" not in plan(large)
            assert {(r["doc"], r["field"]) for r in large.collect()} == want.keys()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
