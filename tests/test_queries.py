"""Every query with an SQL twin gives the twin's rows; every other one runs."""

import datetime
import decimal

import duckdb
import pytest

from inkspark.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v.isoformat(sep=" ") if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, SF)
    rows = frame.collect()
    if name not in ORACLES:
        assert rows
        return
    got = con.execute(ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(frame.columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in got.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in rows) == want


def test_tokens_by_python(spark, con):
    """Numbers, dates and capitalised words as Python's expressions find them."""
    import re

    from inkspark.functions import text

    found = lambda pattern, t: re.findall(pattern, t, re.ASCII)
    texts = dict(con.execute(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall())
    got = QUERIES["extract_tokens"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]]
        assert (r["numbers"], r["dates"], r["n_capitalised"]) == (",".join(found(text.NUMBER, t)), ",".join(found(text.DATE, t)), len(found(text.CAPITALISED, t)))


def test_reading_rows_by_hand(spark, con):
    """Each word joins the first row whose extent it meets, which it widens."""
    want, pages = {}, {}
    for page, pos, top in sorted(con.execute("select l_orderkey, l_linenumber, cast(l_quantity as int) from lineitem").fetchall()):
        spans = pages.setdefault(page, [])
        row = next((i for i, (a, b) in enumerate(spans) if top < b and a < top + 5), len(spans))
        spans[row : row + 1] = [(min(top, spans[row][0]), max(top + 5, spans[row][1])) if row < len(spans) else (top, top + 5)]
        want.setdefault((page, pos), []).append(row)
    got = {}
    for r in QUERIES["reading_rows"](spark, SF).collect():
        got.setdefault((r["page"], r["pos"]), []).append(r["row"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def planes(con):
    import numpy as np

    for key, vector in con.execute("select vec_id, embedding from embeddings").fetchall():
        levels = np.clip([int(decimal.Decimal(float(x) * 256).quantize(0, decimal.ROUND_HALF_UP)) + 128 for x in vector], 0, 255).astype(np.uint8)
        yield key, np.kron(levels.reshape(8, 8), np.ones((8, 8), np.uint8))


def test_image_queries_by_kernels(spark, con):
    """Each image query gives what its kernel gives for each plane alone."""
    from inkspark.functions import capture, pixels

    own = dict(planes(con))
    rows = lambda name: QUERIES[name](spark, SF).collect()
    near = lambda a, b: a == b or a == pytest.approx(b, abs=1e-9)
    for name, kernel in (("ela_heatmap", pixels.error_levels), ("noise_map", pixels.noise_map)):
        got = {r["id"]: r for r in rows(name)}
        for k, plane in own.items():
            heat = kernel(plane)
            score, y, x = pixels.peak(heat)
            assert near(got[k]["score"], score) and (got[k]["block_y"], got[k]["block_x"], got[k]["region"]) == (y, x, int(pixels.region(heat, max(score / 2, 1e-9)).sum()))
    assert {r["id"]: r["pairs"] for r in rows("copy_moves")} == {k: n for k, p in own.items() if (n := len(pixels.copies(p)))}
    boxes = sorted((k, *b) for k, p in own.items() for b in pixels.boxes(*pixels.components(p < p.mean() * 0.6)))
    assert sorted(map(tuple, rows("glyph_components"))) == boxes
    for r in rows("face_suspicion"):
        morph, fake = pixels.morph_cues(own[r["id"]]) or (None,) * 4, pixels.deepfake_cue(own[r["id"]]) or (None,) * 2
        assert tuple(r)[1:] == (*morph, *fake)
    report = sorted(((k, *x) for k, p in own.items() for x in capture.report(p)), key=str)
    assert sorted(map(tuple, rows("quality_report")), key=str) == report
    flags = {name: flag for name, flag, _ in capture.CHECKS}
    assert sorted((r["id"], r["flag"]) for r in rows("quality_flags")) == sorted((x[0], flags[x[1]]) for x in report if x[4] is False)
    scores = {r["id"]: r for r in rows("anomaly_forest")}
    assert set(scores) == set(own)
    for k, p in own.items():
        assert scores[k]["features"] == pytest.approx(pixels.features(p))
    apart = [sorted(r["raw"] for r in scores.values() if r["outlier"] is side) for side in (False, True)]
    assert all(0 <= r["score"] <= 1 for r in scores.values())
    assert not apart[1] or apart[0][-1] < apart[1][0]


def test_cosine_topk_by_shown_score(spark, tmp_path):
    """Scores that are equal when shown go by their key; zero vectors, gaps and what isn't finite as the twin has them."""
    import math

    near = [(i, [math.cos(a), math.sin(a)]) for i, a in ((k, (30 - k) * 1e-4) for k in range(1, 25))]  # all shown as 1.0, later ones nearer
    odd = [(30, [0.0, 0.0]), (31, [float("nan"), 1.0]), (32, None), (33, [float("inf"), 1.0]), (34, [1.0, None]), (35, []), (36, [0.9])]
    rows = spark.createDataFrame([(0, [1.0, 0.0]), *near, *odd], "vec_id long, embedding array<float>")
    for frame, name in ((rows.filter("vec_id < 30"), "near"), (rows, "odd"), (rows.filter("vec_id = 0 or vec_id >= 30"), "few")):
        frame.coalesce(1).write.parquet(str(tmp_path / name / "embeddings.parquet"))
        con = duckdb.connect()
        con.execute(f"create view embeddings as select * from '{tmp_path}/{name}/embeddings.parquet/*.parquet'")
        want = [tuple(map(plain, r)) for r in con.execute(ORACLES["cosine_topk"]).fetchall()]
        assert [tuple(map(plain, r)) for r in QUERIES["cosine_topk"](spark, str(tmp_path / name)).collect()] == want


def test_unread_pages_of_many_files(spark, tmp_path):
    """A page at the limit whose words stand in several files: confidences are added up in the order of the table's rows."""
    pages = [(3, 10, 10, 9), (5, 8, 10, 9), (5, 10, 8, 9), (6, 7, 10, 9), (8, 8, 8, 8), (10, 10, 8, 4)]
    for part in (0, 2):
        rows = [(k, 2 + i, page[i] / 100) for k, page in enumerate(pages) for i in (part, part + 1)]
        spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_discount double").coalesce(1).write.parquet(str(tmp_path / f"part{part}"))
    (tmp_path / "lineitem.parquet").mkdir()
    for part in (0, 2):
        next((tmp_path / f"part{part}").glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / f"{part}.parquet")
    spark.createDataFrame([(k,) for k in range(8)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect(config={"threads": 1})
    for t in ("lineitem", "orders"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(tuple(map(plain, r)) for r in con.execute(ORACLES["unread_pages"]).fetchall())
    assert sorted(tuple(map(plain, r)) for r in QUERIES["unread_pages"](spark, str(tmp_path)).collect()) == want
