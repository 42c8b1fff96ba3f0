"""What is plugged in, what stands in for it, and the store's refusals."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from inkspark.operators import regions, risk, seams, sides
from inkspark.operators.weights import weightset
from inkspark.sources import store


def pages(spark, n=3):
    return spark.range(n).select(F.col("id").alias("page"))


def test_stand_ins_answer_nothing_or_say_what_they_are(spark):
    for kind in ("words", "barcodes", "faces"):
        assert seams.STAND_INS[kind].answers(pages(spark)).collect() == []
    got = seams.STAND_INS["embedding"].answers(pages(spark)).collect()
    assert len(got) == 3 and all(r["is_stub"] and set(r["vector"]) == {0.0} and len(r["vector"]) == 512 for r in got)
    assert [r["suspect"] for r in seams.STAND_INS["classifier"].answers(pages(spark)).collect()] == [False] * 3


def test_modules_are_checked_before_they_run(spark):
    real = seams.Seam("edges", "classifier", "v1", False, lambda p: p.select("page", F.lit(0.5).alias("score"), F.lit(True).alias("suspect"), F.lit("x").alias("detail")))
    rows = seams.run_all(pages(spark), [real, seams.STAND_INS["classifier"]]).collect()
    assert sorted((r["module"], r["score"]) for r in rows if r["page"] == 0) == [("edges", 0.5), ("no_classifier", None)]
    assert seams.chosen([real], "classifier") is real and seams.chosen([real], "words") is seams.STAND_INS["words"]
    for bad in ([], [real, real], [real, seams.STAND_INS["words"]]):
        with pytest.raises(ValueError):
            seams.run_all(pages(spark), bad)
    with pytest.raises(ValueError):
        seams.Seam("x", "magic", "v1", False, lambda p: p)
    with pytest.raises(ValueError):
        seams.Seam(" ", "words", "v1", False, lambda p: p)


def test_summaries_fall_back(spark):
    payloads = spark.createDataFrame([(0, "score 12 on 2024-05-01"), (1, "score 12"), (2, "score 12")], "page long, payload string")
    written = spark.createDataFrame([(0, "The score is 12."), (1, "The score is 99.")], "page long, text string")
    by_rule = seams.summaries(written, payloads, lambda t, p: F.contains(t, F.lit("12")), lambda p: p).collect()
    assert {r["page"]: r["source"] for r in by_rule} == {0: "model", 1: "template", 2: "template"}


def test_small_sides(spark):
    plan = lambda side: pages(spark, 100).join(side, "page")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(sides.small(pages(spark, 5), 5))
    assert "broadcast" not in plan(sides.small(pages(spark, 6), 5))


def test_partial_scores(spark):
    flags = spark.createDataFrame([("a", "tier1", "OCR_MRZ_MISMATCH", 1.0), ("a", "tier0", "MRZ_DOB_CHECK_DIGIT_MISMATCH", 1.0), ("b", "tier0", "OCR_MRZ_MISMATCH", 1.0)], "doc string, tier string, id string, value double")
    assert [tuple(r) for r in risk.partial(flags, weightset(spark), "doc", "tier1").collect()] == [("a", 55.0)]


def test_font_and_turned_boxes(spark):
    rows = spark.createDataFrame([(1, 10, 20, 4, 8)], "id int, left int, top int, width int, height int")
    got = regions.turned(rows, F.lit(90.0), F.lit(0.0), F.lit(0.0)).first()
    assert (got["left"], got["top"], got["width"], got["height"]) == (-28, 10, 8, 4)
    assert tuple(regions.turned(rows, F.lit(0.0), F.lit(5.0), F.lit(5.0)).select(*rows.columns).first()) == (1, 10, 20, 4, 8)


def test_store_reads_and_refusals(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    s.create()
    trace = spark.createDataFrame([("a", "tier0", 5, 1, False, True), ("a", "tier1", 7, 2, True, False), ("b", "tier0", 1, 0, False, False)], "screening_id string, tier string, elapsed_ms bigint, flags_found int, hard_failed boolean, escalated boolean")
    s.measured(trace)
    s.measured(trace)  # run again after a loss
    s.outcomes(trace)
    s.outcomes(trace)
    assert s.read("tier_latency").count() == 3
    assert sorted(map(tuple, s.read("cascade_outcome").collect())) == [("a", 2, 12, 3, True, True), ("b", 1, 1, 0, False, False)]
    s.append("ledger", spark.createDataFrame([(2, "r2", "s", None), (1, "r1", "s", None)], store.SCHEMAS["ledger"]))
    with pytest.raises(ValueError, match="there already"):
        s.anchor(spark.createDataFrame([(3, "r3", "s", None), (2, "other", "s", None)], store.SCHEMAS["ledger"]))
    s.append("ledger", spark.createDataFrame([(2, "other", "s", None)], store.SCHEMAS["ledger"]))
    assert [r["batch"] for r in s.batches()] == [1, 2]
    assert s.batch(2).first()["merkle_root"] == "r2" and s.batch(3).count() == s.event("x").count() == s.screening("x").count() == 0
    for name in ("events", "ledger", "screenings"):
        with pytest.raises(PermissionError):
            s.amend(name, "row")


def test_database_guards():
    con = sqlite3.connect(":memory:")
    for statement in [*store.tables("sqlite"), *store.guards("sqlite"), *store.guards("sqlite")]:
        con.execute(statement)
    con.execute("insert into ledger values (1, 'r', 's', null)")
    for statement in ("update ledger set merkle_root = 'x'", "delete from ledger"):
        with pytest.raises(sqlite3.IntegrityError, match="append-only"):
            con.execute(statement)
    assert con.execute("select merkle_root from ledger").fetchall() == [("r",)]
    assert sum("TRIGGER" in x for x in store.guards("postgresql")) == sum("RAISE EXCEPTION" in x for x in store.guards("postgresql")) == 4
    with pytest.raises(ValueError):
        store.guards("oracle")


def test_face_modules(spark):
    import numpy as np

    from inkspark.operators import vision

    flat = np.kron(np.random.default_rng(1).integers(0, 256, (8, 8)), np.ones((8, 8))).astype(np.uint8)
    rows = spark.createDataFrame([(1, (64, 64, 1, flat.tobytes())), (2, (64, 64, 1, bytes(64 * 64)))], "page long, image struct<height:int,width:int,nChannels:int,data:binary>")
    got = {(r["page"], r["module"]): r for r in seams.run_all(rows, vision.face_modules()).collect()}
    assert got[1, "tamper_deepfake"]["suspect"] and got[1, "tamper_deepfake"]["detail"].endswith(", suspected.")
    assert all(page == 1 and r["is_stub"] for (page, _), r in got.items())


@pytest.mark.parametrize("answer, want", [('{"choices": [{"message": {"content": " Fine. "}}]}', "Fine."), ('{"choices": []}', None), ("no json", None), (None, None)])
def test_completions(answer, want):
    import http.server
    import threading
    import time

    from inkspark.functions import text

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            if answer is None:
                time.sleep(1.5)
            self.send_response(200)
            self.end_headers()
            self.wfile.write((answer or "late").encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.handle_request, daemon=True).start()
    assert text.completion(f"http://127.0.0.1:{server.server_port}/v1", "Say", 0.5 if answer is None else 5) == want
    server.server_close()
    assert text.completion("http://127.0.0.1:9/none", "Say", 0.5) is None


def test_handles(spark, tmp_path):
    from inkspark import api

    s = store.Store(spark, f"file://{tmp_path}/tables")
    handles = api.Handles(spark, s)
    assert handles.ready().first()["storage"] == "not_ready"
    s.create()
    assert handles.ready().first()["storage"] == "ready"
