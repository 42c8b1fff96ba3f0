"""Whole screenings, evidence families, extraction and the store."""

import datetime

import pytest
from pyspark.sql import functions as F

from inkspark.engine import screen
from inkspark.operators import evidence, extraction, reasons
from inkspark.operators.weights import FLAG_IDS
from inkspark.sources import seeds, store

TD3 = ["P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"]


def zones(spark, **changed):
    rows = [("good", TD3), ("bad", [TD3[0], "L898902C30UTO7408122F1204159ZE184226B<<<<<10"]), ("none", ["x"])]
    return spark.createDataFrame(rows, "id string, lines array<string>")


def test_screening(spark):
    listed = spark.createDataFrame([("S1", "stolen_document", "document_number", "L898902C3", None, None, None)], seeds.ENTRY)
    got = screen(zones(spark), listed, "2010-01-01")
    scores = {r["id"]: r for r in got.scores.collect()}
    flags = sorted((r["key"], r["id"]) for r in got.flags.collect())
    assert flags == [("bad", "MRZ_COMPOSITE_CHECK_DIGIT_MISMATCH"), ("bad", "MRZ_DOCUMENT_NUMBER_CHECK_DIGIT_MISMATCH"), ("bad", "WATCHLIST_STOLEN_DOCUMENT"), ("good", "WATCHLIST_STOLEN_DOCUMENT")]
    assert (scores["good"]["score"], scores["good"]["band"], scores["good"]["hard_failed"]) == (55.0, "review", False)
    assert (scores["bad"]["score"], scores["bad"]["band"], scores["bad"]["hard_failed"]) == (100.0, "high", True)
    assert (scores["none"]["score"], scores["none"]["band"]) == (0.0, "low")
    assert scores["good"]["summary"].startswith("Risk band: review (55).\n1 finding.\n- The document number is recorded")
    assert all(r["reason"] for r in got.flags.collect())


def test_every_flag_has_a_sentence():
    assert [r[0] for r in reasons.REASONS] == FLAG_IDS


def test_dates_and_modules(spark):
    rows = spark.createDataFrame([(1, datetime.date(1990, 1, 1), datetime.date(2021, 1, 1), datetime.date(2020, 1, 1)), (2, None, None, None)], "id int, birth date, issue date, expiry date")
    assert sorted(r["id"] for r in evidence.from_dates(rows, "id", F.lit("2020-06-01").cast("date")).collect()) == ["DATE_EXPIRED", "DATE_ISSUE_AFTER_EXPIRY", "DATE_NOT_YET_VALID"]
    results = spark.createDataFrame([(1, "ela", 1.5, True), (1, "morph", 0.2, False)], "id int, module string, score double, suspect boolean")
    flags = evidence.from_modules(results, "id").collect()
    assert [(r["id"], r["value"]) for r in flags] == [("TAMPER_ELA_ANOMALY", 1.0)]
    with pytest.raises(Exception, match="unknown module other"):
        evidence.from_modules(spark.createDataFrame([(1, "other", 1.0, True)], results.schema), "id").collect()


def test_payload_and_versions(spark):
    flags = evidence.from_check_digits(zones(spark), "id")
    scores = spark.createDataFrame([("bad", "high"), ("good", "low")], "id string, band string")
    got = {r["id"]: r["payload"] for r in evidence.payload(flags, scores, "id").collect()}
    assert got["good"] == '{"band":"low","flags":[]}'
    assert '"id":"MRZ_COMPOSITE_CHECK_DIGIT_MISMATCH"' in got["bad"]
    maps = spark.createDataFrame([(1, {"b": "2", "a": "1"})], "id int, model_versions map<string,string>")
    assert [(r["position"], r["model"]) for r in evidence.model_rows(maps, "id").collect()] == [(0, "a"), (1, "b")]
    with pytest.raises(Exception, match="in both: a"):
        maps.select(evidence.merged(F.col("model_versions"), F.create_map(F.lit("a"), F.lit("x")))).collect()


def test_extraction(spark):
    page = ["Full Name: Müller Anna", "Passport No X1234567 extra", "Date of birth 12 AUG 1974", "Expiry date: soon"]
    words = [(1, r, i, w) for r, line in enumerate(page) for i, w in enumerate(line.split())]
    got = {r["field"]: r["value"] for r in extraction.fields(spark.createDataFrame(words, "page int, row int, left int, text string"), "passport").collect()}
    assert got == {"name": "MULLER ANNA", "passport_number": "X1234567", "date_of_birth": "1974-08-12"}


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    s.create()
    row = spark.createDataFrame([("a", datetime.datetime(2024, 1, 1))], "id string, created_at timestamp")
    full = row.select(*(F.col(f.name) if f.name in row.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in s.read("screenings").schema))
    s.append("screenings", full)
    s.append("screenings", full.union(full.withColumn("id", F.lit("b"))))
    assert sorted(r["id"] for r in s.live().collect()) == ["a", "b"]
    event = spark.createDataFrame([("e1", "a", "analysis_completed", "system", "{}", "00" * 16, datetime.datetime(2024, 1, 1))], "id string, screening_id string, event_type string, actor string, payload string, record_salt string, created_at timestamp")
    s.emit(event)
    s.emit(event)
    assert s.read("events").count() == 1
    assert [r["id"] for r in s.pending().collect()] == ["b"]
    s.append("tombstones", spark.createDataFrame([("b", datetime.datetime(2024, 1, 2))], "id string, at timestamp"))
    assert s.pending().collect() == []
    assert s.ready()
    with pytest.raises(Exception, match="unknown event odd"):
        s.emit(event.withColumn("event_type", F.lit("odd")).withColumn("id", F.lit("e2")))
    with pytest.raises(ValueError, match="store"):
        store.Store(spark, "ftp://x")


def test_cascade(spark):
    from inkspark.operators import stages

    rows = zones(spark).withColumns({"birth": F.lit(None).cast("date"), "issue": F.lit(None).cast("date"), "expiry": F.lit("2012-04-15").cast("date")})
    tiers = [("zone", lambda d: evidence.from_check_digits(d, "id")), ("broken", lambda d: d.select("no_such_column")), ("dates", lambda d: evidence.from_dates(d, "id", F.lit("2020-01-01").cast("date")))]
    flags, trace = stages.cascade(rows, "id", tiers, isolate=True)
    got = {(r["key"], r["stage"]): (r["flags_added"], r["hard_failed"], r["failed"]) for r in trace.collect()}
    assert got["bad", "zone"] == (2, True, False)
    assert ("bad", "dates") not in got
    assert got["good", "broken"] == (0, False, True)
    assert got["good", "dates"] == (1, False, False)
    assert sorted({(r["key"], r["stage"]) for r in flags.collect()}) == [("bad", "zone"), ("good", "dates"), ("none", "dates")]
    with pytest.raises(Exception, match="no_such_column"):
        stages.cascade(rows, "id", tiers)
