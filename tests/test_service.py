"""Answers, anchoring, runs, readings and escalation against values worked out by hand."""

import base64
import datetime

import pytest
from pyspark.sql import functions as F

from inkspark import api
from inkspark.operators import anchoring, escalation, evidence, readings, regions, runs
from inkspark.operators.weights import weightset
from inkspark.sources import blobs

NOW = datetime.datetime(2024, 5, 1, 12)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_numbers_in_sentences(spark):
    for x, want in ((34.0, "34"), (34.5, "34.5"), (0.05, "0.05"), (1 / 3, "0.333333"), (100.25, "100.25"), (12.34567, "12.3457"), (0.0, "0")):
        assert one(spark, escalation.number_text(F.lit(x))) == want == f"{x:g}"


def test_escalation(spark):
    reason = lambda r1, kind, state, mode: one(spark, escalation.reasons(escalation.ambiguous(F.lit(r1)), escalation.high_risk(F.lit(kind), F.lit(state), ("Visa",), ("UTO",)), escalation.full_depth(F.lit(mode))))
    assert reason(34.0, "passport", "XXX", "staged") == []
    assert reason(34.5, " VISA ", "uto", "full") == ["R1 of 34.5 falls in the ambiguous band (34, 69].", "The document type 'VISA' is on the high-risk profile watchlist.", "The checkpoint is running in full-depth mode."]
    assert reason(69.0, None, "uto", None) == ["R1 of 69 falls in the ambiguous band (34, 69].", "The issuing state 'uto' is on the high-risk profile watchlist."]
    assert one(spark, escalation.reasons(escalation.high_risk(F.lit("visa"), F.lit("UTO")))) == []  # nothing is shipped
    assert one(spark, escalation.drawn(F.lit("a"), b"k", 1.0)) == "Drawn for a random deep audit at a rate of 1."
    assert one(spark, escalation.drawn(F.lit("a"), b"k")) is None
    with pytest.raises(ValueError):
        escalation.ambiguous(F.lit(1.0), 5, 5)


def events(spark):
    digest = "ab" * 32
    rows = [(i, NOW + datetime.timedelta(minutes=-i), 0 if i == 3 else None, 0 if i == 3 else None, digest) for i in range(1, 8)]
    return spark.createDataFrame(rows, "id long, created_at timestamp, batch long, batch_index long, digest string")


def test_anchoring(spark):
    rows = events(spark)
    assert [r["id"] for r in anchoring.pending(rows).collect()] == [7, 6, 5, 4, 2, 1]
    stamps, entries = anchoring.anchored(rows, bytes(32), size=4)
    got = {r["id"]: (r["batch"], r["batch_index"]) for r in anchoring.stamped(rows, stamps).collect()}
    assert got == {3: (0, 0), 7: (1, 0), 6: (1, 1), 5: (1, 2), 4: (1, 3), 2: (2, 0), 1: (2, 1)}
    assert [(r["batch"], r["n_leaves"], len(r["signature"])) for r in anchoring.entries(entries).collect()] == [(1, 4, 128), (2, 2, 128)]
    assert anchoring.entry(entries, 2).count() == 1 and anchoring.entry(entries, 9).count() == 0
    for bad in ((3, 5, 0), (99, 5, 0)):
        with pytest.raises(Exception, match="can't stamp"):
            anchoring.stamped(rows, spark.createDataFrame([bad], "id long, batch long, batch_index long")).collect()
    wanted = spark.createDataFrame([(4, 0), (1, 1), (3, 2), (50, 3), (6, 4), (6, 5)], "id long, pos long")
    assert {r["id"]: r["why"] for r in anchoring.refused(rows, wanted).collect()} == {3: "batched", 50: "missing", 6: "twice"}
    assert [r["id"] for r in anchoring.digests_of(rows, wanted).collect()] == [4, 1]


def test_salts(spark):
    fixed = [r[0] for r in spark.range(3).select(anchoring.salts(F.col("id"), "s")).collect()]
    fresh = [r[0] for r in spark.range(3).select(anchoring.salts(F.col("id"))).collect()]
    assert fixed == [r[0] for r in spark.range(3).select(anchoring.salts(F.col("id"), "s")).collect()]
    assert len(set(fixed)) == len(set(fresh)) == 3
    assert all(len(bytes.fromhex(x)) == 16 for x in fixed + fresh)


def test_explained_checks(spark):
    verified = spark.createDataFrame([(1, 4, "verified", "root,record,proof"), (2, 4, "unknown", "")], "id long, batch long, outcome string, checked string")
    got = {r["id"]: r for r in anchoring.explained(verified, spark.createDataFrame([(1,), (2,), (9,)], "id long")).collect()}
    assert (got[1]["status"], got[1]["batch"], len(got[1]["checked"])) == ("verified", 4, 3)
    assert (got[2]["batch"], got[2]["checked"]) == (None, [])
    assert got[9]["status"] == "unknown"
    with pytest.raises(Exception, match="no sentence"):
        spark.range(1).select(anchoring.sentences(F.array(F.lit("guess")))).collect()


def test_contributions_of_stored_screenings(spark):
    screenings = lambda *rows: spark.createDataFrame(rows, "id string, ruleset_version string")
    flags = spark.createDataFrame([("a", 1, "OCR_MRZ_MISMATCH", 1.0), ("a", 2, "OCR_LOW_CONFIDENCE", 0.5), ("b", 1, "OCR_MRZ_MISMATCH", 1.0)], "key string, position int, id string, value double")
    got = runs.contributions_of(screenings(("a", "v1"), ("b", None)), flags, weightset(spark), "v1").orderBy("position").collect()
    assert [(r["key"], r["contribution"]) for r in got] == [("a", 55.0), ("a", 7.5)]
    with pytest.raises(Exception, match="another ruleset"):
        runs.contributions_of(screenings(("a", "v0")), flags, weightset(spark), "v1").collect()


def test_run_events(spark):
    rows = spark.createDataFrame([("s", 1, NOW, "tier_completed"), ("s", 2, NOW, "officer_decision"), ("s", 0, NOW, "screening_created"), ("t", 5, NOW, "analysis_completed")], "screening_id string, id int, created_at timestamp, event_type string")
    assert [r["id"] for r in runs.run_events(rows).collect()] == [0, 1, 5]
    assert [r["id"] for r in runs.run_events(rows, "t").collect()] == [5]
    assert {r["screening_id"]: r["instants"] for r in runs.instants(rows, "screening_id", "tier_completed").collect()} == {"s": [NOW], "t": []}


def test_engines():
    assert readings.chosen_engine(["easyocr", "tesseract"]) == "tesseract"
    assert readings.chosen_engine(["easyocr"]) == "easyocr"
    assert readings.chosen_engine(["easyocr"], "tesseract") is None
    assert readings.chosen_engine([]) is None


def test_printed_fields_against_the_zone(spark):
    zone = spark.createDataFrame([(1, "FICTITIOUS", "JANE ANN", "X123", "900101", None), (2, "DOE<SMITH", "JOHN", "Y1", "800229", "300101")], "document int, surname string, given_names string, document_number string, date_of_birth string, date_of_expiry string")
    printed = [
        (1, "name", "Fictitious Jane Ann"), (1, "passport_number", "X124"), (1, "date_of_birth", "1990-01-01"), (1, "date_of_expiry", "2030-01-01"),
        (2, "name", "DOE SMITH JIM"), (2, "passport_number", None), (2, "date_of_birth", "1980-02-28"), (2, "date_of_expiry", "soon"),
    ]
    rows = spark.createDataFrame(printed, "document int, field string, value string")
    got = {(r["key"], r["field"]): r for r in readings.against_zone(rows, zone).collect()}
    assert set(got) == {(1, "passport_number"), (2, "name"), (2, "date_of_birth"), (2, "date_of_expiry")}
    name = got[2, "name"]
    assert (name["expected"], name["found"], name["reason"]) == ("3 name words", "2 agree", "2 of the 3 words the zone's name carries are on the printed page, and the tolerance is 0")
    assert not any("JIM" in str(v) for v in name)
    assert got[1, "passport_number"]["label"] == "the printed passport number disagrees with the machine-readable zone"
    assert (2, "name") not in {(r["key"], r["field"]) for r in readings.against_zone(rows, zone, 1).collect()}
    with pytest.raises(ValueError):
        readings.against_zone(rows, zone, -1)


def test_barcode_lines(spark):
    line = "L898902C<3UTO6908061F9406236ZE184226B<<<<<14"
    for text, want in ((f"P<UTO\n{line}\n", line), (line.lower(), line), (line[:-1], None), ("", None), (None, None)):
        assert one(spark, readings.barcode_line(F.lit(text).cast("string"))) == want


def test_faults_of_flags(spark):
    point = [{"x": 0, "y": 0}] * 3
    sound = ("X", 1, "label", "low", 0.5, 1.0, point, "because", "module")
    rows = [sound, (" ", 9, "", "none", float("nan"), 2.0, point[:2], None, None), (*sound[:6], None, "because", "module"), (*sound[:6], [{"x": -1, "y": 0}] * 3, "because", "module")]
    frame = spark.createDataFrame(rows, "id string, tier int, label string, weight_band string, value double, confidence double, region array<struct<x:int,y:int>>, reason string, source_module string")
    assert [r["faults"] for r in evidence.faults(frame).collect()] == [[], ["id", "tier", "label", "weight_band", "value", "confidence", "region", "reason", "source_module"], [], ["region"]]
    hits = spark.createDataFrame([("A-1", "blacklist", "document_number"), ("A 1", "blacklist", "document_number"), ("A", "friend", "x"), ("A", "identity_seen", "document_number"), (None, None, None)], "entry_id string, kind string, matched_on string")
    assert [r["fault"] for r in evidence.hit_faults(hits).collect()] == [None, "entry_id", "kind", "matched_on", "entry_id"]


def test_tolerances(spark):
    template = spark.createDataFrame([("a",), ("b",)], "field string")
    given = lambda *rows: spark.createDataFrame(rows, "field string, tolerance double")
    assert {r["field"]: r["tolerance"] for r in regions.tolerances(template, given(("a", 1.0), ("b", 2.0))).collect()} == {"a": 1.0, "b": 2.0}
    for rows in ([("a", 1.0)], [("a", 1.0), ("b", 0.0)], [("a", 1.0), ("b", 1.0), ("c", 1.0)]):
        with pytest.raises(Exception, match="no sound tolerance"):
            regions.tolerances(template, given(*rows)).collect()


def test_settings():
    assert api.Settings.of({}) == api.Settings()
    got = api.Settings.of({"APP_ENV": "production", "LOG_LEVEL": "warning", "RATE_LIMIT_PER_MINUTE": "5", "CORS_ORIGINS": "https://a, https://b", "LOCAL_LLM_ENABLED": "true"})
    assert (got.log_level, got.rate_limit_per_minute, got.cors_origins, got.local_llm_enabled) == ("WARNING", 5, ("https://a", "https://b"), True)
    for bad in ({"APP_ENV": "moon"}, {"LOG_LEVEL": "loud"}, {"RATE_LIMIT_PER_MINUTE": "0"}, {"LOCAL_LLM_TIMEOUT_SECONDS": "inf"}, {"LOCAL_LLM_ENABLED": "maybe"}, {"APP_ENV": "production", "CORS_ORIGINS": "*"}):
        with pytest.raises(ValueError):
            api.Settings.of(bad)


def test_errors_and_versions(spark):
    assert one(spark, api.error_of(F.lit("SCREENING_NOT_FOUND")))["status"] == 404
    assert one(spark, api.error_of(F.lit("SOMETHING")))["error"]["code"] == "INTERNAL_ERROR"
    assert one(spark, api.error_of(F.lit(None).cast("string"))) is None
    assert api.version(spark, {"stamp": "v0"}).first()["models"] == {"stamp": "v0"}
    assert [api.health(spark, r).first()["storage"] for r in (None, True, False)] == ["unknown", "ready", "not_ready"]
    for schema in api.RESPONSES.values():
        assert spark.createDataFrame([], schema).columns


def test_lists_and_cases(spark):
    rows = spark.createDataFrame([(i, NOW + datetime.timedelta(hours=i % 3), None if i != 4 else NOW, "low", "t", "s") for i in range(6)], "id long, created_at timestamp, deleted_at timestamp, band string, document_type string, status string")
    assert [r["id"] for r in api.by_created(rows, True).collect()] == [2, 5, 1, 4, 0, 3]
    assert [(r["position"], r["id"]) for r in api.documents_of(rows, [5, 4, 77, 0]).collect()] == [(0, 5), (1, None), (2, None), (3, 0)]
    page, total = api.screening_list(rows, offset=1, limit=2)
    assert [r["id"] for r in page.collect()] == [3, 1] and total.first()["total"] == 5


def test_request_ids(spark):
    rows = spark.createDataFrame([("a.b:1",), ("bad id",), ("x" * 65,), (None,)], "request_id string")
    got = [r["request_id"] for r in api.with_request_id(rows).collect()]
    assert got[0] == "a.b:1" and all(len(x) == 36 for x in got[1:])


def test_keys_and_files(spark, tmp_path):
    key = bytes(range(32))
    assert blobs.master_key(base64.b64encode(key).decode(), "production") == key
    assert len(blobs.master_key(None, "test")) == 32
    for bad in ((None, "production"), ("???", "test"), (base64.b64encode(b"short").decode(), "test")):
        with pytest.raises(ValueError):
            blobs.master_key(*bad)
    name = "ab" * 32
    for body in (b"one", b"two"):
        blobs.write_atomically(spark, f"file://{tmp_path}/{name}.blob", body)
    assert (tmp_path / f"{name}.blob").read_bytes() == b"two"
    (tmp_path / "note.blob").write_bytes(b"x")
    (tmp_path / f"{'cd' * 32}.blob").write_bytes(b"y")
    assert [(r["digest"], r["size"]) for r in blobs.blob_files(spark, f"file://{tmp_path}").collect()] == [(name, 3), ("cd" * 32, 1)]
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(f".{name}.blob.") and not p.name.endswith(".crc")]


def test_names_without_words(spark):
    from inkspark.functions import names

    for a, b in (("", ""), ("-", ".")):
        assert one(spark, names.names_match(F.lit(a), F.lit(b))) is None
    assert one(spark, names.names_match(F.lit(""), F.lit("JANE"))) is False


def test_signatures_by_tables(monkeypatch):
    """Signing and checking by tables gives what plain multiples give, and adds no points the plain way."""
    from inkspark.functions import ed25519 as ed

    key = bytes(range(32))
    for n in (0, 1, 255, 256, ed.ORDER - 1, 2**255 - 1):
        assert ed._packed(ed._summed(n, ed._multiples(ed.BASE))) == ed._packed(ed._times(n, ed.BASE))
    public, signature = ed.public_key(key), ed.sign(key, b"root")
    holds = ed.verifier(public)
    assert holds(b"root", signature)
    called = []
    monkeypatch.setattr(ed, "_add", lambda a, b: called.append(a))
    assert holds(b"root", ed.sign(key, b"root")) and not holds(b"other", signature) and not holds(b"root", signature[:32] + bytes(32)) and not called
    monkeypatch.undo()
    for bad in (signature[:-1], signature[:32] + (int.from_bytes(signature[32:], "little") + ed.ORDER).to_bytes(32, "little"), (ed.P + 1).to_bytes(32, "little") + bytes(32)):
        assert not holds(b"root", bad) and not ed.verify(public, b"root", bad)
    assert not ed.verifier(b"short")(b"root", signature) and not ed.verifier((2).to_bytes(32, "little"))(b"root", signature)
