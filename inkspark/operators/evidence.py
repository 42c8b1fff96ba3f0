"""Findings to evidence flags: from check digits, watchlist hits, dates, cases and modules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.functions import dates, mrz

# Checked field, flag, label.
CHECK_DIGIT_FLAGS = [
    ("document_number", "MRZ_DOCUMENT_NUMBER_CHECK_DIGIT_MISMATCH", "The document number's check digit does not match."),
    ("date_of_birth", "MRZ_DOB_CHECK_DIGIT_MISMATCH", "The date of birth's check digit does not match."),
    ("date_of_expiry", "MRZ_EXPIRY_CHECK_DIGIT_MISMATCH", "The date of expiry's check digit does not match."),
    ("optional_data_1", "MRZ_OPTIONAL_DATA_CHECK_DIGIT_MISMATCH", "The optional data's check digit does not match."),
    ("optional_data", "MRZ_OPTIONAL_DATA_CHECK_DIGIT_MISMATCH", "The optional data's check digit does not match."),
    ("personal_number", "MRZ_OPTIONAL_DATA_CHECK_DIGIT_MISMATCH", "The personal number's check digit does not match."),
    ("composite", "MRZ_COMPOSITE_CHECK_DIGIT_MISMATCH", "The composite check digit does not match."),
]
# Kind of entry, flag, label, field, hard failure.
WATCHLIST_FLAGS = [
    ("blacklist", "WATCHLIST_HIT", "The document number is on the blacklist.", "document_number", True),
    ("stolen_document", "WATCHLIST_STOLEN_DOCUMENT", "The document number is recorded as a stolen document.", "document_number", False),
    ("identity_seen", "WATCHLIST_IDENTITY_SEEN", "This name and date of birth have been screened before.", None, False),
]
# Module of the deep tier, flag.
MODULE_FLAGS = [
    ("ela", "TAMPER_ELA_ANOMALY"),
    ("noise_residual", "TAMPER_NOISE_RESIDUAL_ANOMALY"),
    ("copy_move", "TAMPER_COPY_MOVE_ANOMALY"),
    ("stamp", "TAMPER_STAMP_ANOMALY"),
    ("morph", "TAMPER_MORPH_SUSPECTED"),
    ("deepfake", "TAMPER_DEEPFAKE_SUSPECTED"),
]
COLUMNS = ["key", "tier", "id", "label", "field", "value", "hard", "expected", "found"]


def _looked_up(rows: DataFrame, table: list[tuple], schema: str, on: str) -> DataFrame:
    """Rows joined to a closed table of a few rows; a value that isn't in it is an error."""
    names = rows.sparkSession.createDataFrame(table, schema)
    joined = rows.join(F.broadcast(names), rows[on] == names["__on"], "left")
    return joined.withColumn("id", F.coalesce("id", F.raise_error(F.concat(F.lit(f"unknown {on} "), F.coalesce(F.col(on), F.lit("null")))).cast("string"))).drop("__on")


def from_check_digits(zones: DataFrame, key: str, lines: str = "lines") -> DataFrame:
    """A flag for each check digit that is wrong; one that can't be read is none."""
    parsed = mrz.parse(zones, lines)
    failed = parsed.select(F.col(key).alias("key"), F.explode(mrz.verdicts(parsed, lines)).alias("v")).filter(~F.col("v.passed")).select("key", "v.field", "v.expected", "v.found")
    rows = _looked_up(failed, CHECK_DIGIT_FLAGS, "__on string, id string, label string", "field")
    return rows.select("key", F.lit("tier0").alias("tier"), "id", "label", "field", F.lit(1.0).alias("value"), F.lit(True).alias("hard"), F.col("expected").cast("string").alias("expected"), F.col("found").cast("string").alias("found"))


def from_watchlist(hits: DataFrame, key: str) -> DataFrame:
    """A flag for each hit (key, kind); its weight follows from its kind, not from the order of hits."""
    rows = _looked_up(hits.select(F.col(key).alias("key"), "kind"), WATCHLIST_FLAGS, "__on string, id string, label string, field string, hard boolean", "kind")
    return rows.select("key", F.lit("tier0").alias("tier"), "id", "label", "field", F.lit(1.0).alias("value"), "hard", F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("found"))


def from_dates(rows: DataFrame, key: str, reference: Column) -> DataFrame:
    """Flags of printed dates (birth, issue, expiry)."""
    checks = [
        ("DATE_EXPIRED", "expiry", dates.expiry_status(F.col("expiry"), reference) == "expired"), ("DATE_NOT_YET_VALID", "issue", dates.issue_status(F.col("issue"), reference) == "not_yet_valid"),
        ("DATE_IMPLAUSIBLE_DOB", "birth", dates.birth_status(F.col("birth"), reference) == "implausible"), ("DATE_ISSUE_AFTER_EXPIRY", "issue", dates.order_status(F.col("issue"), F.col("expiry")) == "issue_after_expiry"),
    ]
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(i).alias("id"), F.lit(f).alias("field"), F.col(f).cast("string").alias("found"))) for i, f, c in checks)))
    out = rows.select(F.col(key).alias("key"), F.explode(found).alias("f"))
    return out.select("key", F.lit("tier0").alias("tier"), "f.id", F.col("f.id").alias("label"), "f.field", F.lit(1.0).alias("value"), F.lit(False).alias("hard"), F.lit(None).cast("string").alias("expected"), "f.found")


def from_modules(results: DataFrame, key: str) -> DataFrame:
    """A flag for each suspicious result (key, module, score, suspect) of the deep tier."""
    rows = _looked_up(results.filter("suspect").select(F.col(key).alias("key"), "module", "score"), MODULE_FLAGS, "__on string, id string", "module")
    return rows.select("key", F.lit("tier2").alias("tier"), "id", F.col("module").alias("label"), F.lit(None).cast("string").alias("field"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("value"), F.lit(False).alias("hard"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("found"))


def all_flags(*parts: DataFrame) -> DataFrame:
    """Flags of all families, one after another; equal ones aren't merged."""
    return reduce(DataFrame.unionByName, (p.select(*COLUMNS) for p in parts))


def survivors(rows: DataFrame, key: str, flags: DataFrame) -> DataFrame:
    """Rows without a hard failure: what the next, dearer tier receives."""
    failed = flags.filter("hard").select(F.col("key").alias("__failed")).distinct()
    return rows.join(failed, rows[key] == failed["__failed"], "left_anti")


def payload(flags: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Flags and band of each key as JSON."""
    items = F.sort_array(F.collect_list(F.struct("id", "label", "field", "value", "expected", "found")))
    rows = flags.groupBy(F.col("key").alias(key)).agg(items.alias("flags"))
    return scores.select(key, "band").join(rows, key, "left").select(key, F.to_json(F.struct("band", F.coalesce("flags", F.array().cast("array<struct<id:string,label:string,field:string,value:double,expected:string,found:string>>")).alias("flags"))).alias("payload"))


def model_rows(rows: DataFrame, key: str, versions: str = "model_versions") -> DataFrame:
    """Entries of a map of model versions as rows, by name."""
    return rows.select(key, F.posexplode(F.array_sort(F.map_entries(versions))).alias("position", "e")).select(key, "position", F.col("e.key").alias("model"), F.col("e.value").alias("version"))


def merged(payload_map: Column, versions: Column) -> Column:
    """Two maps as one; a key in both is an error."""
    both = F.array_intersect(F.map_keys(payload_map), F.map_keys(versions))
    return F.when(F.size(both) == 0, F.map_concat(payload_map, versions)).otherwise(F.raise_error(F.concat(F.lit("in both: "), F.array_join(both, ","))).cast("map<string,string>"))


BANDS = ["low", "review", "high", "hard_fail"]


def faults(flags: DataFrame) -> DataFrame:
    """Flags with what is wrong with their shape, in a fixed order, or an empty array.

    flags: id, tier, label, weight_band, value, confidence, region (points x,
    y), expected, found, reason, source_module, field.
    """
    unit = lambda c: F.coalesce(F.col(c).between(0, 1) & ~F.isnan(c), F.lit(False))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    few = F.col("region").isNotNull() & (F.size("region") < 3)
    negative = F.coalesce(F.exists("region", lambda p: (p["x"] < 0) | (p["y"] < 0)), F.lit(False))
    checks = [
        ("id", blank("id")), ("tier", ~F.coalesce(F.col("tier").between(0, 3), F.lit(False))), ("label", blank("label")), ("weight_band", ~F.coalesce(F.col("weight_band").isin(BANDS), F.lit(False))), ("value", ~unit("value")),
        ("confidence", ~unit("confidence")), ("region", few | negative), ("reason", blank("reason")), ("source_module", blank("source_module")),
    ]
    return flags.withColumn("faults", F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks))))


def hit_faults(hits: DataFrame) -> DataFrame:
    """Watchlist hits (entry_id, kind, matched_on) with what is wrong: an id of other characters, an unknown kind, or a key that the kind isn't looked up by."""
    by = {"blacklist": "document_number", "stolen_document": "document_number", "identity_seen": "identity"}
    wanted = F.create_map(*(F.lit(x) for kv in by.items() for x in kv))[F.col("kind")]
    fault = F.when(~F.coalesce(F.col("entry_id").rlike("^[A-Za-z0-9_-]+$"), F.lit(False)), "entry_id").when(wanted.isNull(), "kind").when(~F.col("matched_on").eqNullSafe(wanted), "matched_on")
    return hits.withColumn("fault", fault)
