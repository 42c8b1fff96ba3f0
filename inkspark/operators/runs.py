"""A screening as a run of events: what each tier found, the finished analysis, and the row it leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.functions.hashing import canonical, json_text
from inkspark.operators import audit, risk

RUN_TYPES = ["screening_created", "tier_completed", "analysis_completed"]


def run_events(events: DataFrame, key: str | None = None) -> DataFrame:
    """Events of runs (all, or one) in order."""
    own = events.filter(F.col("event_type").isin(RUN_TYPES))
    return (own if key is None else own.filter(F.col("screening_id") == key)).orderBy("screening_id", "created_at", "id")


def instants(events: DataFrame, key: str, event_type: str) -> DataFrame:
    """Moments of one type of event of each run, in order. A run has as many as it has tiers."""
    moments = F.array_sort(F.collect_list(F.when(F.col("event_type") == event_type, F.struct("created_at", "id"))))
    return events.groupBy(key).agg(moments.alias("m")).select(key, F.transform("m", lambda x: x["created_at"]).alias("instants"))


def _ids(flags: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(flags, json_text), ","), F.lit("]"))


def tier_payload(tier: Column, form: Column, flags: Column, hard_failed: Column) -> Column:
    """What an event says of a completed tier, as canonical JSON: the zone's format, the flags' ids, whether it failed hard."""
    return canonical({"tier": json_text(tier), "format": F.coalesce(json_text(form), F.lit("null")), "flags": _ids(flags), "hard_failed": F.when(hard_failed, "true").otherwise("false")})


def completed_payload(score_bp: Column, band: Column, flags: Column, tiers: Column, ruleset: str) -> Column:
    """What an event says of a finished analysis. The score is in hundredths, so that no fraction is hashed."""
    return canonical({"score_bp": score_bp.cast("string"), "band": json_text(band), "flags": _ids(flags), "tiers": _ids(tiers), "ruleset_version": json_text(F.lit(ruleset))})


def stored_result(screenings: DataFrame, scores: DataFrame, flags: DataFrame) -> DataFrame:
    """Screenings with status, score, band, versions and flags of their analysis; those without one stay as they are.

    scores: id, score, band, ruleset_version, model_versions; flags: key, and a
    row a flag, which become one JSON array in order of arrival.
    """
    items = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("position", F.struct("id", "label", "value").alias("f")))), lambda x: x["f"]))
    texts = flags.groupBy(F.col("key").alias("__key")).agg(items.alias("__flags"))
    new = scores.select(F.col("id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in ("score", "band", "ruleset_version", "model_versions")))
    rows = screenings.join(new, screenings["id"] == new["__id"], "left").join(texts, screenings["id"] == texts["__key"], "left")
    done = F.col("__id").isNotNull()
    pick = lambda name, value: F.when(done, value).otherwise(F.col(name)) if name in screenings.columns else F.when(done, value)
    values = {"status": pick("status", F.lit("completed")), "flags": pick("flags", F.coalesce("__flags", F.lit("[]")))} | {c: pick(c, F.col(f"__{c}")) for c in ("score", "band", "ruleset_version", "model_versions")}
    return rows.withColumns(values).drop("__id", "__key", "__flags", "__score", "__band", "__ruleset_version", "__model_versions")


def events_of(screenings: DataFrame, trace: DataFrame, flags: DataFrame, scores: DataFrame, ruleset: str) -> DataFrame:
    """The events of runs: screening_id, seq, event_type, payload. Created, then each tier it reached, then the analysis.

    trace: key, stage, position, hard_failed (see stages.cascade); flags: key,
    stage, id; scores: id, score_bp, band.
    """
    ids = flags.groupBy("key", "stage").agg(F.array_sort(F.collect_list("id")).alias("__ids"))
    none = F.array().cast("array<string>")
    tiers = trace.join(ids, ["key", "stage"], "left").select("key", "stage", "position", "hard_failed", F.coalesce("__ids", none).alias("__ids"))
    created = screenings.select(F.col("id").alias("screening_id"), F.lit(0).alias("seq"), F.lit(RUN_TYPES[0]).alias("event_type"), F.lit("{}").alias("payload"))
    completed = tiers.select(F.col("key").alias("screening_id"), (F.col("position") + 1).alias("seq"), F.lit(RUN_TYPES[1]).alias("event_type"), tier_payload(F.col("stage"), F.lit(None).cast("string"), F.col("__ids"), F.col("hard_failed")).alias("payload"))
    ran = tiers.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("position", "stage", "__ids"))).alias("t"))
    names, found = F.transform("t", lambda x: x["stage"]), F.flatten(F.transform("t", lambda x: x["__ids"]))
    finished = scores.join(ran, scores["id"] == ran["key"]).select(F.col("id").alias("screening_id"), (F.size("t") + 1).alias("seq"), F.lit(RUN_TYPES[2]).alias("event_type"), completed_payload(F.col("score_bp"), F.col("band"), found, names, ruleset).alias("payload"))
    return created.unionByName(completed).unionByName(finished)


def contributions_of(screenings: DataFrame, flags: DataFrame, weights: DataFrame, ruleset: str) -> DataFrame:
    """Contributions of stored screenings (id, ruleset_version), from their flags (key, position, id, value).

    A screening without a ruleset has none; one scored under another ruleset is
    an error, since its score can't be told from these weights.
    """
    scored = screenings.filter(F.col("ruleset_version").isNotNull()).select(F.col("id").alias("key"), F.when(F.col("ruleset_version") == ruleset, F.col("ruleset_version")).otherwise(F.raise_error(F.lit("scored under another ruleset")).cast("string")).alias("__version"))
    rows = flags.join(scored, "key").filter(F.col("__version").isNotNull())
    return risk.contributions(rows, weights, "key", "position")


def override_events(decisions: DataFrame) -> DataFrame:
    """An override event for each decision (screening_id, action, band, created_at) that contradicts the system, and none for others."""
    payload = canonical({"officer_action": json_text(F.col("action")), "system_band": json_text(F.col("band"))})
    return decisions.filter(audit.contradicts("action", "band")).select("screening_id", F.lit("override_recorded").alias("event_type"), payload.alias("payload"), "created_at")
