"""Screening a batch of documents: zones in, flags, scores and summaries out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.functions import dates, mrz, text
from inkspark.operators import crossdoc, evidence, reasons, risk
from inkspark.operators.weights import RULESET_VERSION, weightset


@dataclass(frozen=True)
class Screened:
    """flags: one row a finding; scores: one row a document, those without findings included."""

    flags: DataFrame
    scores: DataFrame


def screen(zones: DataFrame, watchlist: DataFrame, reference: str, history: DataFrame | None = None) -> Screened:
    """zones: id, lines. watchlist: as sources.seeds.watchlist gives it. history: id, signal."""
    at = F.lit(reference).cast("date")
    parsed = mrz.parse(zones).withColumns({"birth": dates.birth_date(F.col("date_of_birth"), at), "expiry": dates.expiry_date(F.col("date_of_expiry"), at)})
    probes = parsed.select(F.col("id").alias("probe_id"), F.rtrim(F.regexp_replace("document_number", "<+$", "")).alias("document_number"), "name", F.col("birth").alias("date_of_birth"))
    entries = watchlist.select("entry_id", "kind", F.xxhash64("entry_id").alias("position"), F.col("document_number").alias("entry_number"), "name", "name_tidied", "dob")
    hits = crossdoc.watchlist_hits(probes, entries)
    flags = evidence.all_flags(evidence.from_check_digits(zones, "id"), evidence.from_watchlist(hits, "probe_id"))
    flags = reasons.with_reason(flags)
    scored = risk.score(flags.withColumnRenamed("key", "__key").withColumn("doc", F.col("__key")), weightset(zones.sparkSession), "doc", None if history is None else history.withColumnRenamed("id", "doc"))
    labels = flags.groupBy(F.col("key").alias("doc")).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    rows = zones.select("id").join(scored, F.col("id") == F.col("doc"), "left").drop("doc").join(labels, F.col("id") == F.col("doc"), "left").drop("doc")
    total = F.coalesce("total", F.lit(0.0))
    rows = rows.select(
        "id", total.alias("score"), risk.band(total).alias("band"), risk.basis_points(total).alias("score_bp"), F.coalesce("hard_failed", F.lit(False)).alias("hard_failed"),
        F.lit(RULESET_VERSION).alias("ruleset_version"), text.template_summary(risk.band(total), total, F.coalesce("labels", F.array().cast("array<string>"))).alias("summary"),
    )
    return Screened(flags, rows)
