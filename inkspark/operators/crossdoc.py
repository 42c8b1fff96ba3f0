"""Checks across the documents of a case, and lookups on a watchlist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspark.functions.geometry import cosine
from inkspark.functions.names import number_key


def watchlist_hits(probes: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries that match a probe by document number, or by name (or tidied name) with date of birth.

    Two equi-joins instead of one with OR, which no hash or sort join can run;
    a hit by both ways is one hit. Null keys match nothing.
    """
    number = probes.join(entries, probes["document_number"] == entries["entry_number"]).select(probes["probe_id"], entries["entry_id"], entries["kind"], entries["position"])
    names = entries.select("entry_id", "kind", "position", "dob", F.explode(F.array_compact(F.array_distinct(F.array("name", "name_tidied")))).alias("any_name"))
    identity = probes.join(names, (probes["name"] == names["any_name"]) & (probes["date_of_birth"] == names["dob"])).select(probes["probe_id"], names["entry_id"], names["kind"], names["position"])
    return number.union(identity).distinct()


def unknown_references(visas: DataFrame, passports: DataFrame) -> DataFrame:
    """Visas (case_id, referenced) whose passport isn't in the case; no reference, no finding."""
    asked = visas.withColumn("__key", number_key(F.col("referenced"))).filter("__key <> ''")
    held = passports.select(F.col("case_id").alias("__case"), number_key(F.col("document_number")).alias("__number")).distinct()
    return asked.join(held, (asked["case_id"] == held["__case"]) & (asked["__key"] == held["__number"]), "left_anti").drop("__key")


def outside_window(visas: DataFrame, travel: Column) -> DataFrame:
    """Visas with a whole window that doesn't hold the travel date."""
    return visas.filter(F.col("valid_from").isNotNull() & F.col("valid_until").isNotNull() & ~travel.between(F.col("valid_from"), F.col("valid_until")))


def case_status(rows: DataFrame) -> DataFrame:
    """inconsistent if a comparison failed, consistent if any was made, else not_configured. rows: case_id, compared, failed."""
    status = F.when(F.count_if("failed") > 0, "inconsistent").when(F.count_if("compared") > 0, "consistent").otherwise("not_configured")
    return rows.groupBy("case_id").agg(F.count_if("compared").alias("compared"), F.count_if("failed").alias("flags"), status.alias("status"))


def face_checks(faces: DataFrame, threshold: float) -> DataFrame:
    """Each face of a case against its first measurable one (case_id, pos, vector).

    The first face is found by an aggregate, which combines before the shuffle,
    and joined back; no case is gathered into one task.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold from 0, excluded, to 1")
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    seen = faces.filter(F.col("vector").isNotNull() & (length > 0))
    first = seen.groupBy(F.col("case_id").alias("__case")).agg(F.min("pos").alias("__first"))
    first = first.join(seen.select(F.col("case_id").alias("__c"), F.col("pos").alias("__p"), F.col("vector").alias("__reference")), (F.col("__case") == F.col("__c")) & (F.col("__first") == F.col("__p"))).drop("__c", "__p")
    pairs = seen.join(first, seen["case_id"] == first["__case"]).filter("pos > __first")
    alike = pairs.withColumn("score", cosine(F.col("vector"), F.col("__reference")))
    return alike.select("case_id", "pos", "score", (F.col("score") >= threshold).alias("matched"))


def best_face(faces: DataFrame, key: str) -> DataFrame:
    """The face of highest confidence of each document, the first on a tie."""
    return faces.groupBy(key).agg(F.max_by(F.struct(*faces.columns), F.struct("confidence", -F.col("pos"))).alias("face")).select(key, *(F.col(f"face.{c}").alias(c) for c in faces.columns if c != key))


def compared_fields(printed: DataFrame, zone: DataFrame) -> DataFrame:
    """Printed fields against the zone's by document and name: agreeing, or both values. Null on either side isn't compared."""
    pairs = printed.alias("p").join(zone.alias("z"), (F.col("p.document") == F.col("z.document")) & (F.col("p.field") == F.col("z.field")))
    both = F.col("p.value").isNotNull() & F.col("z.value").isNotNull()
    same = F.when(F.col("p.field").isin("date_of_birth", "date_of_expiry"), F.date_format(F.try_to_date("p.value", "yyyy-MM-dd"), "yyMMdd") == F.col("z.value")).otherwise(number_key(F.col("p.value")) == number_key(F.col("z.value")))
    return pairs.filter(both).select("p.document", "p.field", F.coalesce(same, F.lit(False)).alias("agrees"))
