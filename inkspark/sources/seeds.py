"""Lookup tables and templates from JSON, text and mappings, checked on reading."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "entry_id string, kind string, matched_on string, document_number string, name string, name_tidied string, dob date"
# The seed watchlist.
SEED = [
    {"entry_id": "STOLEN-0001", "kind": "stolen_document", "matched_on": "document_number", "document_number": "X00000001"},
    {"entry_id": "STOLEN-0002", "kind": "stolen_document", "matched_on": "document_number", "document_number": "X00000002"},
    {"entry_id": "BLACKLIST-0001", "kind": "blacklist", "matched_on": "document_number", "document_number": "X00000009"},
    {"entry_id": "IDENTITY-0001", "kind": "identity_seen", "matched_on": "identity", "name": "FICTITIOUS<<JANE", "name_tidied": "FICTITIOUS, JANE", "dob": "1990-01-01"},
]
TEMPLATE = "struct<reference_width:int,reference_height:int,fields:array<struct<field:string,x:int,y:int,width:int,height:int>>>"


def entries(documents: DataFrame, column: str = "value") -> DataFrame:
    """Rows of {"entries": [...]} documents in a text column, in their order."""
    parsed = documents.select(F.from_json(column, f"struct<entries:array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>>").alias("j"))
    return parsed.select(F.posexplode("j.entries").alias("position", "e")).select("position", "e.*")


def watchlist(spark: SparkSession, path: str | None = None) -> DataFrame:
    """A watchlist from a JSON file, or the seed."""
    texts = spark.read.text(path, wholetext=True) if path else spark.createDataFrame([(json.dumps({"entries": SEED}),)], "value string")
    return entries(texts).drop("position")


def layout_template(texts: DataFrame, column: str = "value") -> DataFrame:
    """Field boxes of layout templates; ``fault`` says what is wrong with a box, or is null."""
    rows = texts.select(F.from_json(column, TEMPLATE).alias("t")).select("t.reference_width", "t.reference_height", F.explode("t.fields").alias("f")).select("reference_width", "reference_height", "f.*")
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + F.col("width") <= F.col("reference_width")) & (F.col("y") + F.col("height") <= F.col("reference_height"))
    return rows.withColumn("fault", F.when((F.col("width") <= 0) | (F.col("height") <= 0), "empty").when(~inside, "outside"))


def feature_rows(texts: DataFrame, columns: list[str], column: str = "value") -> DataFrame:
    """Rows of a JSON matrix as named columns; a row of another length or a value that isn't finite is an error."""
    rows = texts.select(F.explode(F.from_json(column, "array<array<double>>")).alias("r"))
    sound = (F.size("r") == len(columns)) & F.forall("r", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.withColumn("r", F.when(sound, F.col("r")).otherwise(F.raise_error(F.lit("a feature row isn't sound")).cast("array<double>")))
    return rows.select(*(F.get("r", i).alias(c) for i, c in enumerate(columns)))


def prompts(texts: DataFrame, column: str = "value") -> DataFrame:
    """Version and body of versioned texts: lines that start with # are a header."""
    lines = F.split(column, "\n")
    header = F.filter(lines, lambda x: x.startswith("#"))
    body = F.btrim(F.array_join(F.filter(lines, lambda x: ~x.startswith("#")), "\n"), F.lit(" \n\r\t"))
    version = F.nullif(F.regexp_extract(F.array_join(header, "\n"), r"prompt_version:\s*([^\s]+)", 1), F.lit(""))
    return texts.select(version.alias("prompt_version"), body.alias("body"))
