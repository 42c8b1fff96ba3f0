"""What several operators share: words, whole-table reads, shared intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.stored import Scope, scope, shared_folder, written

__all__ = ["BREAKS", "BREAK_RE", "Scope", "scope", "shared_folder", "table", "text_of", "words_of", "written"]

#: Characters between words: space and the controls from tab to carriage return.
BREAKS = " \t\n\x0b\x0c\r"
BREAK_RE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table. Only Spark's readers open it, so any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text column, null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """The maximal runs of characters that are not breaks, in order.

    Breaks are taken off both ends first, so that splitting gives no empty word.
    """
    trimmed = F.btrim(text, F.lit(BREAKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BREAK_RE))
