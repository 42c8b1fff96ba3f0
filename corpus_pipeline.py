"""The documents table as a training corpus: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.llm.common import scope, table, written
from inkspark.llm.decontaminate import contaminated
from inkspark.llm.line_dedup import line_dedup
from inkspark.llm.mixing import mix
from inkspark.llm.near_copies import drop_copies
from inkspark.llm.quality import quality

#: Fingerprints of each document by which near copies are found. One finds few of those that differ in some words.
VIEWS = 10


def row_key(*columns: str) -> Column:
    """What tells rows apart, never null: equal rows, and they alone, share it (64 bits)."""
    return F.xxhash64("doc_id", *columns)


def only(frame: DataFrame, keys: DataFrame, key: Column, how: str) -> DataFrame:
    """The rows whose key is ("left_semi") or isn't ("left_anti") among ``keys`` (one column). All columns stay, whatever their names are."""
    whole = frame.select(F.struct(*frame.columns).alias("row"), key.alias("key"))
    return whole.join(keys.toDF("key"), "key", how).select("row.*")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep: each by its own verdict, with any doc_id or none."""
    # Written first: a filter over the verdict would else pull its histograms' expressions into one and compute them again and again.
    key = row_key("text", "lang")
    kept = written(quality(docs.select(key.alias("doc_id"), "text", "lang")).select("doc_id", "kept"), "verdicts").filter("kept").select("doc_id")
    return only(docs, kept, key, "left_semi")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without passages that another one has already."""
    changed = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    rest = F.struct(*(c for c in docs.columns if c not in changed))
    lean = line_dedup(docs.select("doc_id", "text", rest.alias("row")))
    return lean.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles alike to 0.8): the one of the smallest doc_id, null last. Of equal rows one stays."""
    return drop_copies(docs, VIEWS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item stands, with any doc_id or none."""
    key = row_key("text")
    found = contaminated(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return only(docs, found, key, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix(docs)


STAGES = [("quality rules", keep_good), ("line dedup", drop_repeated_lines), ("near dedup", drop_near_copies), ("decontamination", drop_contaminated), ("mixing", mix_sources)]

#: Fuzzy matching against the benchmark and SimHash have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again as the next one's input.

    Once it is written, what it was made from is deleted.
    """
    docs = table(spark, sf_dir, "documents")
    with scope() as tables:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}")
            tables.discard(docs)
        return STAGES[-1][1](spark, docs, sf_dir)
