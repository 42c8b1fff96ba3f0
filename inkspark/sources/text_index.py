"""Substring search over stored rows that reads only files in which the text can stand.

Rows are written once, in an order that keeps like rows together, as files of a
bounded number of rows. Beside them stands one filter for each file: a Bloom
filter of the trigrams of its rows' text in lower case, kept as a table of words of
64 bits that aren't zero, by file. A search asks that table which files have all of
the term's bits, reads those, and checks each row's whole text. A Bloom filter has
no false negatives, so the rows are those of a scan. A term of under three
characters has no trigram and reads all files.

Building explodes trigrams once and combines bits in each task, so what is shuffled
is bounded by the filters' size. Nothing of the rows comes to the driver but the
names of the files to read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.operators.screenings import row_text

#: Bits of a file's filter, as a power of two, and bits that a trigram sets.
BITS, HASHES = 20, 4
ROWS_PER_FILE = 100_000


def trigrams(text: Column) -> Column:
    """The different runs of three characters, none of a shorter text."""
    n = F.char_length(text) - 2
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def _places(text: Column) -> Column:
    """Bits of a filter that a text's trigrams set."""
    hashes = F.flatten(F.transform(trigrams(text), lambda t: F.array(*(F.pmod(F.xxhash64(F.lit(k), t), F.lit(1 << BITS)) for k in range(HASHES)))))
    return F.array_distinct(hashes)


class TextIndex:
    """Stored rows with their filters under one folder."""

    def __init__(self, spark: SparkSession, folder: str, columns: list[str]):
        self.spark, self.folder, self.columns = spark, folder.rstrip("/"), columns

    def build(self, rows: DataFrame, order: list[str], rows_per_file: int = ROWS_PER_FILE) -> TextIndex:
        """Writes rows and filters. The order decides which rows share a file: terms that go with it are in few."""
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", rows_per_file).parquet(f"{self.folder}/rows")
        stored = self.spark.read.parquet(f"{self.folder}/rows")
        bits = stored.select(F.col("_metadata.file_path").alias("file"), F.explode(_places(row_text(self.columns))).alias("place"))
        word, bit = F.shiftright("place", 6), F.expr("shiftleft(1L, cast(place & 63 as int))")
        bits.groupBy("file", word.alias("word")).agg(F.bit_or(bit).alias("bits")).repartition("word").sortWithinPartitions("word").write.parquet(f"{self.folder}/filters")
        return self

    def files(self, term: str) -> list[str] | None:
        """Files in which the term can stand; None: all."""
        wanted = self.spark.range(1).select(F.explode(_places(F.lower(F.lit(term)))).alias("place"))
        asked = wanted.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("asked")).collect()
        if not asked:
            return None
        need = F.create_map(*(F.lit(x) for r in asked for x in (r["word"], r["asked"])))[F.col("word")]
        filters = self.spark.read.parquet(f"{self.folder}/filters").filter(F.col("word").isin([r["word"] for r in asked]))
        held = filters.filter(F.col("bits").bitwiseAND(need) == need).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
        return sorted(r["file"] for r in held.filter(F.col("n") == len(asked)).select("file").collect())

    def search(self, term: str) -> DataFrame:
        """Rows whose text holds the term in any case: those of a scan."""
        files, schema = self.files(term), self.spark.read.parquet(f"{self.folder}/rows").schema
        if files == []:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*(files or [f"{self.folder}/rows"]))
        return rows.filter(F.contains(row_text(self.columns), F.lower(F.lit(term))))
