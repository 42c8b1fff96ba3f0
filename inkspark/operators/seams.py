"""Readers, classifiers and writers that a deployment plugs in, and what stands in for one that it hasn't.

A seam is a function from a table of pages to a table of answers with fixed
columns. What it is and whether it is a stand-in travel with each answer, so
nothing made up is taken for a measurement.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of each kind's answers, beside page, module, model_version and is_stub.
ANSWERS = {
    "words": "pos long, text string, conf double, quad array<struct<x:double,y:double>>",
    "barcodes": "text string, format string, quad array<struct<x:double,y:double>>",
    "faces": "pos long, confidence double, quad array<struct<x:double,y:double>>",
    "embedding": "vector array<float>",
    "classifier": "score double, suspect boolean, detail string",
    "summary": "text string",
}
DIMENSIONS = 512


@dataclass(frozen=True)
class Seam:
    """One module: its name, kind, version, whether it is a stand-in, and what it does with pages (page, image)."""

    name: str
    kind: str
    model_version: str
    is_stub: bool
    run: Callable[[DataFrame], DataFrame]

    def __post_init__(self) -> None:
        if self.kind not in ANSWERS:
            raise ValueError(f"no kind {self.kind}")
        if not self.name.strip() or not self.model_version.strip():
            raise ValueError("a module says what it is")

    def answers(self, pages: DataFrame) -> DataFrame:
        """Its answers with the columns of its kind. Missing columns are an error when it is planned."""
        wanted = [c.split(" ")[0] for c in ANSWERS[self.kind].split(", ")]
        return self.run(pages).select("page", F.lit(self.name).alias("module"), F.lit(self.model_version).alias("model_version"), F.lit(self.is_stub).alias("is_stub"), *wanted)


def _none(kind: str) -> Callable[[DataFrame], DataFrame]:
    """No answer for any page."""

    def run(pages: DataFrame) -> DataFrame:
        return pages.select("page").limit(0).join(pages.sparkSession.createDataFrame([], ANSWERS[kind]), how="cross")

    return run


def _each(*columns: tuple[str, object, str]) -> Callable[[DataFrame], DataFrame]:
    """The same answer for every page."""
    return lambda pages: pages.select("page", *(F.lit(value).cast(kind).alias(name) for name, value, kind in columns))


STAND_INS = {
    "words": Seam("no_reader", "words", "none", True, _none("words")),
    "barcodes": Seam("no_barcodes", "barcodes", "none", True, _none("barcodes")),
    "faces": Seam("no_faces", "faces", "none", True, _none("faces")),
    "embedding": Seam("zero_embedding", "embedding", "none", True, lambda pages: pages.select("page", F.array_repeat(F.lit(0.0).cast("float"), DIMENSIONS).alias("vector"))),
    "classifier": Seam("no_classifier", "classifier", "none", True, _each(("score", None, "double"), ("suspect", False, "boolean"), ("detail", "no classifier is configured", "string"))),
    "summary": Seam("no_writer", "summary", "none", True, _each(("text", None, "string"))),
}


def run_all(pages: DataFrame, seams: list[Seam]) -> DataFrame:
    """Answers of several modules of one kind, one after another. Two of a name, other kinds and none at all are errors, before anything runs."""
    if not seams:
        raise ValueError("no module")
    if len({s.name for s in seams}) < len(seams) or len({s.kind for s in seams}) > 1:
        raise ValueError("modules differ in name and agree in kind")
    return reduce(DataFrame.unionByName, (s.answers(pages) for s in seams))


def chosen(seams: list[Seam], kind: str) -> Seam:
    """The first module of a kind that isn't a stand-in, else the stand-in."""
    return next((s for s in seams if s.kind == kind and not s.is_stub), STAND_INS[kind])


def summaries(written: DataFrame, payloads: DataFrame, verify: Callable, fallback: Callable) -> DataFrame:
    """A model's text for each page where it is verified against the payload (page, payload), else the template's: page, text, source."""
    rows = payloads.join(written.select("page", "text"), "page", "left")
    sound = F.coalesce(verify(F.col("text"), F.col("payload")), F.lit(False))
    return rows.select("page", F.when(sound, F.col("text")).otherwise(fallback(F.col("payload"))).alias("text"), F.when(sound, "model").otherwise("template").alias("source"))
