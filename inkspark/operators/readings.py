"""What readers of a page answer (words, barcodes) as tables, and printed fields against the zone and the barcode.

Readers themselves are seams: any function from pages to these tables. A page
that no reader has read is a page of no words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.functions.names import token_distance

# Least confidence, names of the gate's steps, order of engines.
CONFIDENCE_LEAST = 0.80
RE_READ, FALLBACK = "re_read", "fallback"
ENGINES = ("tesseract", "easyocr")
# Printed fields with their kind, the zone's fields they must agree with, and those of a barcode.
ZONE_FIELDS = [
    ("name", "name", ["surname", "given_names"]), ("passport_number", "number", ["document_number"]), ("visa_number", "number", ["document_number"]),
    ("national_id_number", "number", ["document_number"]), ("date_of_birth", "date", ["date_of_birth"]), ("date_of_expiry", "date", ["date_of_expiry"]),
]
BARCODE_SPANS = {"document_number": (1, 9), "date_of_birth": (14, 6), "date_of_expiry": (22, 6)}

Reader = Callable[[DataFrame], DataFrame]


def chosen_engine(available: list[str], preference: str | None = None) -> str | None:
    """The first engine there is; a named one never gives way to another."""
    if preference is not None:
        return preference if preference in available else None
    return next((e for e in ENGINES if e in available), None)


def words(rows: DataFrame) -> DataFrame:
    """Words of a reader's rows (page, pos, text, conf from 0 to 100 or -1 for none): blank ones and those without a confidence left out, confidence from 0 to 1."""
    read = rows.filter((F.trim("text") != "") & (F.col("conf") >= 0))
    return read.withColumn("confidence", F.least(F.col("conf") / 100, F.lit(1.0))).drop("conf")


def mean_confidences(words: DataFrame, order: Column) -> DataFrame:
    """Mean confidence of each page's words (page, confidence), added up in the given order, so that a page at a limit doesn't depend on how rows are dealt to tasks.

    A page's words are gathered for that, as a page's words are few; those without a confidence are left out.
    """
    known = words.filter(F.col("confidence").isNotNull()).select("page", F.struct(order.alias("at"), F.col("confidence").cast("double").alias("c")).alias("w"))
    pages = known.groupBy("page").agg(F.array_sort(F.collect_list("w")).alias("w"))
    return pages.select("page", (F.aggregate("w", F.lit(0.0), lambda s, w: s + w["c"]) / F.size("w")).alias("confidence"))


def boxes(rows: DataFrame, quad: str = "quad") -> DataFrame:
    """left, top, right, bottom of quads (array of points x, y), and confidence within 0 and 1."""
    xs, ys = F.transform(quad, lambda p: p["x"]), F.transform(quad, lambda p: p["y"])
    whole = lambda c: F.floor(c).cast("int")
    return rows.withColumns({
        "left": whole(F.array_min(xs)), "top": whole(F.array_min(ys)), "right": F.ceil(F.array_max(xs)).cast("int"), "bottom": F.ceil(F.array_max(ys)).cast("int"),
        "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))),
    }).drop(quad)


def unread_flags(pages: DataFrame, confidences: DataFrame, least: float = CONFIDENCE_LEAST) -> DataFrame:
    """A flag for each page that no reader read surely enough, with the confidence it has (0 without words)."""
    rows = pages.select("page").join(confidences.select("page", "confidence"), "page", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    return rows.filter(F.col("confidence") < least).select(F.col("page").alias("key"), F.lit("OCR_LOW_CONFIDENCE").alias("id"), (1 - F.col("confidence")).alias("value"))


def gated(reads: DataFrame, least: float = CONFIDENCE_LEAST) -> DataFrame:
    """The read that is kept of each field, whether it is unsure, and the steps taken.

    reads: field, first, again, fallback (structs of text and confidence). The
    second read is asked for only if the first is unsure, and the fallback, if
    there is one, only if both are; the last one asked is kept.
    """
    sure = lambda c: F.coalesce(F.col(f"{c}.confidence") >= least, F.lit(False))
    has_fallback = F.col("fallback").isNotNull()
    kept = F.when(sure("first"), F.col("first")).when(sure("again") | ~has_fallback, F.col("again")).otherwise(F.col("fallback"))
    steps = F.when(sure("first"), F.lit("")).when(sure("again") | ~has_fallback, F.lit(RE_READ)).otherwise(F.lit(f"{RE_READ},{FALLBACK}"))
    return reads.select(*(c for c in reads.columns if c not in ("first", "again", "fallback")), kept["text"].alias("text"), kept["confidence"].alias("confidence"), (~F.coalesce(kept["confidence"] >= least, F.lit(False))).alias("low_confidence"), steps.alias("steps"))


def zone_words(text: Column) -> Column:
    """Words of a zone's or page's name: capitals, filler as space."""
    return F.filter(F.split(F.trim(F.translate(F.upper(text), "<", " ")), r"\s+"), lambda w: w != "")


def same_day(printed: Column, zone: Column) -> Column:
    """Whether an ISO date and six digits YYMMDD name one day; no century is made up."""
    whole = printed.rlike(r"^\d{4}-\d{2}-\d{2}$") & zone.rlike(r"^\d{6}$")
    return F.coalesce(whole & (F.concat(F.substring(printed, 3, 2), F.substring(printed, 6, 2), F.substring(printed, 9, 2)) == zone), F.lit(False))


def _compared(printed: DataFrame, other: DataFrame, fields: list[tuple[str, str, list[str]]], tolerance: int) -> DataFrame:
    """document, field, kind and whether they agree; null on either side isn't compared. other: document, and a column a field."""
    parts = []
    for name, kind, sources in fields:
        text = F.concat_ws(" ", *(F.col(s) for s in sources))
        there = F.col(sources[0]).isNotNull()
        for s in sources[1:]:
            there = there | F.col(s).isNotNull()
        parts.append(F.struct(F.lit(name).alias("field"), F.lit(kind).alias("kind"), F.when(there, text).alias("other")))
    rows = other.select("document", F.explode(F.array(*parts)).alias("o")).select("document", "o.*").filter("other is not null")
    both = printed.filter(F.col("value").isNotNull()).join(rows, ["document", "field"])
    total, agreed = F.size(zone_words(F.col("other"))), F.size(zone_words(F.col("other"))) - token_distance(zone_words(F.col("value")), zone_words(F.col("other")))
    agrees = F.when(F.col("kind") == "name", agreed >= total - tolerance).when(F.col("kind") == "date", same_day(F.col("value"), F.col("other"))).otherwise(F.col("value") == F.col("other"))
    return both.withColumns({"total": total, "agreed": F.when(F.col("kind") == "name", agreed), "agrees": agrees})


def against_zone(printed: DataFrame, zones: DataFrame, tolerance: int = 0) -> DataFrame:
    """A flag for each printed field (document, field, value) that disagrees with the zone (document, surname, given_names, document_number, dates).

    Names may differ by so many words; numbers and days may not. What a flag
    says of names counts words and prints none.
    """
    if tolerance < 0:
        raise ValueError("a tolerance is a number of words")
    rows = _compared(printed, zones, ZONE_FIELDS, tolerance).filter(~F.col("agrees"))
    name = F.col("kind") == "name"
    reason = F.when(name, F.concat(F.col("agreed").cast("string"), F.lit(" of the "), F.col("total").cast("string"), F.lit(f" words the zone's name carries are on the printed page, and the tolerance is {tolerance}"))).when(
        F.col("kind") == "date", "the printed date and the machine-readable date are not the same day").otherwise("the printed number and the machine-readable number are not the same number")
    return rows.select(
        F.col("document").alias("key"), F.lit("OCR_MRZ_MISMATCH").alias("id"), "field", F.concat(F.lit("the printed "), F.replace("field", F.lit("_"), F.lit(" ")), F.lit(" disagrees with the machine-readable zone")).alias("label"),
        F.when(name, F.concat(F.col("total").cast("string"), F.lit(" name words"))).otherwise(F.col("other")).alias("expected"), F.when(name, F.concat(F.col("agreed").cast("string"), F.lit(" agree"))).otherwise(F.col("value")).alias("found"), reason.alias("reason"),
    )


def barcode_line(text: Column) -> Column:
    """The second line of a zone that a barcode carries: 44 characters of its alphabet, else null."""
    lines = F.filter(F.split(F.upper(F.trim(text)), r"\s+"), lambda x: x.rlike("^[A-Z0-9<]{44}$"))
    return F.get(lines, F.size(lines) - 1)


def against_barcode(printed: DataFrame, barcodes: DataFrame) -> DataFrame:
    """A flag for each printed number or date that disagrees with a barcode (document, text). Names aren't compared: the line has none."""
    line = barcodes.select("document", barcode_line(F.col("text")).alias("line")).filter("line is not null")
    fields = line.select("document", *(F.regexp_replace(F.substring("line", a, n), "<+$", "").alias(name) for name, (a, n) in BARCODE_SPANS.items()))
    rows = _compared(printed, fields, [f for f in ZONE_FIELDS if f[1] != "name"], 0).filter(~F.col("agrees"))
    reason = F.when(F.col("kind") == "date", "the printed date and the date in the barcode are not the same day").otherwise("the printed number and the number in the barcode are not the same number")
    return rows.select(F.col("document").alias("key"), F.lit("OCR_BARCODE_MISMATCH").alias("id"), "field", F.concat(F.lit("the printed "), F.replace("field", F.lit("_"), F.lit(" ")), F.lit(" disagrees with the barcode")).alias("label"), F.col("other").alias("expected"), F.col("value").alias("found"), reason.alias("reason"))
