"""Fields of a printed page from its words: an anchor, then the first value to its right on the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspark.functions.dates import printed_date
from inkspark.functions.mrz import transliterate

_DATE = r"(?i)[0-9]{1,2} (?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC) [0-9]{4}"
_NUMBER = r"(?i)[A-Z0-9]{6,12}"
_NAME = r"\p{L}[\p{L} '.,-]*"
# Document type, field, anchors, shape of the value, kind of the value.
RULES = [
    ("passport", "name", ["Name", "Full Name"], _NAME, "name"),
    ("passport", "passport_number", ["Passport No", "Passport Number"], _NUMBER, "number"),
    ("passport", "date_of_birth", ["Date of birth", "Birth date"], _DATE, "date"),
    ("passport", "date_of_expiry", ["Date of expiry", "Expiry date", "Date of expiration"], _DATE, "date"),
    ("visa", "name", ["Name", "Full Name"], _NAME, "name"),
    ("visa", "visa_number", ["Visa No", "Visa Number"], _NUMBER, "number"),
    ("visa", "date_of_birth", ["Date of birth", "Birth date"], _DATE, "date"),
    ("visa", "date_of_expiry", ["Date of expiry", "Valid until", "Expiry date"], _DATE, "date"),
    ("national_id", "name", ["Name", "Full Name"], _NAME, "name"),
    ("national_id", "national_id_number", ["ID No", "ID Number", "National ID No"], _NUMBER, "number"),
    ("national_id", "date_of_birth", ["Date of birth", "Birth date"], _DATE, "date"),
    ("national_id", "date_of_expiry", ["Date of expiry", "Valid until", "Expiry date"], _DATE, "date"),
]


def label_key(text: Column) -> Column:
    """A label to compare: single spaces, no points and colons at the ends, small letters."""
    return F.lower(F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(" .:,")))


def tidied(value: Column, kind: Column) -> Column:
    """A value by its kind: dates in ISO form, numbers and names in capitals without diacritics."""
    return F.when(kind == "date", printed_date(value)).when(kind == "number", F.regexp_replace(F.upper(value), r"\s", "")).otherwise(F.regexp_replace(transliterate(value), r"\s+", " "))


def fields(words: DataFrame, document_type: str) -> DataFrame:
    """page, field and value. words: page, row, left, text.

    A row's words are joined in order; the longest anchor that starts its text
    or follows a break wins, and the value is what its shape first takes after it.
    """
    lines = words.groupBy("page", "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("left", "text"))), lambda x: x["text"]), " ").alias("line"))
    lines = lines.withColumn("key", F.lower(F.regexp_replace("line", r"\s+", " ")))
    parts = []
    for at, (_, name, anchors, shape, kind) in enumerate(r for r in RULES if r[0] == document_type):
        for anchor in sorted(anchors, key=len, reverse=True):
            pattern = rf"(?:^|.*[^\p{{L}}]){anchor.lower().replace(' ', ' +')}[ .:,]+"
            rest = F.regexp_replace(F.regexp_replace("line", r"\s+", " "), "(?i)" + pattern, "")
            value = F.regexp_extract(rest, f"^({shape})", 1)
            found = F.col("key").rlike(pattern) & (value != "")
            parts.append(F.when(found, F.struct(F.lit(at).alias("at"), F.lit(name).alias("field"), (F.lit(100) - F.lit(len(anchor))).alias("rank"), tidied(F.trim(value), F.lit(kind)).alias("value"))))
    hits = lines.select("page", "row", F.explode(F.array_compact(F.array(*parts))).alias("h"))
    best = hits.groupBy("page", "h.field").agg(F.min_by("h.value", F.struct("h.rank", "row")).alias("value"))
    return best


def mean_confidence(words: DataFrame, key: str) -> DataFrame:
    """Mean confidence of a page's words, blank ones left out; 0 without any."""
    read = F.when(F.trim("text") != "", F.col("confidence"))
    return words.groupBy(key).agg(F.coalesce(F.avg(read), F.lit(0.0)).alias("confidence"), F.count(read).alias("n_words"))
