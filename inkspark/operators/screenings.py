"""Reading screenings: live rows, optional filters, order, pages and counts."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PAGE, DEFAULT_PAGE = 200, 20


def live(rows: DataFrame) -> DataFrame:
    """Rows that aren't deleted."""
    return rows.filter(F.col("deleted_at").isNull())


def _bound(moment: datetime.datetime | None) -> Column | None:
    """A moment in UTC; one without a zone is refused."""
    if moment is None:
        return None
    if moment.tzinfo is None:
        raise ValueError("a bound needs a time zone")
    return F.lit(moment.astimezone(datetime.timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")


def matching(rows: DataFrame, band: str | None = None, document_type: str | None = None, start: datetime.datetime | None = None, end: datetime.datetime | None = None) -> DataFrame:
    """Live rows that meet all given conditions; the range is closed."""
    low, high = _bound(start), _bound(end)
    if start and end and start > end:
        raise ValueError("the range ends before it starts")
    out = live(rows)
    if band is not None:
        out = out.filter(F.col("band") == band)
    if document_type is not None:
        out = out.filter(F.col("document_type") == document_type)
    if low is not None:
        out = out.filter(F.col("created_at") >= low)
    if high is not None:
        out = out.filter(F.col("created_at") <= high)
    return out


def by_band(rows: DataFrame, band: str | None) -> DataFrame:
    """Live rows of a band; None means those without one."""
    return live(rows).filter(F.col("band").eqNullSafe(F.lit(band)))


def page(rows: DataFrame, offset: int = 0, limit: int = DEFAULT_PAGE) -> DataFrame:
    """A page in read order: created_at, then id. The limit makes it a top-k, not a whole sort."""
    if offset < 0 or not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"offset from 0, limit from 1 to {MAX_PAGE}")
    return rows.orderBy("created_at", "id").offset(offset).limit(limit)


def deleted(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows with deleted_at set where a tombstone (id, at) names a live one; earlier deletions stay."""
    marks = tombstones.groupBy(F.col("id").alias("__id")).agg(F.min("at").alias("__at"))
    joined = rows.join(marks, rows["id"] == marks["__id"], "left")
    return joined.withColumn("deleted_at", F.coalesce("deleted_at", "__at")).drop("__id", "__at")


def exactly_one(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The value of each key; more than one is an error."""
    n = F.count(F.lit(1))
    return rows.groupBy(key).agg(F.when(n == 1, F.min(value)).otherwise(F.raise_error(F.lit("more than one row")).cast(rows.schema[value].dataType)).alias(value))


def row_text(columns: list[str]) -> Column:
    """A row's columns as one text in lower case, as a search reads it."""
    return F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)))


def search(rows: DataFrame, columns: list[str], term: str, band: str | None = None) -> DataFrame:
    """Rows whose text holds a term in any case, and whose band, or not-scored, is the chosen one. ``sources.text_index`` finds the same rows of a stored table in few files."""
    out = rows.filter(F.contains(row_text(columns), F.lower(F.lit(term))))
    return out if band is None else out.filter(F.coalesce("band", F.lit("not-scored")) == band)


def escalates(score: Column) -> Column:
    """Within the band that goes on to deeper checks: over 34, up to 69."""
    return (score > 34) & (score <= 69)


def in_profile(document_type: Column, state: Column, types: list[str], states: list[str]) -> Column:
    """Whether type or state, in any case and spacing, is on a list."""
    folded = lambda xs: [x.strip().lower() for x in xs]
    return F.lower(F.trim(document_type)).isin(folded(types)) | F.lower(F.trim(state)).isin(folded(states))


def expired(objects: DataFrame, now: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """Objects strictly older than so many days, and the rest."""
    old = F.col("modified") < now - F.make_interval(days=F.lit(days))
    return objects.filter(old), objects.filter(~old)
