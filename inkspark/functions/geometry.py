"""Boxes, vectors and digests as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of half-open boxes (left, top, right, bottom); null if the union is empty."""
    wide = F.greatest(F.lit(0), F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"]))
    high = F.greatest(F.lit(0), F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]))
    area = lambda x: F.greatest(F.lit(0), x["right"] - x["left"]) * F.greatest(F.lit(0), x["bottom"] - x["top"])
    both = wide * high
    return F.try_divide(both.cast("double"), (area(a) + area(b) - both).cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """A vector of length 1; null for the zero vector."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x.cast("double") / norm(v)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine from -1 to 1; null if either vector is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    length = norm(a) * norm(b)
    return F.when(length > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / length)))


def cosine_as_is(a: Column, b: Column) -> Column:
    """Cosine as division gives it: NaN for zero vectors and what isn't finite. Components that one side lacks are left out; null if none is left."""
    known = lambda v: F.filter(v, lambda x: x.isNotNull())
    products = known(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    length = norm(known(a)) * norm(known(b))
    dot = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(products) > 0, F.when(length > 0, dot / length).otherwise(float("nan")))


def share_of_digest(digest: Column) -> Column:
    """The first 8 bytes of a hexadecimal digest as a number from 0 to 1, 1 excluded."""
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")
    return high.cast("double") / float(1 << 32) + low.cast("double") / float(1 << 64)


def finite(x: Column) -> Column:
    """Whether a number is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
