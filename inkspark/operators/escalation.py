"""Why a screening goes on to deeper checks: a sentence for each reason, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkspark.functions.geometry import share_of_digest
from inkspark.functions.hashing import keyed_hash
from inkspark.operators.risk import LOW_MAX, REVIEW_MAX

# What is shipped. Nothing is on the profile, and nothing is drawn, until a deployment says so.
DOCUMENT_TYPES: tuple[str, ...] = ()
ISSUING_STATES: tuple[str, ...] = ()
DEEP_AUDIT_RATE = 0.0
FULL_DEPTH = "full"


def number_text(x: Column) -> Column:
    """A number with at most six significant digits and no zeros at its end, as scores and rates are printed."""
    size = F.abs(x)
    digits = lambda k: F.round(x, k).cast(f"decimal(38,{k})").cast("string")
    text = F.when(size >= 100_000, digits(0)).when(size >= 10_000, digits(1)).when(size >= 1_000, digits(2)).when(size >= 100, digits(3)).when(size >= 10, digits(4)).when(size >= 1, digits(5)).otherwise(digits(6))
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def ambiguous(r1: Column, low: float = LOW_MAX, high: float = REVIEW_MAX) -> Column:
    """The sentence for a score over the low band's end, up to the review band's; null if it isn't there. The range must be one."""
    if not low < high:
        raise ValueError("an ambiguous band is a range: its low end is below its high end")
    return F.when((r1 > low) & (r1 <= high), F.concat(F.lit("R1 of "), number_text(r1), F.lit(f" falls in the ambiguous band ({low:g}, {high:g}].")))


def high_risk(document_type: Column, state: Column, types: tuple[str, ...] = DOCUMENT_TYPES, states: tuple[str, ...] = ISSUING_STATES) -> Column:
    """The sentence for a type, or else a state, on the profile, in any case and spacing."""
    listed = lambda x, xs: F.coalesce(F.lower(F.trim(x)).isin([v.strip().lower() for v in xs]), F.lit(False)) if xs else F.lit(False)
    said = lambda what, x: F.concat(F.lit(f"The {what} '"), F.trim(x), F.lit("' is on the high-risk profile watchlist."))
    return F.when(listed(document_type, types), said("document type", document_type)).when(listed(state, states), said("issuing state", state))


def drawn(key: Column, secret: bytes, rate: float = DEEP_AUDIT_RATE) -> Column:
    """The sentence for a screening that the keyed draw takes; the same for the same key and secret."""
    if not 0 <= rate <= 1:
        raise ValueError("a rate is from 0 to 1")
    return F.when(share_of_digest(keyed_hash(secret, key)) < rate, F.lit(f"Drawn for a random deep audit at a rate of {rate:g}."))


def full_depth(depth_mode: Column) -> Column:
    return F.when(depth_mode == FULL_DEPTH, F.lit("The checkpoint is running in full-depth mode."))


def reasons(*sentences: Column) -> Column:
    """Those that apply, in order; an empty array escalates nothing."""
    return F.array_compact(F.array(*sentences))
