"""Evidence flags to scores: weighted sum, history, floor, clamp, band, in this order.

Sums run over decimals, so they don't depend on the order of rows. The weights
are a closed domain of some forty rows, which is why they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspark.functions.dates import decay
from inkspark.operators.sides import small

# Band limits, floor of a hard failure, half-life and cap of history.
LOW_MAX, REVIEW_MAX = 34.0, 69.0
HARD_FLOOR = 90.0
HALF_LIFE_DAYS = 180.0
HISTORY_CAP = 12.0


def band(score: Column) -> Column:
    return F.when(score <= LOW_MAX, "low").when(score <= REVIEW_MAX, "review").when(score.isNotNull(), "high")


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(score, F.lit(100.0)))


def basis_points(score: Column) -> Column:
    """Hundredths, halves to even."""
    return F.bround(score * 100).cast("int")


def weighted(flags: DataFrame, weights: DataFrame) -> DataFrame:
    """Each flag row with weight and contribution. A flag without a finite weight is an error."""
    known = small(weights.select(F.col("id").alias("__id"), "weight"))
    rows = flags.join(known, flags["id"] == known["__id"], "left").drop("__id")
    sound = F.col("weight").isNotNull() & ~F.isnan("weight")
    rows = rows.withColumn("weight", F.when(sound, F.col("weight")).otherwise(F.raise_error(F.concat(F.lit("no weight for flag "), F.coalesce("id", F.lit("null")))).cast("double")))
    return rows.withColumn("contribution", F.col("weight") * F.col("value"))


def contributions(flags: DataFrame, weights: DataFrame, key: str, arrival: str) -> DataFrame:
    """One row a flag in order of arrival; equal flags each count."""
    order = Window.partitionBy(key).orderBy(arrival)
    rows = weighted(flags, weights).withColumn("position", F.row_number().over(order) - 1)
    return rows.select(key, "position", "id", "value", "weight", "contribution")


def history_signal(outcomes: DataFrame, key: str, reference: Column) -> DataFrame:
    """Sum of verified outcomes' weights, halved with each half-life, within the cap either way."""
    age = F.datediff(reference, F.col("outcome_date"))
    age = F.when(age >= 0, age).otherwise(F.raise_error(F.lit("outcome after the reference date")).cast("int"))
    term = F.when(F.col("verified"), F.col("weight") * decay(age, HALF_LIFE_DAYS)).otherwise(0.0)
    total = F.sum(term.cast("decimal(28,12)")).cast("double")
    return outcomes.groupBy(key).agg(F.greatest(F.lit(-HISTORY_CAP), F.least(F.lit(HISTORY_CAP), total)).alias("signal"))


def score(flags: DataFrame, weights: DataFrame, key: str, history: DataFrame | None = None, floor: float = HARD_FLOOR) -> DataFrame:
    """raw, hard_failed, total and band of each key. ``flags``: key, id, value, hard."""
    rows = weighted(flags, weights).groupBy(key).agg(F.sum(F.col("contribution").cast("decimal(28,9)")).cast("double").alias("raw"), F.bool_or("hard").alias("hard_failed"))
    if history is not None:
        rows = rows.join(history, key, "left").withColumn("signal", F.coalesce("signal", F.lit(0.0)))
    else:
        rows = rows.withColumn("signal", F.lit(0.0))
    with_history = F.col("raw") + F.col("signal")
    floored = F.when(F.col("hard_failed"), F.greatest(with_history, F.lit(floor))).otherwise(with_history)
    return rows.withColumn("total", clamp(floored)).withColumn("band", band(F.col("total")))


def hard_reason(flags: DataFrame, key: str) -> DataFrame:
    """Distinct labels of hard flags, sorted, joined by semicolons; null if none."""
    labels = F.array_join(F.array_sort(F.collect_set(F.when(F.col("hard"), F.col("label")))), "; ")
    return flags.groupBy(key).agg(F.nullif(labels, F.lit("")).alias("reason"))


def tier_groups(flags: DataFrame, key: str) -> DataFrame:
    """Number and weight of flags by key and tier, and by key alone (tier null)."""
    return flags.rollup(key, "tier").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("value")).filter(F.col(key).isNotNull())


def partial(flags: DataFrame, weights: DataFrame, key: str, tier: str) -> DataFrame:
    """The weighted sum of one tier's flags alone, which says whether to go on: key and r1."""
    own = weighted(flags.filter(F.col("tier") == tier), weights)
    return own.groupBy(key).agg(F.sum(F.col("contribution").cast("decimal(28,9)")).cast("double").alias("r1"))
