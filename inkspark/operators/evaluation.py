"""Rates with honest denominators, percentiles, and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspark.operators.ordering import sums_before


def rate(hits: Column, trials: Column) -> list[Column]:
    """hits, trials and their ratio, null without trials."""
    return [hits.alias("hits"), trials.alias("trials"), F.try_divide(hits.cast("double"), trials.cast("double")).alias("ratio")]


def latency(samples: DataFrame, key: str, value: str, targets: DataFrame | None = None) -> DataFrame:
    """Exact median and nearest-rank 95th percentile by key; with targets, every target has a row.

    Equal values are counted first. Ranks come from running sums over all (key,
    value) in order, less where the key starts, so no key's values are gathered
    in one task or one buffer.
    """
    counts = samples.filter(F.col(value).isNotNull()).groupBy(F.col(key), F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    ranked = sums_before(counts, [key, "__v"], "__c", "__at")
    sizes = ranked.groupBy(F.col(key).alias("__key")).agg(F.sum("__c").alias("__n"), F.min("__at").alias("__start"))
    joined = ranked.join(sizes, ranked[key].eqNullSafe(sizes["__key"]))
    low, n = F.col("__at") - F.col("__start"), F.col("__n")
    holds = lambda rank: F.when((rank > low) & (rank <= low + F.col("__c")), F.col("__v"))
    median = (F.max(holds(F.floor((n + 1) / 2))) + F.max(holds(F.floor((n + 2) / 2)))) / 2
    out = joined.groupBy(key).agg(F.max("__n").alias("n"), median.alias("median"), F.max(holds(F.ceil(F.lit(0.95) * n))).alias("p95"))
    if targets is None:
        return out
    joined = targets.join(out, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.withColumn("verdict", F.when(F.col("n") == 0, "designed").when(F.col("p95") <= F.col("target"), "met").otherwise("missed"))


def error_rates(trials: DataFrame, groups: list[str]) -> DataFrame:
    """False accepts among impostors and false rejects among genuine trials: overall and by each group alone.

    trials: genuine, accepted (null: not measured, left out). One pass over the
    data with grouping sets.
    """
    measured = trials.filter(F.col("accepted").isNotNull())
    sets = [[], *([g] for g in groups)]
    columns = [F.col(g) for g in groups]
    grouped = measured.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    n = lambda c: F.count_if(c)
    impostor, genuine = ~F.col("genuine"), F.col("genuine")
    false_accepts, impostors = n(impostor & F.col("accepted")), n(impostor)
    false_rejects, genuines = n(genuine & ~F.col("accepted")), n(genuine)
    return grouped.agg(
        false_accepts.alias("false_accepts"), impostors.alias("impostors"), F.try_divide(false_accepts.cast("double"), impostors.cast("double")).alias("far"),
        false_rejects.alias("false_rejects"), genuines.alias("genuines"), F.try_divide(false_rejects.cast("double"), genuines.cast("double")).alias("frr"),
    )


def rank_below(rows: DataFrame, fit: DataFrame, value: str) -> DataFrame:
    """Share of fit rows strictly below each row's value; null if there are none.

    Both sides are counted by distinct value first; running sums over the
    values in order give the ranks, and the rows join back by value.
    """
    counts = fit.groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    asked = rows.select(F.col(value).alias("__v")).distinct().withColumn("__n", F.lit(0).cast("long"))
    both = counts.unionByName(asked).groupBy("__v").agg(F.sum("__n").alias("__n"))
    total = fit.count()
    ranks = sums_before(both, ["__v"], "__n", "__below").select("__v", F.try_divide(F.col("__below").cast("double"), F.lit(float(total))).alias("rank"))
    return rows.join(ranks, rows[value].eqNullSafe(ranks["__v"])).drop("__v")


def normalised_entropy(rows: DataFrame, key: str, level: Column, bins: int) -> DataFrame:
    """Entropy of a histogram of levels by key, over its greatest possible value."""
    counts = rows.select(key, level.alias("__level")).groupBy(key, "__level").agg(F.count(F.lit(1)).alias("__n"))
    total = F.sum("__n").over(Window.partitionBy(key))
    p = counts.withColumn("__p", F.col("__n") / total)
    return p.groupBy(key).agg((-F.sum(F.col("__p") * F.log2("__p")) / F.log2(F.lit(float(bins)))).alias("entropy"))
