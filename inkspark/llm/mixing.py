"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Targets: all sources share the corpus's words by weight. A source stops at
``max_epochs`` times its size; what it can't take is shared among the others by
weight until none is above. That fixed point is target = min(cap, weight * level)
with one water level for all. With sources ordered by cap / weight, the level is
the largest of (total - caps before) / (weights from here on), so no loop is
needed: a running sum over the sources finds it.

Sample: a source's target gives every document whole repetitions, and the
remaining words come from one more, partial pass in seeded order of documents
(md5 of seed and doc_id; without a doc_id, of its text). The document in which the remainder ends is taken in
part, by its first words, so that a source's taken words are its target to the
word. The order is found without sorting a source in one task: documents fall
into 65,536 buckets by the first digits of their hash; sums by source and bucket
say in which bucket the pass ends, and only that bucket's rows are ordered.

Defined results: null text has size 0; null source is a source, the last; a
source of no words has target 0; rows with equal doc_id and size are
interchangeable. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspark.llm.common import text_of, words_of, written

#: Digits of the hash that make a bucket.
BUCKET_DIGITS = 4
#: Largest number of sources whose plan is sent to all executors: some 100 bytes each.
BROADCAST_SOURCES = 50_000


def targets(by_source: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Of (source, source_size): the weight and target of each source.

    The windows without a key run over one row a source, not over documents.
    """
    ranked = by_source.withColumn("__rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights)).cast("int")).cast("long")
    caps = ranked.withColumns({"weight": weight, "__cap": F.col("source_size") * max_epochs})
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("__cap") / F.col("weight"), "__rank").rowsBetween(Window.unboundedPreceding, -1)
    caps = caps.withColumns({
        "__total": F.sum("source_size").over(everything),
        "__full": F.coalesce(F.sum("__cap").over(before), F.lit(0)),
        "__left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    level = F.max((F.col("__total") - F.col("__full")).cast("double") / F.col("__left")).over(everything)
    target = F.least(F.col("__cap").cast("double"), F.col("weight") * level)
    return caps.select("source", "source_size", "weight", target.alias("target"))


def mix(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """How many words of each document the mix takes: doc_id, source, size, source_size, target, copies, taken.

    ``copies`` counts whole repetitions; ``taken - copies * size`` words more
    are taken from the document's start.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.md5(text_of()))))
    sized = written(documents.select("doc_id", "source", F.size(words_of(text_of())).cast("long").alias("size"), order.alias("__order")), "mix-sizes")
    bucket = F.substring("__order", 1, BUCKET_DIGITS)
    sums = sized.groupBy("source", bucket.alias("__bucket")).agg(F.sum("size").alias("__sum"))
    sums = written(sums, "mix-sums")
    plan = targets(sums.groupBy("source").agg(F.sum("__sum").alias("source_size")), weights, max_epochs)
    words = F.round("target").cast("long")
    size = F.greatest("source_size", F.lit(1).cast("long"))
    plan = plan.withColumn("__copies", F.floor(words / size).cast("long")).withColumn("__rest", words - F.col("__copies") * F.col("source_size"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    # Where the partial pass ends: the first bucket whose running sum reaches the remainder.
    running = Window.partitionBy("source").orderBy("__bucket")
    ends = sums.withColumn("__reach", F.sum("__sum").over(running)).withColumnRenamed("source", "__source")
    ends = ends.join(plan, ends["__source"].eqNullSafe(plan["source"])).filter(F.col("__reach") >= F.col("__rest"))
    ends = ends.groupBy("source").agg(F.min_by(F.struct("__bucket", (F.col("__reach") - F.col("__sum")).alias("before")), "__bucket").alias("__end"))
    plan = plan.alias("p").join(ends.alias("e"), same(F_("p"), F_("e")), "left").select("p.*", F.col("e.__end.__bucket").alias("__end"), F.col("e.__end.before").alias("__before"))
    plan = written(plan, "mix-plan")
    small = plan.count() <= BROADCAST_SOURCES
    side = F.broadcast(plan) if small else plan
    rows = sized.alias("d").join(side.alias("p"), same(F_("d"), F_("p"))).select("d.*", bucket.alias("__bucket"), "p.source_size", "p.target", "p.__copies", "p.__rest", "p.__end", "p.__before")
    inside = F.col("__bucket") == F.col("__end")
    within = Window.partitionBy("source").orderBy("__order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.col("__before") + F.sum("size").over(within)
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("__rest") - (reach - F.col("size"))))
    border = rows.filter(inside).withColumn("__part", part)
    rest = rows.filter(~inside | F.col("__end").isNull()).withColumn("__part", F.when(F.col("__bucket") < F.col("__end"), F.col("size")).otherwise(F.lit(0).cast("long")))
    return border.unionByName(rest).select("doc_id", "source", "size", "source_size", "target", F.col("__copies").alias("copies"), (F.col("__copies") * F.col("size") + F.col("__part")).alias("taken"))


class F_:
    """Columns of an aliased frame."""

    def __init__(self, alias: str):
        self.alias = alias

    def __getitem__(self, name: str):
        return F.col(f"{self.alias}.{name}")


def mix_sql(weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 7, documents: str = "documents") -> str:
    """The same in DuckDB SQL, with the order over whole sources instead of buckets."""
    cases = " ".join(f"when {i} then {w}" for i, w in enumerate(weights))
    return rf"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    md5('{seed}:' || coalesce(cast(doc_id as varchar), md5(coalesce(text, '')))) as o from {documents}),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as r from sized group by source),
w as (select *, cast(case r % {len(weights)} {cases} end as bigint) as weight, source_size * {max_epochs} as cap from s),
l as (select *, sum(source_size) over () as total,
    coalesce(sum(cap) over (order by cap / weight, r rows between unbounded preceding and 1 preceding), 0) as full_before,
    sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, r rows between unbounded preceding and 1 preceding), 0) as left_weight from w),
t as (select *, least(cast(cap as double), weight * max(cast(total - full_before as double) / cast(left_weight as double)) over ()) as target from l),
p as (select *, cast(round(target) as bigint) // greatest(source_size, 1) as copies, cast(round(target) as bigint) - (cast(round(target) as bigint) // greatest(source_size, 1)) * source_size as rest from t),
d as (select a.doc_id, a.source, a.size, p.source_size, p.target, p.copies, p.rest,
    sum(a.size) over (partition by a.source order by a.o, a.doc_id, a.size rows between unbounded preceding and current row) as reach
    from sized a join p on a.source is not distinct from p.source)
select doc_id, size, source_size, target, copies,
  cast(copies * size + greatest(0, least(size, rest - (reach - size))) as bigint) as taken from d"""
