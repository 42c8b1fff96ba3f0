"""Connected components over a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node it knows."""
    both = links.select("u", "v").union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(least, "u")
    moved = joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Of links (u, v), u > v: node and component (its smallest node) for all nodes that aren't their component's smallest.

    Rounds follow the logarithm of the longest chain. Each round's links are a
    table in the shared folder; only their number and a checksum come to the
    driver. Nodes of many links are pre-aggregated for the smallest neighbour,
    and adaptive execution splits them in the join.
    """
    links = written(links.select("u", "v").distinct(), "links")
    mark = None
    while True:
        got = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if got == mark or not got[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = got
        links = written(_small_star(_large_star(links)), "links")
