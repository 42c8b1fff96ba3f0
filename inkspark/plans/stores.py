"""Queries over stored tables, indexes and streams that the given tables are written to first."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.functions import names
from inkspark.operators import spelling
from inkspark.plans.reading import _sql_one_way
from inkspark.plans.registry import query, table
from inkspark.plans.trails import _SQL_BATCHES, _SQL_HASH, events, hashed
from inkspark.sources.pages import Pages
from inkspark.sources.retention import DailyStore
from inkspark.sources.text_index import TextIndex
from inkspark.stored import shared_folder, written
from inkspark.streaming import anchor, rate_limit


def _folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


# Names by spelling

_SQL_COPY = "substr(c_name, 1, c_custkey % 9) || substr(c_name, c_custkey % 9 + 2)"


@query(f"""with c as (select c_custkey as k, list_sort(string_split(upper(c_name || ' ' || c_mktsegment), ' ')) as a, list_sort(string_split(upper(c_mktsegment || ' ' || {_SQL_COPY}), ' ')) as b from customer),
l as (select min(k) as key_l, a from c group by a), r as (select min(k) as key_r, count(*) as n_r, b from c group by b),
p as (select key_l, key_r, n_r, greatest({_sql_one_way("a", "b")}, {_sql_one_way("b", "a")}) / 2 as s from l, r where abs(length(a[1] || a[2]) - length(b[1] || b[2])) <= 4)
select key_l, key_r, n_r, round(s, 9) as similarity from p where s >= {names.TOLERANCE}""")
def names_joined(spark: SparkSession, d: str) -> DataFrame:
    """Customers' names against a copy whose words stand the other way round and lack a letter: all pairs that are one name by spelling."""
    c = table(spark, d, "customer")
    at = (F.col("c_custkey") % 9).cast("int")
    copied = F.concat(F.substring("c_name", F.lit(1), at), F.substring("c_name", at + 2, F.char_length("c_name")))
    left = c.select("c_custkey", F.concat_ws(" ", "c_name", "c_mktsegment").alias("name"))
    right = c.select("c_custkey", F.concat_ws(" ", "c_mktsegment", copied).alias("name"))
    pairs = spelling.spelling_join(left, right, "c_custkey", "name")
    return pairs.select("key_l", "key_r", "n_r", F.round("similarity", 9).alias("similarity"))


# Pages and searches


@query("select event_id as id, ts, value from events order by ts, event_id limit 200 offset 800")
def deep_page(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("ts").alias("created_at"), F.col("event_id").alias("id"), "value")
    pages = Pages(spark, _folder(spark, "pages")).build(rows, ["created_at", "id"])
    return pages.page(800, 200).select("id", F.col("created_at").alias("ts"), "value")


@query("""select o_orderkey as id from orders where contains(lower(strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderpriority || ' ' || o_orderstatus), '-03 1-urg')""")
def search_indexed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority", "o_orderstatus")
    index = TextIndex(spark, _folder(spark, "search"), ["day", "o_orderpriority", "o_orderstatus"]).build(rows, ["day", "id"], 1000)
    return index.search("-03 1-URG").select("id")


# Retention


@query("""with e as (select event_id, sha256('kept ' || (event_id // 2)) as digest, strptime(strftime(ts, '%Y-%m-%d'), '%Y-%m-%d') as day, event_type = 'error' as live from events),
f as (select digest, min(day) as day, bool_or(live) as live from e group by 1)
select digest, strftime(day, '%Y-%m-%d') as day from f where not live and day < timestamp '2024-01-06'""")
def retention_swept(spark: SparkSession, d: str) -> DataFrame:
    """Contents that two events share, by day: those outside the window that no live event refers to are deleted."""
    e = table(spark, d, "events").select(F.sha2(F.concat(F.lit("kept "), F.floor(F.col("event_id") / 2).cast("string")), 256).alias("digest"), F.lit(1).cast("long").alias("size"), F.to_date("ts").alias("day"), "event_type")
    first = written(e.groupBy("digest", "size").agg(F.min("day").alias("day")), "contents")
    store = DailyStore(spark, _folder(spark, "daily"))
    store.put(first)
    references = e.select(F.when(F.col("event_type") == "error", F.concat_ws(":", F.lit("sha256"), "digest", "size")).alias("reference"))
    gone = store.sweep(references, datetime.datetime(2024, 1, 20, tzinfo=datetime.timezone.utc), 14)
    return gone.select("digest", F.date_format("day", "yyyy-MM-dd").alias("day"))


# Streams


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream. A stream takes a folder or a pattern, and the table may be one file."""
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")


@query("""with w as (select user_id, cast(floor(epoch(ts) / 3600) as bigint) as hour, count(*) as n from events group by 1, 2)
select cast(user_id as varchar) as user_id, hour, n, greatest(n - 2, 0) as refused from w""")
def limited_by_stream(spark: SparkSession, d: str) -> DataFrame:
    """The limiter as a stream over the events: how many requests each window had, and how many of them were refused."""
    folder = _folder(spark, "limits")
    requests = _stream(spark, d).select(F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("timestamp").alias("at"))
    limits = rate_limit.limited_stream(requests, "user_id", "at", limit=2, seconds=3600)
    writer = limits.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True)
    writer.start().awaitTermination()
    hour = F.floor(F.unix_seconds("at") / 3600)
    return spark.read.schema(limits.schema).parquet(f"{folder}/out").groupBy("user_id", hour.alias("hour")).agg(F.max("n").alias("n"), F.count_if("refused").alias("refused"))


@query(f"with {_SQL_BATCHES} select id, batch, batch_index, {_SQL_HASH} as digest, count(*) over (partition by batch) as n_leaves from b")
def anchored_by_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events anchored by a stream: each event's batch, its place there, its digest, and the batch's number of leaves."""
    folder = _folder(spark, "anchored")
    log = anchor.open_log(spark, f"{folder}/log")
    source = _stream(spark, d).select("user_id", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), "event_type")
    anchor.anchoring(hashed(source), log, bytes(range(32)), f"{folder}/state", availableNow=True).awaitTermination()
    stamps, entries = log.read("stamps"), log.read("ledger").select("batch", F.col("n_leaves").cast("long").alias("n_leaves"))
    return stamps.join(hashed(events(spark, d)).select("id", "digest"), "id").join(entries, "batch").select("id", "batch", "batch_index", "digest", "n_leaves")
