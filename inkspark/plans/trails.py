"""Trails, ledgers and regions made from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.functions import geometry, hashing
from inkspark.functions.mrz import LAYOUT
from inkspark.operators import audit, ledger, regions
from inkspark.plans.registry import query, table
from inkspark.streaming import rate_limit

SECRET = b"draw"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "event_type", "value")


@query("""select event_id as id, lag(event_id) over w as supersedes, case when lead(event_id) over w is null then 'current' else 'superseded' end as status from events window w as (partition by user_id order by ts, event_id)""")
def decision_supersedes(spark: SparkSession, d: str) -> DataFrame:
    return audit.decisions(events(spark, d), "user_id").select("id", "supersedes", "status")


@query("select user_id, event_id as id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def decision_current(spark: SparkSession, d: str) -> DataFrame:
    return audit.current(events(spark, d), "user_id").select("user_id", "id", "event_type")


@query("select o_orderkey as id, o_orderstatus = 'F' and o_orderpriority <> '1-URGENT' as contradicts from orders")
def decision_contradictions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "reject").otherwise("allow").alias("action"), F.when(F.col("o_orderpriority") == "1-URGENT", "high").otherwise("low").alias("band"))
    return rows.select("id", audit.contradicts("action", "band").alias("contradicts"))


@query("""with o as (select *, min(case when event_type = 'view' then ts end) over (partition by user_id) as opened from events)
select event_id as id, row_number() over (partition by user_id order by coalesce(ts < opened, false), ts, event_id) - 1 as position from o""")
def trail_order(spark: SparkSession, d: str) -> DataFrame:
    return audit.trail_order(events(spark, d), "user_id", "view").select("id", F.col("position").cast("long").alias("position"))


@query("""with o as (select *, min(case when event_type = 'view' then ts end) over (partition by user_id) as opened from events)
select event_id as id, row_number() over w as stage, cast(greatest(0, round_even(date_diff('microsecond', coalesce(lag(ts) over w, opened), ts) / 1000, 0)) as bigint) as elapsed_ms from o where event_type = 'click' window w as (partition by user_id order by ts, event_id)""")
def stage_trace(spark: SparkSession, d: str) -> DataFrame:
    return audit.stage_trace(events(spark, d), "user_id", "view", "click").select("id", F.col("stage").cast("long").alias("stage"), "elapsed_ms")


@query("""with f as (select user_id, event_type, min((ts, event_id)) as first from events where value < 40 group by 1, 2), c as (select user_id, event_type, 0 as part, row_number() over (partition by user_id order by first) as p from f),
r as (select user_id, event_type, 1 as part, row_number() over (partition by user_id order by min((ts, event_id))) as p from events group by 1, 2), a as (select * from c union all select * from r where (user_id, event_type) not in (select user_id, event_type from c))
select user_id, event_type, row_number() over (partition by user_id order by part, p, event_type) - 1 as step, part = 0 as completed from a""")
def progress_steps(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    done, seen = audit.first_seen(rows.filter("value < 40"), "user_id", "event_type"), audit.first_seen(rows, "user_id", "event_type")
    return audit.steps(done, seen, "user_id", "event_type").withColumn("step", F.col("step").cast("long"))


_SQL_BATCHES = "b as (select event_id as id, ts, user_id, event_type, cast(floor((row_number() over (order by ts, event_id) - 1) / 25) as bigint) as batch, (row_number() over (order by ts, event_id) - 1) % 25 as batch_index from events)"


def batched(spark: SparkSession, d: str) -> DataFrame:
    return ledger.batches(events(spark, d), ["created_at", "id"])


@query(f"with {_SQL_BATCHES} select id, batch, batch_index from b")
def ledger_batches(spark: SparkSession, d: str) -> DataFrame:
    return batched(spark, d).select("id", "batch", F.col("batch_index").cast("long").alias("batch_index"))


_SQL_RECORD = """'{"actor":' || user_id || ',"event_type":"' || event_type || '","id":' || id || '}'"""
_SQL_HASH = f"sha256(unhex(substr(md5(cast(id as varchar)), 1, 32)) || encode({_SQL_RECORD}))"


def hashed(rows: DataFrame) -> DataFrame:
    record = hashing.canonical({"id": F.col("id").cast("string"), "actor": F.col("user_id").cast("string"), "event_type": hashing.json_text(F.col("event_type"))})
    return rows.withColumn("digest", hashing.record_hash(F.md5(F.col("id").cast("string")), record))


@query(f"with b as (select event_id as id, user_id, event_type from events) select id, {_SQL_HASH} as digest from b")
def record_hash(spark: SparkSession, d: str) -> DataFrame:
    return hashed(events(spark, d)).select("id", "digest")


_SQL_NODE = "sha256(unhex('01' || l[2 * i + 1] || l[2 * i + 2]))"
_SQL_UP = f"case when len(l) > 1 then list_transform(range(0, cast(ceil(len(l) / 2) as bigint)), lambda i: case when 2 * i + 2 <= len(l) then {_SQL_NODE} else l[2 * i + 1] end) else l end"
_SQL_LEVELS = f"h as (select *, {_SQL_HASH} as digest from b), l0 as (select batch, list(sha256(unhex('00' || digest)) order by batch_index) as l from h group by 1), " + ", ".join(f"l{k} as (select batch, {_SQL_UP} as l from l{k - 1})" for k in range(1, 6))


@query(f"with {_SQL_BATCHES}, {_SQL_LEVELS} select l0.batch, len(l0.l) as n_leaves, l5.l[1] as merkle_root from l0 join l5 using (batch)")
def merkle_root_batch(spark: SparkSession, d: str) -> DataFrame:
    return ledger.roots(hashed(batched(spark, d))).withColumn("n_leaves", F.col("n_leaves").cast("long"))


@query(f"with {_SQL_BATCHES}, {_SQL_LEVELS} select h.batch, h.batch_index, l5.l[1] as reached from h join l5 using (batch)")
def merkle_proof(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger.proofs(hashed(batched(spark, d)))
    return rows.select("batch", "batch_index", ledger.folded(F.col("leaf"), F.col("proof")).alias("reached"))


@query(f"""with {_SQL_BATCHES} select id, case when batch % 7 = 3 then 'unknown' when id % 50 = 0 then 'altered' when batch % 11 = 5 then 'altered' else 'verified' end as outcome,
  case when batch % 7 = 3 then '' when id % 50 = 0 then 'root,record' else 'root,record,proof' end as checked from b""")
def verify_event(spark: SparkSession, d: str) -> DataFrame:
    rows = hashed(batched(spark, d))
    roots = ledger.roots(rows).filter("batch % 7 <> 3")
    roots = roots.withColumn("merkle_root", F.when(F.col("batch") % 11 == 5, F.sha2("merkle_root", 256)).otherwise(F.col("merkle_root")))
    now = rows.withColumn("recomputed", F.when(F.col("id") % 50 == 0, F.sha2("digest", 256)).otherwise(F.col("digest")))
    return ledger.verification(now, roots).select("id", "outcome", "checked")


@query("""with k as (select rpad('64726177', 128, '0') as k), p as (select list_reduce(list_transform(range(0, 64), lambda i: printf('%02x', xor(cast('0x' || k[2 * i + 1:2 * i + 2] as int), 54))), lambda a, b: a || b) as i, list_reduce(list_transform(range(0, 64), lambda j: printf('%02x', xor(cast('0x' || k[2 * j + 1:2 * j + 2] as int), 92))), lambda a, b: a || b) as o from k),
h as (select event_id as id, sha256(unhex(o || sha256(unhex(i) || encode(cast(event_id as varchar))))) as h from events, p)
select id, cast('0x' || h[1:8] as bigint) / 4294967296.0::double < 0.05 as drawn from h""")
def deep_audit_draw(spark: SparkSession, d: str) -> DataFrame:
    share = geometry.share_of_digest(hashing.keyed_hash(SECRET, F.col("id").cast("string")))
    return events(spark, d).select("id", (share < 0.05).alias("drawn"))


_SQL_MINUTE = "cast(floor(epoch(ts) / 3600) as bigint)"


@query(f"select event_id as id, count(*) over (partition by user_id, {_SQL_MINUTE} order by ts, event_id rows unbounded preceding) as n, count(*) over (partition by user_id, {_SQL_MINUTE} order by ts, event_id rows unbounded preceding) > 2 as refused from events")
def rate_limited_events(spark: SparkSession, d: str) -> DataFrame:
    return rate_limit.limited(events(spark, d), "user_id", "created_at", "id", limit=2, seconds=3600).select("id", F.col("n").cast("long").alias("n"), "refused")


@query("select user_id, date_trunc('hour', ts) as started, count(*) as n from events group by 1, 2")
def rate_counts(spark: SparkSession, d: str) -> DataFrame:
    return rate_limit.counts(events(spark, d), "user_id", "created_at", seconds=3600).select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "n")


_SQL_ISLANDS = """n as (select *, epoch_us(ts) as s, epoch_us(ts) + cast(value * 60000000 as bigint) as e from events), r as (select *, max(e) over (partition by user_id order by s, event_id rows between unbounded preceding and 1 preceding) as reach from n),
i as (select *, sum(case when reach is null or s >= reach then 1 else 0 end) over (partition by user_id order by s, event_id rows unbounded preceding) - 1 as island from r)"""


def event_islands(spark: SparkSession, d: str) -> DataFrame:
    start = F.unix_micros(F.col("created_at").cast("timestamp"))
    return regions.islands(events(spark, d), ["user_id"], start, start + (F.col("value") * 60000000).cast("long"), ["id"])


@query(f"with {_SQL_ISLANDS} select event_id as id, cast(island as bigint) as island from i")
def line_islands(spark: SparkSession, d: str) -> DataFrame:
    return event_islands(spark, d).select("id", F.col("island").cast("long").alias("island"))


@query(f"with {_SQL_ISLANDS} select user_id, count(distinct island) as n_cells, max(c) as widest from (select *, count(*) over (partition by user_id, island) as c from i) group by 1")
def cell_islands(spark: SparkSession, d: str) -> DataFrame:
    cells = event_islands(spark, d).groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("c"))
    return cells.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_cells"), F.max("c").alias("widest"))


_SQL_LAYOUT = "y(format, line, field, first, last) as (values " + ", ".join(f"('{f}', {li}, '{n}', {a}, {b})" for f, li, n, a, b in LAYOUT) + ")"


@query(f"with {_SQL_LAYOUT} select field, count(*) as n, min(l_quantity) as low, max(l_quantity) as high from lineitem join y on format = 'TD3' and line = l_linenumber % 2 + 1 and l_quantity between first and last group by 1")
def cell_field_range_join(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "lineitem").select(F.lit("TD3").alias("cell_format"), (F.col("l_linenumber") % 2 + 1).alias("cell_line"), F.col("l_quantity").alias("position"))
    layout = spark.createDataFrame(LAYOUT, "format string, line int, field string, first int, last int")
    return regions.in_spans(cells, layout, "cell_format", "cell_line", "position").groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("low"), F.max("position").alias("high"))


@query("select l_suppkey as key, count(*) as n, round(case when count(*) >= 2 and regr_sxx(l_extendedprice, l_quantity) > 0 then degrees(atan2(regr_sxy(l_extendedprice, l_quantity), regr_sxx(l_extendedprice, l_quantity))) else 0 end, 6) as skew from lineitem group by 1")
def residual_skew(spark: SparkSession, d: str) -> DataFrame:
    rows = regions.skew_degrees(table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "key"), "key", "l_quantity", "l_extendedprice")
    return rows.withColumn("skew", F.round("skew", 6))


@query("""select cast(round_even(value / 16, 0) as int) as bin_x, cast(round_even(user_id / 16.0, 0) as int) as bin_y, count(*) as n, round(cast(sum(cast(value as decimal(18,6))) as double) / count(*), 9) as mean_dx, round(sum(user_id) / count(*)::double, 9) as mean_dy from events group by 1, 2 having count(*) >= 8""")
def shift_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = regions.shift_clusters(events(spark, d), F.col("value"), F.col("user_id").cast("double"))
    return rows.withColumns({"mean_dx": F.round("mean_dx", 9), "mean_dy": F.round("mean_dy", 9)})


@query("select cast(floor(value / 8) as bigint) as bx, cast(floor(user_id / 8.0) as bigint) as by_, count(*) as n, least(count(*) / 4.0::double, 1) as vote from events group by 1, 2")
def vote_map(spark: SparkSession, d: str) -> DataFrame:
    return regions.vote_map(events(spark, d), F.col("value"), F.col("user_id").cast("double")).withColumnRenamed("by", "by_")


@query("""with g as (select l_orderkey as doc, l_linenumber as line, cast(l_quantity as int) as h, cast(l_discount * 100 as int) + 1 as w from lineitem)
select doc, count(*) as n, min(line) as "left", min(h) as top, max(line + w) as "right", max(h + h) as bottom from g where h between 8 and 24 and w / h::double between 0.2 and 2.5 group by 1""")
def glyph_line_boxes(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("l_quantity").cast("int")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("left"), h.alias("top"), ((F.col("l_discount") * 100).cast("decimal(18,0)").cast("int") + 1).alias("width"), h.alias("height"))
    return regions.line_boxes(regions.glyphs(rows), ["doc"])


@query()
def reading_rows(spark: SparkSession, d: str) -> DataFrame:
    top = F.col("l_quantity").cast("int")
    words = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("pos"), top.alias("top"), (top + 5).alias("bottom"))
    return regions.reading_rows(words, "page")


@query("""with p as (select l_orderkey as page, l_quantity as x, l_linenumber as y from lineitem)
select page, arg_min((x, y), (x + y, x, y))[1] as left_x, arg_max((x, y), (x + y, x, y))[1] as right_x from p group by 1""")
def corner_order(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("x"), F.col("l_linenumber").alias("y"))
    return regions.order_corners(points, "page").select("page", F.col("top_left.x").alias("left_x"), F.col("bottom_right.x").alias("right_x"))


@query(f"with {_SQL_BATCHES}, {_SQL_LEVELS} select batch, true as holds, batch % 2 = 0 as holds_swapped from l0")
def ledger_signatures(spark: SparkSession, d: str) -> DataFrame:
    from inkspark.functions import ed25519

    key = bytes(range(32))
    roots = ledger.roots(hashed(batched(spark, d))).withColumn("signature", ed25519.signed(F.col("merkle_root"), key))
    other = F.when(F.col("batch") % 2 == 0, F.col("merkle_root")).otherwise(F.sha2("merkle_root", 256))
    public = ed25519.public_key(key)
    return roots.select("batch", ed25519.signature_holds(F.col("merkle_root"), F.col("signature"), public).alias("holds"), ed25519.signature_holds(other, F.col("signature"), public).alias("holds_swapped"))


@query("""with l as (select l_orderkey as doc, l_linenumber % 3 as line, count(*) * 15 as n from lineitem group by 1, 2), c as (select doc, count(*) as n_lines, median(n) as glyphs from l group by 1)
select doc, n_lines, glyphs, case when n_lines = 2 and glyphs between 42 and 46 then 'TD3' when n_lines = 2 and glyphs between 34 and 38 then 'TD2' when n_lines = 3 and glyphs between 28 and 32 then 'TD1' end as format from c""")
def zone_formats(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 3).alias("line")).agg((F.count(F.lit(1)) * 15).alias("n"))
    return regions.infer_format(lines, "doc")


@query("""with t(field, fx, fy) as (values ('a', 10.0, 2.0), ('b', 40.0, 5.0)), b as (select l_orderkey as doc, l_quantity as cx, cast(l_linenumber as double) as cy, 1 as area from lineitem group by 1, 2, 3),
n as (select *, row_number() over (partition by doc, cx, cy order by sqrt((cx - fx) ** 2 + (cy - fy) ** 2), field) as r from b, t where sqrt((cx - fx) ** 2 + (cy - fy) ** 2) <= 64),
d as (select doc, field, sqrt((avg(cx) - any_value(fx)) ** 2 + (avg(cy) - any_value(fy)) ** 2) as deviation from n where r = 1 group by 1, 2)
select doc, field, round(deviation, 6) as deviation, deviation > 12 as flagged from d""")
def layout_deviations(spark: SparkSession, d: str) -> DataFrame:
    blobs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_quantity").alias("cx"), F.col("l_linenumber").cast("double").alias("cy"), F.lit(1).alias("area")).distinct()
    template = spark.createDataFrame([("a", 5, 0, 10, 4), ("b", 35, 0, 10, 10)], "field string, x int, y int, width int, height int")
    rows = regions.layout_deviations(blobs, template, "doc")
    return rows.select("doc", "field", F.round("deviation", 6).alias("deviation"), "flagged")
