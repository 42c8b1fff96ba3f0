"""The service's answers, anchoring, runs and readings on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark import api
from inkspark.operators import anchoring, escalation, evidence, readings, regions, runs, screenings, vision
from inkspark.plans.reading import _SQL_SCREENINGS, orders_as_screenings
from inkspark.plans.registry import query, table
from inkspark.plans.trails import _SQL_BATCHES, events, verify_event


@query("""with o as (select o_orderkey as id, floor(o_totalprice / 5000) as r1, o_orderpriority as t, o_orderstatus as s, o_orderkey % 10 = 0 as f from orders)
select id, array_to_string(list_filter([case when r1 > 34 and r1 <= 69 then 'R1 of ' || cast(cast(r1 as int) as varchar) || ' falls in the ambiguous band (34, 69].' end,
  case when t = '1-URGENT' then 'The document type ''1-URGENT'' is on the high-risk profile watchlist.' when s = 'P' then 'The issuing state ''P'' is on the high-risk profile watchlist.' end,
  case when f then 'The checkpoint is running in full-depth mode.' end], lambda x: x is not null), ' ') as reasons from o""")
def escalation_reasons(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    found = escalation.reasons(
        escalation.ambiguous(F.floor(F.col("o_totalprice") / 5000).cast("double")), escalation.high_risk(F.col("o_orderpriority"), F.col("o_orderstatus"), (" 1-urgent ",), ("p",)),
        escalation.full_depth(F.when(F.col("o_orderkey") % 10 == 0, "full").otherwise("staged")),
    )
    return o.select(F.col("o_orderkey").alias("id"), F.array_join(found, " ").alias("reasons"))


def _sentence_sql(name: str) -> str:
    return anchoring.CHECK_SENTENCES[name].replace("'", "''")


@query(f"""with {_SQL_BATCHES}, v as (select id, case when batch % 7 = 3 then 'unknown' when id % 50 = 0 then 'altered' when batch % 11 = 5 then 'altered' else 'verified' end as status, batch,
  case when batch % 7 = 3 then '' when id % 50 = 0 then '{_sentence_sql("root")} {_sentence_sql("record")}' else '{_sentence_sql("root")} {_sentence_sql("record")} {_sentence_sql("proof")}' end as checked from b)
select id, status, case when status <> 'unknown' then batch end as batch, checked from v where id % 3 = 0 union all select -1, 'unknown', null, ''""")
def audit_verifications(spark: SparkSession, d: str) -> DataFrame:
    verified = verify_event(spark, d).join(_batches_of(spark, d), "id")
    asked = table(spark, d, "events").select(F.col("event_id").alias("id")).filter("id % 3 = 0").union(spark.createDataFrame([(-1,)], "id long"))
    return api.verifications(verified, asked).withColumn("checked", F.array_join("checked", " "))


def _batches_of(spark: SparkSession, d: str) -> DataFrame:
    from inkspark.plans.trails import batched

    return batched(spark, d).select("id", "batch")


_SQL_ANCHOR = "e as (select event_id as id, ts as created_at, case when event_id % 3 = 0 then cast(event_id // 75 as bigint) end as batch, case when event_id % 3 = 0 then (event_id // 3) % 25 end as batch_index, md5(cast(event_id as varchar)) || md5(cast(event_id as varchar)) as digest from events)"


def anchored_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of which every third stands in a batch already."""
    third = F.col("id") % 3 == 0
    batch, at = F.floor(F.col("id") / 75).cast("long"), (F.floor(F.col("id") / 3) % 25).cast("long")
    return events(spark, d).select("id", "created_at", F.when(third, batch).alias("batch"), F.when(third, at).alias("batch_index"), F.concat(F.md5(F.col("id").cast("string")), F.md5(F.col("id").cast("string"))).alias("digest"))


@query(f"with {_SQL_ANCHOR} select id, row_number() over (order by created_at, id) - 1 as position from e where batch is null order by position limit 100")
def anchoring_pending(spark: SparkSession, d: str) -> DataFrame:
    from inkspark.operators.ordering import numbered

    return numbered(anchoring.pending(anchored_events(spark, d)).select("id", "created_at"), ["created_at", "id"]).filter("position < 100").select("id", F.col("position").cast("long").alias("position"))


@query(f"""with {_SQL_ANCHOR}, p as (select id, row_number() over (order by created_at, id) - 1 as r from e where batch is null), m as (select max(batch) + 1 as m from e)
select e.id, coalesce(e.batch, r // 25 + m) as batch, coalesce(e.batch_index, r % 25) as batch_index from e left join p using (id) cross join m""")
def anchoring_stamped(spark: SparkSession, d: str) -> DataFrame:
    rows = anchored_events(spark, d)
    stamps, _ = anchoring.anchored(rows, bytes(range(32)))
    return anchoring.stamped(rows, stamps).select("id", "batch", "batch_index")


@query(f"""with {_SQL_ANCHOR}, w as (select id * 2 as id, id as pos from e where id % 5 < 2 union all select id * 2, id + 1000000 from e where id % 5 = 0 and id < 50)
select w.id, min(pos) as pos, case when count(*) > 1 then 'twice' when any_value(e.id) is null then 'missing' else 'batched' end as why from w left join e on w.id = e.id group by w.id having count(*) > 1 or any_value(e.id) is null or any_value(e.batch) is not null""")
def anchoring_refused(spark: SparkSession, d: str) -> DataFrame:
    rows = anchored_events(spark, d)
    wanted = rows.filter("id % 5 < 2").select((F.col("id") * 2).alias("id"), F.col("id").alias("pos")).union(rows.filter("id % 5 = 0 and id < 50").select(F.col("id") * 2, F.col("id") + 1000000))
    return anchoring.refused(rows, wanted)


@query("select event_id as id, substr(sha256('s:' || event_id), 1, 32) as salt from events")
def record_salts(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("id", anchoring.salts(F.col("id"), "s").alias("salt"))


@query(f"with {_SQL_SCREENINGS} select id, created_at, document_type, status, band from s where deleted_at is null and band = 'review' order by created_at, id limit 20")
def service_list(spark: SparkSession, d: str) -> DataFrame:
    return api.screening_list(orders_as_screenings(spark, d), band="review")[0]


@query(f"with {_SQL_SCREENINGS} select count(*) as total from s where deleted_at is null and band = 'review'")
def service_list_total(spark: SparkSession, d: str) -> DataFrame:
    return api.screening_list(orders_as_screenings(spark, d), band="review")[1]


@query(f"""with {_SQL_SCREENINGS}, a as (select o_orderkey * 2 as id from orders), l as (select l_orderkey as id, count(*) as n, min((l_linenumber, l_returnflag))[2] as first_flag, sum(case when l_linenumber > 2 then 1 else 0 end) as n_stages from lineitem group by 1)
select a.id, s.band, case when s.id is null then null else coalesce(n, 0) end as n_flags, first_flag, case when s.id is null then null else coalesce(n_stages, 0) end as n_stages, case when s.id is null then 404 end as refused
from a left join s on a.id = s.id and s.deleted_at is null left join l on s.id = l.id""")
def service_details(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("long").alias("position"), F.col("l_returnflag").alias("id"), F.col("l_linestatus").alias("label"), F.col("l_discount").cast("double").alias("value"))
    trace = line.filter("position > 2").select("key", F.col("position").alias("stage"), F.col("id").alias("tier"), F.lit(1).cast("long").alias("elapsed_ms"))
    terms = line.select("key", F.col("position").cast("int").alias("position"), "id", "value", F.lit(1.0).alias("weight"), F.col("value").alias("contribution"))
    asked = table(spark, d, "orders").select((F.col("o_orderkey") * 2).alias("id"))
    rows = api.detail(orders_as_screenings(spark, d), asked, line, trace, terms)
    many = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long")
    return rows.select("id", "band", many("flags").alias("n_flags"), F.get("flags", 0)["id"].alias("first_flag"), many("stage_trace").alias("n_stages"), F.col("refused.status").alias("refused"))


@query("""select user_id, '{"count":' || count(*) || ',"events":[' || string_agg('{"id":' || event_id || ',"type":"' || event_type || '"}', ',' order by ts, event_id) || '],"id":' || user_id || '}' as document from events where value > 60 group by 1""")
def progress_document(spark: SparkSession, d: str) -> DataFrame:
    return api.progress_documents(events(spark, d).filter("value > 60").withColumnRenamed("event_type", "type"), "user_id")


@query("select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as step, event_id as id, event_type as type from events where value > 60")
def progress_decoded(spark: SparkSession, d: str) -> DataFrame:
    documents = api.progress_documents(events(spark, d).filter("value > 60").withColumnRenamed("event_type", "type"), "user_id")
    return api.progress_steps(documents, "user_id").withColumn("step", F.col("step").cast("long"))


@query("""with t as (select user_id, row_number() over (partition by user_id order by ts, event_id) as stage, event_type as tier, event_id % 100 as ms from events where value > 60)
select user_id, '{"stages":[' || string_agg('{"stage":' || stage || ',"tier":"' || tier || '","elapsed_ms":' || ms || '}', ',' order by stage) || '],"total_ms":' || sum(ms) || '}' as document from t group by 1""")
def stage_trace_document(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = events(spark, d).filter("value > 60")
    stage = F.row_number().over(Window.partitionBy("user_id").orderBy("created_at", "id")).cast("long")
    return api.trace_documents(rows.select("user_id", stage.alias("stage"), F.col("event_type").alias("tier"), (F.col("id") % 100).cast("long").alias("elapsed_ms")), "user_id")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    action = F.get(F.array(*map(F.lit, [*api.ACTIONS, "burn"])), (F.col("o_custkey") % 4).cast("int"))
    return o.select((F.col("o_orderkey") * 2).alias("screening_id"), action.alias("action"), (F.col("o_orderkey") % 3 == 0).alias("override"), F.col("o_orderdate").alias("created_at"))


_SQL_DECISIONS = f"""with {_SQL_SCREENINGS}, q as (select o_orderkey * 2 as screening_id, ['allow', 'further_inspection', 'reject', 'burn'][o_custkey % 4 + 1] as action, o_orderkey % 3 = 0 as override, o_orderdate as created_at from orders),
a as (select q.*, s.band, s.id is null as gone, coalesce(q.action = 'reject' and s.band <> 'high', false) as against from q left join s on q.screening_id = s.id and s.deleted_at is null),
r as (select *, case when gone then 'SCREENING_NOT_FOUND' when action = 'burn' or (against and not override) then 'INVALID_REQUEST' end as error_code from a)"""


@query(_SQL_DECISIONS + " select screening_id, action, error_code is null and against as override, error_code from r")
def service_decisions(spark: SparkSession, d: str) -> DataFrame:
    return api.decisions(_requests(spark, d), orders_as_screenings(spark, d))[0]


@query(_SQL_DECISIONS + """ select screening_id, 'officer_decision' as event_type, '{"action":"' || action || '"}' as payload from r where error_code is null
union all select screening_id, 'override_recorded', '{"officer_action":"reject","system_band":"' || band || '"}' from r where error_code is null and against""")
def decision_events(spark: SparkSession, d: str) -> DataFrame:
    return api.decisions(_requests(spark, d), orders_as_screenings(spark, d))[1].drop("created_at")


@query("""with p as (select p_partkey as id, p_size * 300000 as size, ['image/jpeg', 'IMAGE/PNG; q=1', 'image/webp', 'text/html'][p_partkey % 4 + 1] as media, case when p_partkey % 9 = 0 then 'film' else 'auto' end as mode, case when p_partkey % 11 <> 0 then ['JPEG', 'PNG', 'JPEG'][p_partkey % 4 + 1] end as found, p_partkey % 7000 as w, 4000 as h from part),
f as (select id, case when size > 10485760 then 'IMAGE_TOO_LARGE' when size <= 0 then 'INVALID_IMAGE' when media = 'text/html' then 'UNSUPPORTED_MEDIA_TYPE' when mode = 'film' then 'INVALID_MODE' when found is null then 'INVALID_IMAGE'
  when found <> case when media = 'image/jpeg' then 'JPEG' when media like 'IMAGE/PNG%' then 'PNG' else 'WEBP' end then 'MEDIA_TYPE_MISMATCH' when w <= 0 or w * h > 20000000 then 'IMAGE_DIMENSIONS_TOO_LARGE' end as code from p)
select id, code, case when code is null then null when code like '%LARGE' then 413 when code like '%MEDIA%' then 415 else 422 end as status from f""")
def ingest_answers(spark: SparkSession, d: str) -> DataFrame:
    p, k = table(spark, d, "part"), F.col("p_partkey")
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (k % 4).cast("int"))
    fault = vision.ingest_fault(
        F.col("p_size") * 300000, pick(["image/jpeg", "IMAGE/PNG; q=1", "image/webp", "text/html"]), F.when(k % 9 == 0, "film").otherwise("auto"), F.when(k % 11 != 0, pick(["JPEG", "PNG", "JPEG", None])), k % 7000, F.lit(4000),
    )
    error = api.error_of(F.col("code"))
    return p.select(k.alias("id"), fault.alias("code")).select("id", error["error"]["code"].alias("code"), error["status"].alias("status"))


@query("""select event_id as id, upper(event_type) as method, '/api/' || user_id as path, cast(200 + event_id % 5 * 100 as int) as status, cast(greatest(0, round_even(value * 1000, 0)) as bigint) as elapsed_ms from events""")
def request_log(spark: SparkSession, d: str) -> DataFrame:
    micros = F.unix_micros(F.col("created_at").cast("timestamp"))
    rows = events(spark, d).select(
        F.col("id").cast("string").alias("request_id"), F.col("event_type").alias("method"), F.concat(F.lit("/api/"), F.col("user_id").cast("string"), F.lit("?q=1#x")).alias("path"), (200 + F.col("id") % 5 * 100).cast("int").alias("status"),
        F.timestamp_micros(micros).alias("started"), F.timestamp_micros(micros + (F.col("value") * 1000000).cast("long")).alias("ended"),
    )
    return api.request_log(api.with_request_id(rows)).withColumn("id", F.col("request_id").cast("long")).drop("request_id")


@query("""with l as (select l_orderkey as key, case when l_linenumber <= 3 then 'tier0' else 'tier2' end as stage, l_returnflag as id, l_linestatus = 'F' as hard from lineitem)
select key, stage, '{"flags":[' || string_agg('"' || id || '"', ',' order by id) || '],"format":null,"hard_failed":' || case when bool_or(hard) then 'true' else 'false' end || ',"tier":"' || stage || '"}' as payload from l group by 1, 2""")
def tier_payloads(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.when(F.col("l_linenumber") <= 3, "tier0").otherwise("tier2").alias("stage"), F.col("l_returnflag").alias("id"), (F.col("l_linestatus") == "F").alias("hard"))
    tiers = rows.groupBy("key", "stage").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.bool_or("hard").alias("hard"))
    return tiers.select("key", "stage", runs.tier_payload(F.col("stage"), F.lit(None).cast("string"), F.col("ids"), F.col("hard")).alias("payload"))


@query("""with l as (select l_orderkey as key, case when l_linenumber <= 3 then 0 else 1 end as position, l_returnflag as id, l_linestatus = 'F' as hard from lineitem), t as (select key, position, list(id order by id) as ids, bool_or(hard) as hard from l group by 1, 2),
n as (select key, count(*) as n, flatten(list(ids order by position)) as all_ids, list('tier' || 2 * position order by position) as names from t group by 1)
select o_orderkey as screening_id, 0 as seq, 'screening_created' as event_type, '{}' as payload from orders
union all select key, position + 1, 'tier_completed', '{"flags":[' || array_to_string(list_transform(ids, lambda x: '"' || x || '"'), ',') || '],"format":null,"hard_failed":' || case when hard then 'true' else 'false' end || ',"tier":"tier' || 2 * position || '"}' from t
union all select key, n + 1, 'analysis_completed', '{"band":"low","flags":[' || array_to_string(list_transform(all_ids, lambda x: '"' || x || '"'), ',') || '],"ruleset_version":"v1","score_bp":' || key % 100 || ',"tiers":[' || array_to_string(list_transform(names, lambda x: '"' || x || '"'), ',') || ']}' from n""")
def run_events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.when(F.col("l_linenumber") <= 3, 0).otherwise(1).alias("position"), F.col("l_returnflag").alias("id"), (F.col("l_linestatus") == "F").alias("hard"))
    rows = rows.withColumn("stage", F.concat(F.lit("tier"), (2 * F.col("position")).cast("string")))
    trace = rows.groupBy("key", "stage", "position").agg(F.bool_or("hard").alias("hard_failed"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    scores = orders.select("id", (F.col("id") % 100).alias("score_bp"), F.lit("low").alias("band"))
    return runs.events_of(orders, trace, rows, scores, "v1")


@query("""with k as (select p_partkey as field, p_size / 50.0::double as a, (p_partkey % 100) / 100.0::double as b, case when p_partkey % 3 > 0 then (p_partkey % 97) / 100.0::double end as c from part)
select field, case when a >= 0.8 then 'first' when b >= 0.8 or c is null then 'again' else 'fallback' end as text, not coalesce(case when a >= 0.8 then a when b >= 0.8 or c is null then b else c end >= 0.8, false) as low_confidence,
  case when a >= 0.8 then '' when b >= 0.8 or c is null then 're_read' else 're_read,fallback' end as steps from k""")
def gated_fields(spark: SparkSession, d: str) -> DataFrame:
    p, k = table(spark, d, "part"), F.col("p_partkey")
    read = lambda name, c: F.struct(F.lit(name).alias("text"), c.cast("double").alias("confidence"))
    rows = p.select(k.alias("field"), read("first", F.col("p_size") / 50).alias("first"), read("again", (k % 100) / 100).alias("again"), F.when(k % 3 > 0, read("fallback", (k % 97) / 100)).alias("fallback"))
    return readings.gated(rows).select("field", "text", "low_confidence", "steps")


@query("""select l_orderkey as page, l_linenumber as pos, least(floor(l_quantity), floor(l_linenumber * 1.5)) as "left", floor(l_discount * 100) as top, greatest(ceil(l_quantity), ceil(l_linenumber * 1.5)) as "right", ceil(l_tax * 100 + l_discount * 100) as bottom from lineitem where l_linestatus = 'F' and l_linenumber % 4 <> 0""")
def word_boxes(spark: SparkSession, d: str) -> DataFrame:
    x, y, n = F.col("l_quantity").cast("double"), (F.col("l_discount") * 100).cast("double"), F.col("l_linenumber")
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    conf = F.when(n % 4 == 0, -1.0).otherwise(n * 10.0)
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), n.alias("pos"), F.when(F.col("l_linestatus") == "F", "w").otherwise(" ").alias("text"), conf.alias("conf"), F.array(point(x, y), point(n * 1.5, y), point(x, y + F.col("l_tax") * 100), point(n * 1.5, y)).alias("quad"))
    boxes = readings.boxes(readings.words(rows))
    return boxes.select("page", "pos", *(F.col(c).cast("double").alias(c) for c in ("left", "top", "right", "bottom")))


@query("""with w as (select l_orderkey as page, avg(l_discount * 10) as c from lineitem where l_linenumber > 1 group by 1) select o_orderkey as key, 'OCR_LOW_CONFIDENCE' as id, round(1 - coalesce(c, 0), 9) as value from orders left join w on o_orderkey = page where coalesce(c, 0) < 0.8""")
def unread_pages(spark: SparkSession, d: str) -> DataFrame:
    # The order of words is that of the table's files and their rows.
    words = table(spark, d, "lineitem").filter("l_linenumber > 1").select(F.col("l_orderkey").alias("page"), (F.col("l_discount").cast("double") * 10).alias("confidence"), F.struct("_metadata.file_name", "_metadata.row_index").alias("at"))
    pages = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"))
    return readings.unread_flags(pages, readings.mean_confidences(words, F.col("at"))).withColumn("value", F.round("value", 9))


@query("""with p as (select c_custkey as document, 'P' || c_custkey as number, '19' || lpad(cast(c_custkey % 100 as varchar), 2, '0') || '-03-04' as born from customer),
b as (select document, case when document % 5 = 0 then 'Q' || document else number end as n, lpad(cast((document + case when document % 7 = 0 then 1 else 0 end) % 100 as varchar), 2, '0') || '0304' as d from p where document % 11 <> 0)
select document as key, 'passport_number' as field, n as expected, number as found from p join b using (document) where n <> number
union all select document, 'date_of_birth', d, born from p join b using (document) where document % 7 = 0""")
def barcode_findings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    year = lambda n: F.lpad((n % 100).cast("string"), 2, "0")
    number = F.concat(F.lit("P"), k.cast("string"))
    pages = table(spark, d, "customer").select(k.alias("document"), F.explode(F.array(F.struct(F.lit("passport_number").alias("field"), number.alias("value")), F.struct(F.lit("date_of_birth").alias("field"), F.concat(F.lit("19"), year(k), F.lit("-03-04")).alias("value")))).alias("f")).select("document", "f.*")
    other = F.when(k % 5 == 0, F.concat(F.lit("Q"), k.cast("string"))).otherwise(number)
    line = F.concat(F.rpad(other, 9, "<"), F.lit("0UTO"), year(k + F.when(k % 7 == 0, 1).otherwise(0)), F.lit("03040F2001017"), F.lit("<" * 16))
    codes = table(spark, d, "customer").filter("c_custkey % 11 <> 0").select(k.alias("document"), F.concat(F.lit("first line\n"), line, F.lit(" ")).alias("text"))
    return readings.against_barcode(pages, codes).select("key", "field", "expected", "found")


@query("""with g as (select l_orderkey as page, l_linenumber % 4 as line, cast(l_quantity as int) * 3 as top, 10 + l_linenumber as height from lineitem), l as (select page, line, min(top) as t, max(height) - min(height) as spread, median(height) as m from g group by 1, 2),
s as (select *, least(t - lag(t) over w, lead(t) over w - t) as gap from l window w as (partition by page order by t, line)), k as (select *, min(gap) over (partition by page) as least_gap from s)
select page, line from k where spread <= m / 3.0::double and (gap is null or gap - least_gap <= 0.25 * least_gap)""")
def zone_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") % 4).alias("line"), (F.col("l_quantity").cast("int") * 3).alias("top"), (10 + F.col("l_linenumber")).alias("height"))
    return regions.sound_lines(rows, "page")


@query("""with b as (select l_orderkey as page, l_linenumber as pos, cast(l_quantity as int) as l, cast(l_quantity as int) * 2 as t, 5 as w, 9 as h, radians(l_linenumber * 1.25) as a from lineitem),
c as (select *, list_transform([[l, t], [l, t + h], [l + w, t], [l + w, t + h]], lambda p: [100 + (p[1] - 100) * cos(a) - (p[2] - 100) * sin(a), 100 + (p[1] - 100) * sin(a) + (p[2] - 100) * cos(a)]) as k from b),
d as (select page, pos, round_even(list_min(list_transform(k, lambda p: p[1])), 0) as x, round_even(list_min(list_transform(k, lambda p: p[2])), 0) as y, round_even(list_max(list_transform(k, lambda p: p[1])), 0) as x2, round_even(list_max(list_transform(k, lambda p: p[2])), 0) as y2 from c)
select page, pos, cast(x as int) as "left", cast(y as int) as top, cast(x2 - x as int) as width, cast(y2 - y as int) as height from d""")
def turned_boxes(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("pos"), q.alias("left"), (q * 2).alias("top"), F.lit(5).alias("width"), F.lit(9).alias("height"))
    return regions.turned(rows, F.col("pos") * 1.25, F.lit(100.0), F.lit(100.0))


@query("""select l_orderkey as page, count(*) as n, round(sum(l_linenumber) / sum(cast(l_quantity as int) * 9)::double, 9) as density, round(avg(l_quantity), 9) as mean_height, round(stddev_pop(l_quantity), 9) as height_spread from lineitem group by 1""")
def font_styles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("area"), F.lit(9).alias("width"), F.col("l_quantity").cast("int").alias("height"))
    out = regions.font_style(rows, "page")
    return out.select("page", "n", *(F.round(c, 9).alias(c) for c in ("density", "mean_height", "height_spread")))


@query("""select p_partkey as key, array_to_string(list_filter([case when trim(p_type) = '' then 'id' end, case when p_size % 6 > 3 then 'tier' end, case when p_partkey % 10 = 0 then 'weight_band' end, case when p_size > 40 then 'value' end, case when p_partkey % 4 = 0 then 'region' end], lambda x: x is not null), ',') as faults from part""")
def flag_faults(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    point = lambda x, y: F.struct(x.cast("int").alias("x"), F.lit(y).cast("int").alias("y"))
    region = F.when(k % 4 == 0, F.array(point(k, 0), point(k, 1))).when(k % 4 == 1, F.array(point(k, 0), point(k, 1), point(k, 2)))
    rows = table(spark, d, "part").select(
        k.alias("key"), F.col("p_type").alias("id"), (size % 6).alias("tier"), F.lit("label").alias("label"), F.when(k % 10 == 0, "none").otherwise("low").alias("weight_band"), (size / 40).alias("value"), F.lit(1.0).alias("confidence"), region.alias("region"),
        F.lit("because").alias("reason"), F.lit("module").alias("source_module"),
    )
    return evidence.faults(rows).select("key", F.array_join("faults", ",").alias("faults"))


@query("""with v as (select l_orderkey as key, ['a', 'b', 'c'][l_linenumber % 3 + 1] as member, l_returnflag = 'R' as suspect, cast(l_discount as double) as score from lineitem), g as (select key, member, bool_or(suspect) as suspect, max(score) as score from v group by 1, 2)
select key, arg_max(member, (suspect, score, -ascii(member))) as member, max(suspect) as suspect, arg_max(score, (suspect, score)) as score from g group by 1""")
def strongest_member(spark: SparkSession, d: str) -> DataFrame:
    member = F.get(F.array(*map(F.lit, "abc")), (F.col("l_linenumber") % 3).cast("int"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key"), member.alias("member")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("suspect"), F.max(F.col("l_discount").cast("double")).alias("score"))
    return vision.strongest(rows, "key", ["a", "b", "c"])


@query(f"""with {_SQL_SCREENINGS}, f as (select l_orderkey as key, '[' || string_agg('{{"id":"' || l_returnflag || '","label":"' || l_linestatus || '","value":1}}', ',' order by l_linenumber, l_returnflag, l_linestatus) || ']' as flags from lineitem group by 1)
select id, case when id % 4 = 0 then 'completed' else status end as status, case when id % 4 = 0 then 'low' else band end as band, case when id % 4 = 0 then coalesce(flags, '[]') end as flags from s left join f on s.id = f.key""")
def stored_results(spark: SparkSession, d: str) -> DataFrame:
    rows = orders_as_screenings(spark, d)
    scores = rows.filter("id % 4 = 0").select("id", F.lit(1.0).alias("score"), F.lit("low").alias("band"), F.lit("v1").alias("ruleset_version"), F.lit(None).cast("map<string,string>").alias("model_versions"))
    flags = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("position"), F.col("l_returnflag").alias("id"), F.col("l_linestatus").alias("label"), F.lit(1).alias("value"))
    return runs.stored_result(rows, scores, flags).select("id", "status", "band", "flags")
