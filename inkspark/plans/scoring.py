"""Scores, history, bands and evaluation on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.functions.geometry import overlap
from inkspark.operators import evaluation, risk
from inkspark.operators.weights import weightset
from inkspark.plans.registry import query, table

#: Flags dealt to order lines by line number.
LINE_FLAGS = ["QUALITY_BLUR", "MRZ_DOB_CHECK_DIGIT_MISMATCH", "DATE_EXPIRED", "OCR_LOW_CONFIDENCE", "WATCHLIST_IDENTITY_SEEN", "TAMPER_STAMP_ANOMALY"]
_SQL_WEIGHTS = "w(i, id, weight) as (values (0, 'QUALITY_BLUR', 5), (1, 'MRZ_DOB_CHECK_DIGIT_MISMATCH', 60), (2, 'DATE_EXPIRED', 55), (3, 'OCR_LOW_CONFIDENCE', 15), (4, 'WATCHLIST_IDENTITY_SEEN', 35), (5, 'TAMPER_STAMP_ANOMALY', 30))"
_SQL_FLAGS = f"""{_SQL_WEIGHTS},
f as (select l_orderkey as orderkey, l_linenumber as line, id, weight, l_discount * 10 as value, l_returnflag = 'R' and l_tax >= 0.07 as hard from lineitem join w on l_linenumber % 6 = w.i)"""


def line_flags(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array(*map(F.lit, LINE_FLAGS))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), F.get(ids, F.col("l_linenumber") % 6).alias("id"),
        (F.col("l_discount") * 10).alias("value"), ((F.col("l_returnflag") == "R") & (F.col("l_tax") >= 0.07)).alias("hard"),
    )


@query(f"""with {_SQL_FLAGS},
s as (select orderkey, cast(sum(cast(weight * value as decimal(28,9))) as double) as raw, bool_or(hard) as hard_failed from f group by orderkey),
t as (select *, greatest(0, least(100, case when hard_failed then greatest(raw, 90) else raw end)) as total from s)
select orderkey, round(raw, 6) as raw, hard_failed, round(total, 6) as total, case when total <= 34 then 'low' when total <= 69 then 'review' else 'high' end as band from t""")
def risk_score_by_order(spark: SparkSession, d: str) -> DataFrame:
    rows = risk.score(line_flags(spark, d), weightset(spark), "orderkey")
    return rows.select("orderkey", F.round("raw", 6).alias("raw"), "hard_failed", F.round("total", 6).alias("total"), "band")


@query(f"""with {_SQL_FLAGS}
select orderkey, row_number() over (partition by orderkey order by line, value, hard) - 1 as position, id, round(weight * value, 6) as contribution from f""")
def score_contributions(spark: SparkSession, d: str) -> DataFrame:
    flags = line_flags(spark, d).withColumn("arrival", F.struct("line", "value", "hard"))
    return risk.contributions(flags, weightset(spark), "orderkey", "arrival").select("orderkey", F.col("position").cast("long").alias("position"), "id", F.round("contribution", 6).alias("contribution"))


@query(f"""with {_SQL_FLAGS}
select orderkey, cast(sum(round(cast(weight * value as decimal(18,6)), 2)) as double) as shown from f group by orderkey""")
def sum_of_rounded_contributions(spark: SparkSession, d: str) -> DataFrame:
    rows = risk.weighted(line_flags(spark, d), weightset(spark))
    return rows.groupBy("orderkey").agg(F.sum(F.round(F.col("contribution").cast("decimal(18,6)"), 2)).cast("double").alias("shown"))


@query(f"""with {_SQL_FLAGS}
select orderkey, nullif(array_to_string(list_sort(list_distinct(list(id) filter (where hard))), '; '), '') as reason from f group by orderkey""")
def hard_fail_reason(spark: SparkSession, d: str) -> DataFrame:
    return risk.hard_reason(line_flags(spark, d).withColumn("label", F.col("id")), "orderkey")


@query(f"""with {_SQL_FLAGS}
select orderkey, id as tier, count(*) as n, round(cast(sum(cast(value as decimal(18,6))) as double), 6) as value from f group by rollup (orderkey, id) having orderkey is not null""")
def flag_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = risk.tier_groups(line_flags(spark, d).withColumn("tier", F.col("id")), "orderkey")
    return rows.withColumn("value", F.round("value", 6))


_SQL_HISTORY = """h as (select o_custkey as custkey, greatest(-12, least(12, cast(sum(cast(case when o_orderstatus = 'F' then (case when o_orderpriority in ('1-URGENT', '2-HIGH') then 3.0 else -1.0 end) * pow(0.5, date_diff('day', cast(o_orderdate as date), date '2004-01-01') / 180.0) else 0 end as decimal(28,12))) as double))) as signal from orders group by 1)"""


def customer_history(spark: SparkSession, d: str) -> DataFrame:
    urgent = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 3.0).otherwise(-1.0)
    outcomes = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.to_date("o_orderdate").alias("outcome_date"), urgent.alias("weight"), (F.col("o_orderstatus") == "F").alias("verified"))
    return risk.history_signal(outcomes, "custkey", F.lit("2004-01-01").cast("date"))


@query(f"with {_SQL_HISTORY} select custkey, round(signal, 6) as signal from h")
def history_decay(spark: SparkSession, d: str) -> DataFrame:
    return customer_history(spark, d).select("custkey", F.round("signal", 6).alias("signal"))


@query(f"""with {_SQL_FLAGS}, {_SQL_HISTORY},
s as (select o_custkey as custkey, cast(sum(cast(weight * value / 10 as decimal(28,9))) as double) as raw, bool_or(hard) as hard_failed from f join orders on o_orderkey = orderkey group by 1),
t as (select custkey, coalesce(signal, 0) as signal, greatest(0, least(100, case when hard_failed then greatest(raw + coalesce(signal, 0), 90) else raw + coalesce(signal, 0) end)) as total from s left join h using (custkey))
select custkey, round(signal, 6) as signal, round(total, 6) as total, case when total <= 34 then 'low' when total <= 69 then 'review' else 'high' end as band from t""")
def risk_with_history(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"))
    flags = line_flags(spark, d).join(orders, F.col("orderkey") == F.col("o_orderkey")).withColumn("value", F.col("value") / 10)
    rows = risk.score(flags, weightset(spark), "custkey", customer_history(spark, d))
    return rows.select("custkey", F.round("signal", 6).alias("signal"), F.round("total", 6).alias("total"), "band")


@query("select o_orderkey as orderkey, cast(round_even(o_totalprice / 1000 * 100, 0) as integer) as score_bp from orders")
def score_basis_points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), risk.basis_points(F.col("o_totalprice") / 1000).alias("score_bp"))


@query("""with t(event_type, target) as (values ('click', 30.0), ('view', 1000.0), ('none', 1.0)),
g as (select event_type, count(value) as n, median(value) as median, quantile_disc(value, 0.95) as p95 from events group by 1)
select t.event_type, cast(target as double) as target, coalesce(n, 0) as n, round(median, 6) as median, p95, case when n is null then 'designed' when p95 <= target then 'met' else 'missed' end as verdict from t left join g using (event_type)""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.createDataFrame([("click", 30.0), ("view", 1000.0), ("none", 1.0)], "event_type string, target double")
    rows = evaluation.latency(table(spark, d, "events").select("event_type", "value"), "event_type", "value", targets)
    return rows.withColumn("median", F.round("median", 6))


@query("""with t as (select lang, source, quality = 1 as genuine, toxic = 0 as accepted from labels join documents using (doc_id) where quality is not null and toxic is not null)
select lang, source, count(*) filter (where not genuine and accepted) as false_accepts, count(*) filter (where not genuine) as impostors,
  round(count(*) filter (where not genuine and accepted) / nullif(count(*) filter (where not genuine), 0)::double, 9) as far,
  count(*) filter (where genuine and not accepted) as false_rejects, count(*) filter (where genuine) as genuines,
  round(count(*) filter (where genuine and not accepted) / nullif(count(*) filter (where genuine), 0)::double, 9) as frr
from t group by grouping sets ((), (lang), (source))""")
def far_frr_groups(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    trials = table(spark, d, "labels").join(docs, "doc_id").select("lang", "source", (F.col("quality") == 1).alias("genuine"), (F.col("toxic") == 0).alias("accepted"))
    rows = evaluation.error_rates(trials, ["lang", "source"])
    return rows.withColumns({"far": F.round("far", 9), "frr": F.round("frr", 9)})


@query("""select quality, toxic, count(*) as trials, cast(count_if(doc_id % 2 = 0) as bigint) as hits, round(count_if(doc_id % 2 = 0) / count(*)::double, 9) as ratio from labels group by cube (quality, toxic)""")
def rates_by_kind(spark: SparkSession, d: str) -> DataFrame:
    hits, trials = F.count_if(F.col("doc_id") % 2 == 0), F.count(F.lit(1))
    rows = table(spark, d, "labels").cube("quality", "toxic").agg(*evaluation.rate(hits, trials))
    return rows.withColumn("ratio", F.round("ratio", 9))


@query("""with b as (select l_orderkey as orderkey, l_linenumber as line, l_quantity as l, l_linenumber as t, l_quantity + 10 as r, l_linenumber + 5 as b, lag(l_quantity) over w as pl, lag(l_linenumber) over w as pt
  from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)),
i as (select orderkey, line, greatest(0, least(r, pl + 10) - greatest(l, pl)) * greatest(0, least(b, pt + 5) - greatest(t, pt)) as shared from b where pl is not null)
select orderkey, max(round(shared / (100 - shared), 9)) as best from i group by 1""")
def iou_overlap(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    box = lambda q, n: F.struct(q.alias("left"), n.cast("double").alias("top"), (q + 10).alias("right"), (n + 5).cast("double").alias("bottom"))
    rows = table(spark, d, "lineitem").withColumns({"q": F.lag("l_quantity").over(order), "n": F.lag("l_linenumber").over(order)}).filter("q is not null")
    iou = overlap(box(F.col("l_quantity"), F.col("l_linenumber")), box(F.col("q"), F.col("n")))
    return rows.select(F.col("l_orderkey").alias("orderkey"), iou.alias("iou")).groupBy("orderkey").agg(F.max(F.round("iou", 9)).alias("best"))


@query("""select event_id, round((select count(*) from events f where f.event_type = 'click' and f.value < e.value) / (select count(*) from events where event_type = 'click')::double, 9) as rank from events e""")
def anomaly_rank(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    return evaluation.rank_below(events, events.filter("event_type = 'click'"), "value").select("event_id", F.round("rank", 9).alias("rank"))


@query("""with c as (select event_type, cast(floor(value / 10) as bigint) as level, count(*) as n from events group by 1, 2), p as (select event_type, n / sum(n) over (partition by event_type) as p from c)
select event_type, round(-sum(p * log2(p)) / log2(16), 9) as entropy from p group by 1""")
def histogram_entropy(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluation.normalised_entropy(table(spark, d, "events"), "event_type", F.floor(F.col("value") / 10), 16)
    return rows.withColumn("entropy", F.round("entropy", 9))
