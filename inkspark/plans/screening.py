"""Whole screenings over zones made from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.engine import screen
from inkspark.operators import evidence, extraction
from inkspark.plans.registry import query, table
from inkspark.plans.zones import _CHECKS, _SQL_ZONES, REFERENCE, sql_digit, zones
from inkspark.sources import seeds

_SQL_FAILED = " union all ".join(f"select id, '{f}' as field from z where try_cast(l2[{p}] as integer) <> {sql_digit(x)}" for f, x, p in _CHECKS)
_SQL_WEIGHT = "case field when 'document_number' then 65 when 'date_of_birth' then 60 when 'date_of_expiry' then 60 when 'personal_number' then 55 else 65 end"


@query(f"with {_SQL_ZONES}, f as ({_SQL_FAILED}) select z.id, count(field) as n_flags, coalesce(max(case when field is null then null else 1 end), 0) = 1 as hard_failed, cast(case when count(field) = 0 then 0 else greatest(90, least(100, sum({_SQL_WEIGHT}))) end as double) as score from z left join f using (id) group by 1")
def screen_zones(spark: SparkSession, d: str) -> DataFrame:
    got = screen(zones(spark, d), seeds.watchlist(spark), REFERENCE)
    counts = got.flags.groupBy(F.col("key").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    rows = got.scores.join(counts, "id", "left")
    return rows.select("id", F.coalesce("n", F.lit(0)).alias("n_flags"), "hard_failed", "score")


@query(f"with {_SQL_ZONES}, f as ({_SQL_FAILED}) select field, count(*) as n from f group by 1")
def check_digit_flags(spark: SparkSession, d: str) -> DataFrame:
    return evidence.from_check_digits(zones(spark, d), "id").groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_SQL_ZONES}, f as ({_SQL_FAILED}) select z.id from z where id not in (select id from f where field = 'document_number')")
def tier_survivors(spark: SparkSession, d: str) -> DataFrame:
    rows = zones(spark, d)
    return evidence.survivors(rows, "id", evidence.from_check_digits(rows, "id").filter("field = 'document_number'")).select("id")


@query("""select o_orderkey as page, 'passport_number' as field, 'PN' || lpad(cast(o_custkey as varchar), 6, '0') as value from orders union all select o_orderkey, 'date_of_birth', strftime(o_orderdate, '%Y-%m-%d') from orders""")
def printed_fields(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    day = F.upper(F.date_format("o_orderdate", "d MMM yyyy"))
    first = F.array(F.lit("Passport"), F.lit("No:"), F.concat(F.lit("pn"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")))
    second = F.concat(F.array(F.lit("Date"), F.lit("of"), F.lit("birth")), F.split(day, " "))
    rows = o.select(F.col("o_orderkey").alias("page"), F.posexplode(F.array(first, second)).alias("row", "ws")).select("page", "row", F.posexplode("ws").alias("left", "text"))
    return extraction.fields(rows, "passport")


@query("""select user_id, coalesce(avg(case when event_type <> 'error' then value / 100 end), 0) as confidence, count(case when event_type <> 'error' then 1 end) as n_words from events group by 1""")
def page_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("event_type")).otherwise(" ").alias("text"), (F.col("value") / 100).alias("confidence"))
    return extraction.mean_confidence(rows, "user_id")


@query(f"""with {_SQL_ZONES}, f as ({_SQL_FAILED}), b as (select id, count(*) as n from f where field = 'date_of_birth' group by 1), s as (select id from z where id not in (select id from b)),
e as (select id, count(*) as n from f where field = 'composite' group by 1)
select z.id as key, 'birth' as stage, coalesce(n, 0) as flags_added from z left join b using (id) union all select s.id, 'composite', coalesce(n, 0) from s left join e using (id)""")
def tier_trace(spark: SparkSession, d: str) -> DataFrame:
    from inkspark.operators import stages

    only = lambda name: lambda rows: evidence.from_check_digits(rows, "id").filter(F.col("field") == name)
    _, trace = stages.cascade(zones(spark, d), "id", [("birth", only("date_of_birth")), ("composite", only("composite"))])
    return trace.select("key", "stage", "flags_added")
