"""Machine-readable zones and their dates, made from orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.functions import dates, mrz
from inkspark.plans.registry import query, table

REFERENCE = "1998-08-02"
_VALUE = "case when {c} = '<' then 0 when instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', {c}) > 0 then instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', {c}) - 1 end"


def sql_digit(x: str) -> str:
    """The check digit in DuckDB; a sum over a list skips nulls, so unreadable texts are told apart first."""
    value = _VALUE.format(c=f"({x})[i]")
    return f"case when regexp_full_match({x}, '[0-9A-Z<]*') then cast(coalesce(list_sum(list_transform(range(1, length({x}) + 1), lambda i: ({value}) * [7, 3, 1][(i - 1) % 3 + 1])), 0) % 10 as integer) end"


_SQL_ZONES = """z as (select o_orderkey as id, 'P<UTO' || rpad(replace(upper(c_name), '#', '<<'), 39, '<') as l1,
  rpad(lpad(cast(o_custkey as varchar), 7, 'A'), 9, '<') || cast(o_orderkey % 10 as varchar) || 'UTO' || strftime(o_orderdate, '%y%m%d') || cast(o_orderkey % 7 as varchar) || 'F' || strftime(o_orderdate + interval 400 day, '%y%m%d')
  || case when o_orderkey % 11 = 0 then '<' else cast(o_orderkey % 9 as varchar) end || rpad(cast(o_orderkey as varchar), 14, '<') || cast(o_orderkey % 8 as varchar) || cast(o_orderkey % 6 as varchar) as l2 from orders join customer on c_custkey = o_custkey)"""


def zones(spark: SparkSession, d: str) -> DataFrame:
    """A TD3 zone for each order, with digits that are right by chance only."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    text = lambda x: x.cast("string")
    key = F.col("o_orderkey")
    first = F.concat(F.lit("P<UTO"), F.rpad(F.replace(F.upper("c_name"), F.lit("#"), F.lit("<<")), 39, "<"))
    day = lambda x: F.date_format(x, "yyMMdd")
    second = F.concat(
        F.rpad(F.lpad(text(F.col("o_custkey")), 7, "A"), 9, "<"), text(key % 10), F.lit("UTO"), day(F.col("o_orderdate")), text(key % 7), F.lit("F"), day(F.col("o_orderdate") + F.expr("interval 400 days")),
        F.when(key % 11 == 0, "<").otherwise(text(key % 9)), F.rpad(text(key), 14, "<"), text(key % 8), text(key % 6),
    )
    return o.select(key.alias("id"), F.array(first, second).alias("lines"))


@query(f"with {_SQL_ZONES} select id, {sql_digit('l2[1:9]')} as document_number, {sql_digit('l2[14:19]')} as date_of_birth, {sql_digit('l1[3:20]')} as line_1 from z")
def mrz_check_digit(spark: SparkSession, d: str) -> DataFrame:
    part = lambda line, a, b: mrz.check_digit(mrz.span(F.col("lines"), line, a, b))
    return zones(spark, d).select("id", part(2, 1, 9).alias("document_number"), part(2, 14, 19).alias("date_of_birth"), part(1, 3, 20).alias("line_1"))


_CHECKS = [("document_number", "l2[1:9]", 10), ("date_of_birth", "l2[14:19]", 20), ("date_of_expiry", "l2[22:27]", 28), ("personal_number", "l2[29:42]", 43), ("composite", "(l2[1:10] || l2[14:20] || l2[22:43])", 44)]


@query(
    f"with {_SQL_ZONES}, v as ("
    + " union all ".join(f"select id, '{f}' as field, try_cast(l2[{p}] as integer) as expected, {sql_digit(x)} as found from z" for f, x, p in _CHECKS)
    + ") select *, expected = found as passed from v"
)
def mrz_td3_verdicts(spark: SparkSession, d: str) -> DataFrame:
    parsed = mrz.parse(zones(spark, d))
    return parsed.select("id", F.explode(mrz.verdicts(parsed)).alias("v")).select("id", "v.*")


@query(
    f"""with {_SQL_ZONES}, n as (select *, l1[6:44] as name from z)
select id, 'TD3' as format, l1[1:2] as document_code, l1[3:5] as issuing_state, l2[1:9] as document_number, l2[11:13] as nationality, l2[21] as sex,
  array_to_string(list_filter(string_split(split_part(name, '<<', 1), '<'), lambda w: w <> ''), ' ') as surname,
  array_to_string(list_filter(string_split(substr(name, instr(name, '<<') + 2), '<'), lambda w: w <> ''), ' ') as given_names, replace(name, '<', '') as compact from n"""
)
def mrz_parse_td3(spark: SparkSession, d: str) -> DataFrame:
    parsed = mrz.parse(zones(spark, d)).withColumn("parts", mrz.name_parts(F.col("name")))
    return parsed.select("id", "format", "document_code", "issuing_state", "document_number", "nationality", "sex", "parts.surname", "parts.given_names", mrz.compact_name(F.col("name")).alias("compact"))


@query("""select o_orderkey as id, case o_orderkey % 4 when 0 then 'TD3' when 1 then 'TD2' when 2 then 'TD1' end as format from orders""")
def mrz_format(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey") % 4
    width = F.when(key == 0, 44).when(key == 1, 36).when(key == 2, 30).otherwise(31)
    line = F.rpad(F.lit("P"), 50, "<")
    line = F.substring(line, F.lit(1), width)
    lines = F.when(key == 2, F.array(line, line, line)).otherwise(F.array(line, line))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), mrz.detect_format(lines).alias("format"))


@query(f"""with {_SQL_ZONES} select id, l2[14:19] ~ '^[0-9]{{6}}$' as birth_ok, l2[11:13] ~ '^[A-Z]{{3}}$' as nationality_ok, l2[1:9] ~ '[^<]' as number_ok from z""")
def mrz_field_checks(spark: SparkSession, d: str) -> DataFrame:
    checks = mrz.valid_fields("TD3")
    return mrz.parse(zones(spark, d)).select("id", checks["date_of_birth"].alias("birth_ok"), checks["nationality"].alias("nationality_ok"), checks["document_number"].alias("number_ok"))


_REF = f"date '{REFERENCE}'"


@query(f"""with e as (select o_orderkey as id, case when o_orderkey % 13 = 0 then null else cast(o_orderdate as date) end as expiry, cast(o_orderdate as date) - 700 as issue from orders)
select id, case when expiry is null then 'undetermined' when expiry < {_REF} then 'expired' when expiry = {_REF} then 'expiring_today' else 'valid' end as status,
  case when issue > {_REF} then 'not_yet_valid' else 'issued' end as issued, case when expiry is null then 'undetermined' when issue > expiry then 'issue_after_expiry' else 'consistent' end as sequence from e""")
def expiry_status(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 13 != 0, day).alias("expiry"), F.date_sub(day, 700).alias("issue"))
    at = F.lit(REFERENCE).cast("date")
    return rows.select("id", dates.expiry_status(F.col("expiry"), at).alias("status"), dates.issue_status(F.col("issue"), at).alias("issued"), dates.order_status(F.col("issue"), F.col("expiry")).alias("sequence"))


@query(f"""with y as (select o_orderkey as id, lpad(cast(o_orderkey % 100 as varchar), 2, '0') || lpad(cast(o_orderkey % 13 as varchar), 2, '0') || lpad(cast(o_orderkey % 32 as varchar), 2, '0') as t from orders),
c as (select *, cast(try_strptime('19' || t, '%Y%m%d') as date) as this, cast(try_strptime('18' || t, '%Y%m%d') as date) as last, cast(try_strptime('20' || t, '%Y%m%d') as date) as next from y)
select id, case when cast(t[3:4] as int) not between 1 and 12 then 'month' when cast(t[5:6] as int) < 1 or cast(t[5:6] as int) > case when cast(t[3:4] as int) in (4, 6, 9, 11) then 30 when cast(t[3:4] as int) = 2 then 29 else 31 end then 'day' end as fault,
  coalesce(case when this <= {_REF} and this + interval 120 year >= {_REF} then this end, case when last <= {_REF} and last + interval 120 year >= {_REF} then last end) as birth,
  coalesce(case when this >= {_REF} then this end, case when next >= {_REF} then next end) as expiry from c""")
def birth_year_inference(spark: SparkSession, d: str) -> DataFrame:
    two = lambda n: F.lpad((F.col("o_orderkey") % n).cast("string"), 2, "0")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(two(100), two(13), two(32)).alias("t"))
    at = F.lit(REFERENCE).cast("date")
    return rows.select("id", dates.date_fault(F.col("t")).alias("fault"), dates.birth_date(F.col("t"), at).alias("birth"), dates.expiry_date(F.col("t"), at).alias("expiry"))


@query(f"""select o_orderkey as id, case when cast(o_orderdate as date) > {_REF} or cast(o_orderdate as date) + interval 120 year < {_REF} then 'implausible' else 'plausible' end as birth,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as utc, case when o_orderkey % 3 = 0 then o_orderpriority else strftime(o_orderdate, '%Y-%m-%d') end as printed from orders""")
def record_dates(spark: SparkSession, d: str) -> DataFrame:
    printed = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.upper(F.date_format("o_orderdate", "d MMM yyyy")))
    at = F.lit(REFERENCE).cast("date")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), dates.birth_status(F.to_date("o_orderdate"), at).alias("birth"), dates.utc_text(F.col("o_orderdate")).alias("utc"), dates.printed_date(printed).alias("printed"))
