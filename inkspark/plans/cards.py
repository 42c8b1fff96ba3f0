"""Card and visa zones (TD1, TD2), and findings of other families, made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.functions import mrz, names
from inkspark.operators import evidence, readings, reasons, regions
from inkspark.plans.registry import query, table
from inkspark.plans.zones import sql_digit

# A TD1 zone for each customer, and a TD2 zone for each order, with digits that are right by chance only.
_SQL_TD1 = """z as (select c_custkey as id, 'I<' || case when c_custkey % 17 = 0 then 'U7O' else 'UTO' end || rpad(lpad(cast(c_custkey as varchar), 7, 'C'), 9, '<') || cast(c_custkey % 10 as varchar) || rpad(upper(substr(c_mktsegment, 1, 6)), 14, '<') || cast(c_custkey % 9 as varchar) as l1,
  lpad(cast(c_custkey % 100 as varchar), 2, '0') || '0' || cast(c_custkey % 9 + 1 as varchar) || '17' || cast(c_custkey % 7 as varchar) || substr('MFX<', c_custkey % 4 + 1, 1) || '3' || cast(c_nationkey % 10 as varchar) || '1224' || case when c_custkey % 5 = 0 then '<' else cast(c_custkey % 8 as varchar) end || 'UTO' || rpad(case when c_custkey % 3 = 0 then '' else cast(c_nationkey as varchar) end, 11, '<') || cast(c_custkey % 6 as varchar) as l2,
  rpad(replace(upper(c_name), '#', '<<'), 30, '<') as l3 from customer)"""
_SQL_TD2 = """z as (select o_orderkey as id, 'V<UTO' || rpad('ORDER<OF<<' || o_custkey || '<' || o_orderstatus, 31, '<') as l1,
  rpad(lpad(cast(o_custkey as varchar), 6, 'V'), 9, '<') || cast(o_orderkey % 10 as varchar) || 'UTO' || strftime(o_orderdate, '%y%m%d') || cast(o_orderkey % 7 as varchar) || '<' || strftime(o_orderdate + interval 90 day, '%y%m%d')
  || case when o_orderkey % 11 = 0 then '<' else cast(o_orderkey % 9 as varchar) end || rpad(cast(o_orderkey % 1000 as varchar), 6, '<') || cast(o_orderkey % 8 as varchar) || cast(o_orderkey % 6 as varchar) as l2 from orders)"""


def _text(x):
    return x.cast("string")


def td1_zones(spark: SparkSession, d: str) -> DataFrame:
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    first = F.concat(
        F.lit("I<"), F.when(k % 17 == 0, "U7O").otherwise("UTO"), F.rpad(F.lpad(_text(k), 7, "C"), 9, "<"), _text(k % 10), F.rpad(F.upper(F.substring("c_mktsegment", 1, 6)), 14, "<"), _text(k % 9),
    )
    second = F.concat(
        F.lpad(_text(k % 100), 2, "0"), F.lit("0"), _text(k % 9 + 1), F.lit("17"), _text(k % 7), F.substring(F.lit("MFX<"), (k % 4 + 1).cast("int"), F.lit(1)), F.lit("3"), _text(nation % 10), F.lit("1224"),
        F.when(k % 5 == 0, "<").otherwise(_text(k % 8)), F.lit("UTO"), F.rpad(F.when(k % 3 == 0, "").otherwise(_text(nation)), 11, "<"), _text(k % 6),
    )
    third = F.rpad(F.replace(F.upper("c_name"), F.lit("#"), F.lit("<<")), 30, "<")
    return table(spark, d, "customer").select(k.alias("id"), F.array(first, second, third).alias("lines"))


def td2_zones(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey"), lambda x: F.date_format(x, "yyMMdd")
    first = F.concat(F.lit("V<UTO"), F.rpad(F.concat(F.lit("ORDER<OF<<"), _text(F.col("o_custkey")), F.lit("<"), F.col("o_orderstatus")), 31, "<"))
    second = F.concat(
        F.rpad(F.lpad(_text(F.col("o_custkey")), 6, "V"), 9, "<"), _text(k % 10), F.lit("UTO"), day(F.col("o_orderdate")), _text(k % 7), F.lit("<"), day(F.col("o_orderdate") + F.expr("interval 90 days")),
        F.when(k % 11 == 0, "<").otherwise(_text(k % 9)), F.rpad(_text(k % 1000), 6, "<"), _text(k % 8), _text(k % 6),
    )
    return table(spark, d, "orders").select(k.alias("id"), F.array(first, second).alias("lines"))


def _sql_verdicts(zones: str, checks: list[tuple[str, str, str]]) -> str:
    """Printed and computed digit of each check (field, what it covers, where its digit stands)."""
    each = " union all ".join(f"select id, '{f}' as field, try_cast({at} as integer) as expected, {sql_digit(x)} as found from z" for f, x, at in checks)
    return f"with {zones}, v as ({each}) select *, expected = found as passed from v"


def _verdicts(zones: DataFrame) -> DataFrame:
    parsed = mrz.parse(zones)
    return parsed.select("id", F.explode(mrz.verdicts(parsed)).alias("v")).select("id", "v.*")


@query(_sql_verdicts(_SQL_TD1, [
    ("document_number", "l1[6:14]", "l1[15]"), ("date_of_birth", "l2[1:6]", "l2[7]"), ("date_of_expiry", "l2[9:14]", "l2[15]"), ("optional_data_1", "l1[16:29]", "l1[30]"),
    ("composite", "(l1[1:10] || l1[15:30] || l2[1:7] || l2[9:15] || l2[19:29])", "l2[30]"),
]))
def mrz_td1_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(td1_zones(spark, d))


@query(_sql_verdicts(_SQL_TD2, [
    ("document_number", "l2[1:9]", "l2[10]"), ("date_of_birth", "l2[14:19]", "l2[20]"), ("date_of_expiry", "l2[22:27]", "l2[28]"), ("optional_data", "l2[29:34]", "l2[35]"),
    ("composite", "(l1[6:36] || l2[1:10] || l2[14:20] || l2[22:35])", "l2[36]"),
]))
def mrz_td2_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(td2_zones(spark, d))


_SQL_NAME = """array_to_string(list_filter(string_split(split_part({n}, '<<', 1), '<'), lambda w: w <> ''), ' ') as surname, array_to_string(list_filter(string_split(substr({n}, instr({n}, '<<') + 2), '<'), lambda w: w <> ''), ' ') as given_names"""


@query(f"""with {_SQL_TD1} select id, 'TD1' as format, l1[1:2] as document_code, l1[3:5] as issuing_state, l1[6:14] as document_number, l2[1:6] as date_of_birth, l2[8] as sex, l2[9:14] as date_of_expiry, l2[16:18] as nationality,
  rtrim(replace(l1[16:29], '<', ' ')) as optional_data_1, rtrim(replace(l2[19:29], '<', ' ')) as optional_data_2 from z""")
def mrz_parse_td1(spark: SparkSession, d: str) -> DataFrame:
    parsed = mrz.parse(td1_zones(spark, d))
    optional = [mrz.optional_data(F.col(c), c).alias(c) for c in ("optional_data_1", "optional_data_2")]
    return parsed.select("id", "format", "document_code", "issuing_state", "document_number", "date_of_birth", "sex", "date_of_expiry", "nationality", *optional)


@query(f"""with {_SQL_TD2} select id, 'TD2' as format, l1[1:2] as document_code, l1[3:5] as issuing_state, l2[1:9] as document_number, l2[11:13] as nationality, l2[14:19] as date_of_birth, l2[21] as sex, l2[22:27] as date_of_expiry, l2[29:34] as optional_data, {_SQL_NAME.format(n="l1[6:36]")} from z""")
def mrz_parse_td2(spark: SparkSession, d: str) -> DataFrame:
    parsed = mrz.parse(td2_zones(spark, d)).withColumn("parts", mrz.name_parts(F.col("name")))
    return parsed.select("id", "format", "document_code", "issuing_state", "document_number", "nationality", "date_of_birth", "sex", "date_of_expiry", "optional_data", "parts.surname", "parts.given_names")


@query(f"""with {_SQL_TD1} select id, l1[1:2] in ('I<', 'I') as code_ok, regexp_full_match(l1[3:5], '[A-Z]{{3}}') as state_ok, l1[6:14] ~ '[^<]' as number_ok, regexp_full_match(l2[8], '[MF<]') as sex_ok, regexp_full_match(l2[9:14], '[0-9]{{6}}') as expiry_ok from z""")
def mrz_td1_fields(spark: SparkSession, d: str) -> DataFrame:
    ok = mrz.valid_fields("TD1")
    shown = {"code_ok": "document_code", "state_ok": "issuing_state", "number_ok": "document_number", "sex_ok": "sex", "expiry_ok": "date_of_expiry"}
    return mrz.parse(td1_zones(spark, d)).select("id", *(ok[f].alias(c) for c, f in shown.items()))


@query(f"""with {_SQL_TD2} select id, l1[1:2] in ('V<', 'V') as code_ok, regexp_full_match(l1[3:5], '[A-Z]{{3}}') as state_ok, regexp_full_match(l2[11:13], '[A-Z]{{3}}') as nationality_ok, regexp_full_match(l2[21], '[MF<]') as sex_ok, regexp_full_match(l2[14:19], '[0-9]{{6}}') as birth_ok from z""")
def mrz_td2_fields(spark: SparkSession, d: str) -> DataFrame:
    ok = mrz.valid_fields("TD2")
    shown = {"code_ok": "document_code", "state_ok": "issuing_state", "nationality_ok": "nationality", "sex_ok": "sex", "birth_ok": "date_of_birth"}
    return mrz.parse(td2_zones(spark, d)).select("id", *(ok[f].alias(c) for c, f in shown.items()))


# Findings of other families


_SQL_MODULES = "case l_linenumber % 6 when 0 then 'ela' when 1 then 'noise_residual' when 2 then 'copy_move' when 3 then 'stamp' when 4 then 'morph' else 'deepfake' end"
_SQL_MODULE_FLAG = "case l_linenumber % 6 when 0 then 'TAMPER_ELA_ANOMALY' when 1 then 'TAMPER_NOISE_RESIDUAL_ANOMALY' when 2 then 'TAMPER_COPY_MOVE_ANOMALY' when 3 then 'TAMPER_STAMP_ANOMALY' when 4 then 'TAMPER_MORPH_SUSPECTED' else 'TAMPER_DEEPFAKE_SUSPECTED' end"


def module_results(spark: SparkSession, d: str) -> DataFrame:
    """A deep module's result for each line of an order; scores reach beyond one."""
    n, q = F.col("l_linenumber") % 6, F.col("l_quantity").cast("double")
    module = F.get(F.array(*map(F.lit, ["ela", "noise_residual", "copy_move", "stamp", "morph", "deepfake"])), n)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), module.alias("module"), (q / 40).alias("score"), (q > 30).alias("suspect"))


@query(f"select l_orderkey as key, {_SQL_MODULE_FLAG} as id, {_SQL_MODULES} as label, round(least(1, l_quantity / 40.0::double), 9) as value from lineitem where l_quantity > 30")
def module_flags(spark: SparkSession, d: str) -> DataFrame:
    return evidence.from_modules(module_results(spark, d), "page").select("key", "id", "label", F.round("value", 9).alias("value"))


@query(f"""with f as (select l_orderkey as key, {_SQL_MODULE_FLAG} as id, count(*) as n from lineitem where l_quantity > 30 group by 1, 2), r(id, reason) as (values {", ".join("('" + i + "', '" + s.replace("'", "''") + "')" for i, s in reasons.REASONS)})
select key, id, n, reason from f left join r using (id)""")
def flag_reasons(spark: SparkSession, d: str) -> DataFrame:
    flags = evidence.from_modules(module_results(spark, d), "page").groupBy("key", "id").agg(F.count(F.lit(1)).alias("n"))
    return reasons.with_reason(flags).select("key", "id", "n", "reason")


_SQL_KIND = "case o_orderkey % 3 when 0 then 'blacklist' when 1 then 'stolen_document' else 'identity_seen' end"


@query("""select o_orderkey as key, case o_orderkey % 3 when 0 then 'WATCHLIST_HIT' when 1 then 'WATCHLIST_STOLEN_DOCUMENT' else 'WATCHLIST_IDENTITY_SEEN' end as id, case when o_orderkey % 3 < 2 then 'document_number' end as field, o_orderkey % 3 = 0 as hard from orders where o_orderpriority = '1-URGENT'""")
def watchlist_flags(spark: SparkSession, d: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ["blacklist", "stolen_document", "identity_seen"])), (F.col("o_orderkey") % 3).cast("int"))
    hits = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("page"), kind.alias("kind"))
    return evidence.from_watchlist(hits, "page").select("key", "id", "field", "hard")


@query(f"""with f as (select l_orderkey as page, {_SQL_MODULE_FLAG} as id, {_SQL_MODULES} as label, round(least(1, l_quantity / 40.0::double), 2) as value from lineitem where l_quantity > 30)
select o_orderkey as page, case when o_orderstatus = 'F' then 'high' else 'low' end as band, coalesce(len(l), 0) as n, array_to_string(list_transform(l, lambda x: x.id || '=' || x.value), ',') as flags
from orders left join (select page, list({{'id': id, 'label': label, 'value': value}} order by id, label, value) as l from f group by 1) on page = o_orderkey""")
def payload_documents(spark: SparkSession, d: str) -> DataFrame:
    """The JSON of each screening's flags and band, read again."""
    flags = evidence.from_modules(module_results(spark, d), "page").withColumn("value", F.round("value", 2))
    scores = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"), F.when(F.col("o_orderstatus") == "F", "high").otherwise("low").alias("band"))
    got = F.from_json("payload", "band string, flags array<struct<id:string,label:string,field:string,value:double,expected:string,found:string>>")
    rows = evidence.payload(flags, scores, "page").select("page", got.alias("p"))
    listed = F.array_join(F.transform("p.flags", lambda x: F.concat(x["id"], F.lit("="), x["value"].cast("string"))), ",")
    return rows.select("page", "p.band", F.size("p.flags").cast("long").alias("n"), F.when(F.size("p.flags") > 0, listed).alias("flags"))


# Printed fields against a zone


@query("""with p as (select o_orderkey as document, 'N' || o_custkey as number, strftime(o_orderdate, '%Y-%m-%d') as born, 'ORDER ' || o_orderstatus || ' ' || o_custkey as name from orders),
z as (select document, case when document % 4 = 0 then 'M' || number[2:] else number end as number, case when document % 5 = 0 then '000101' else replace(born[3:], '-', '') end as born, case when document % 6 = 0 then 'OTHER ORDER' else 'ORDER' end as surname, name[7:] as given from p where document % 7 <> 0)
select document as key, 'passport_number' as field, z.number as expected, p.number as found from p join z using (document) where z.number <> p.number
union all select document, 'date_of_birth', z.born, p.born from p join z using (document) where z.born <> replace(p.born[3:], '-', '')
union all select document, 'name', '4 name words', '3 agree' from p join z using (document) where surname = 'OTHER ORDER'""")
def zone_findings(spark: SparkSession, d: str) -> DataFrame:
    k, born = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    number, given = F.concat(F.lit("N"), _text(F.col("o_custkey"))), F.concat_ws(" ", "o_orderstatus", _text(F.col("o_custkey")))
    fields = [("passport_number", number), ("date_of_birth", born), ("name", F.concat(F.lit("ORDER "), given))]
    o = table(spark, d, "orders")
    printed = o.select(k.alias("document"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in fields))).alias("f")).select("document", "f.*")
    zone = o.filter(k % 7 != 0).select(
        k.alias("document"), F.when(k % 6 == 0, "OTHER<ORDER").otherwise("ORDER").alias("surname"), F.replace(given, F.lit(" "), F.lit("<")).alias("given_names"),
        F.when(k % 4 == 0, F.concat(F.lit("M"), _text(F.col("o_custkey")))).otherwise(number).alias("document_number"), F.when(k % 5 == 0, "000101").otherwise(F.date_format("o_orderdate", "yyMMdd")).alias("date_of_birth"),
        F.lit(None).cast("string").alias("date_of_expiry"),
    )
    return readings.against_zone(printed, zone).select("key", "field", "expected", "found")


@query("""with n as (select p_partkey, string_split(p_name, ' ') as a, list_reverse(string_split(p_name, ' ')) as b, string_split(lag(p_name) over (partition by p_brand order by p_partkey), ' ') as c from part)
select p_partkey, case when a = b then 0 else 2 end as turned, case when c is null then null when a = c then 0 when a[1] = c[1] or a[2] = c[2] then 1 else 2 end as other from n""")
def word_distance(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance in words, to the same words turned round and to the brand's part before."""
    from pyspark.sql import Window

    rows = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("a"), F.split(F.lag("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey")), " ").alias("c"))
    return rows.select("p_partkey", names.token_distance(F.col("a"), F.reverse("a")).alias("turned"), F.when(F.col("c").isNotNull(), names.token_distance(F.col("a"), F.col("c"))).alias("other"))


@query("""select p_brand as field, count(*) as n, cast(max(p_size) + 1 as double) as tolerance from part group by 1""")
def field_tolerances(spark: SparkSession, d: str) -> DataFrame:
    """A template's fields, one a brand, each with its tolerance; none may lack one."""
    part = table(spark, d, "part")
    template = part.select(F.col("p_brand").alias("field"), "p_partkey")
    given = part.groupBy(F.col("p_brand").alias("field")).agg((F.max("p_size") + 1).cast("double").alias("tolerance"))
    return regions.tolerances(template, given).join(template.groupBy("field").agg(F.count(F.lit(1)).alias("n")), "field").select("field", "n", "tolerance")
