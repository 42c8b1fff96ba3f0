"""Sealed contents, stored events, templates, checked values and other single records, made from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.functions import geometry, text
from inkspark.operators import evidence, extraction, risk, runs, screenings
from inkspark.plans.registry import query, table
from inkspark.sources import blobs, reports, seeds
from inkspark.sources.store import Store
from inkspark.stored import shared_folder


@query("""select sha256(coalesce(text, '')) as digest, cast(min(strlen(coalesce(text, ''))) as bigint) as size, true as ok, sha256(coalesce(text, ''))[1:8] || ':' || length(coalesce(any_value(text), '')) as seen from documents group by sha256(coalesce(text, '')), length(coalesce(text, ''))""")
def sealed_contents(spark: SparkSession, d: str) -> DataFrame:
    """Each text sealed under a data key of its own, and opened again."""
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = table(spark, d, "documents").select(content.alias("content")).withColumn("data_key", F.unhex(F.sha2(F.concat(F.lit("key of "), "content"), 256)))
    opened = blobs.opened(blobs.sealed(rows, bytes(range(32))), bytes(range(32)))
    seen = F.concat(F.substring("digest", 1, 8), F.lit(":"), F.char_length(F.decode("content", "UTF-8")).cast("string"))
    return opened.select("digest", "size", "ok", seen.alias("seen"))


_SQL_STORED = """'{"actor":"user-' || user_id || '","event_type":"officer_decision","payload":{"action":"' || event_type || '"},"screening_id":"s' || event_id % 100 || '"}'"""


@query(f"""select 'e' || event_id as id, 's' || event_id % 100 as screening_id, sha256(unhex(md5(cast(event_id as varchar))) || encode({_SQL_STORED})) as record_hash from events where event_type = 'click'""")
def stored_events(spark: SparkSession, d: str) -> DataFrame:
    """Decisions sealed and appended to a store, twice, and read from it."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    k = F.col("event_id").cast("string")
    rows = table(spark, d, "events").filter("event_type = 'click'").select(
        F.concat(F.lit("e"), k).alias("id"), F.concat(F.lit("s"), (F.col("event_id") % 100).cast("string")).alias("screening_id"), F.lit("officer_decision").alias("event_type"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("actor"), F.concat(F.lit('{"action":"'), "event_type", F.lit('"}')).alias("payload"), F.md5(k).alias("record_salt"), F.col("ts").cast("timestamp").alias("created_at"),
    )
    store.emit(rows)
    store.emit(rows)
    return store.read("events").select("id", "screening_id", "record_hash")


@query("""select p_brand as brand, p_partkey as x, p_size as width, case when p_size % 10 = 0 then 'empty' when p_partkey + case when p_size % 10 = 0 then 0 else p_size end > 1000 then 'outside' end as fault from part""")
def layout_templates(spark: SparkSession, d: str) -> DataFrame:
    """Templates in JSON, one a brand, read again with what is wrong with each box."""
    width = F.when(F.col("p_size") % 10 == 0, 0).otherwise(F.col("p_size"))
    box = F.struct(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("field"), F.col("p_partkey").cast("int").alias("x"), F.lit(0).alias("y"), width.cast("int").alias("width"), F.lit(10).alias("height"))
    texts = table(spark, d, "part").groupBy("p_brand").agg(F.to_json(F.struct(F.lit(1000).alias("reference_width"), F.lit(10).alias("reference_height"), F.collect_list(box).alias("fields"))).alias("value"))
    rows = seeds.layout_template(texts)
    parts = F.split("field", "/")
    return rows.select(F.get(parts, 0).alias("brand"), F.col("x").cast("long").alias("x"), F.get(parts, 1).cast("int").alias("width"), "fault")


@query("""select label, count(*) as n, round(sum(cast(embedding[1] as double)), 6) as first, round(sum(cast(embedding[3] as double)), 6) as third from embeddings group by 1""")
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a JSON matrix, one a label, as named columns."""
    row = F.array(F.col("label").cast("double"), *(F.get("embedding", i).cast("double") for i in range(3)))
    texts = table(spark, d, "embeddings").groupBy("label").agg(F.to_json(F.collect_list(row)).alias("value"))
    rows = seeds.feature_rows(texts, ["label", "first", "second", "third"]).groupBy(F.col("label").cast("int").alias("label"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("first"), 6).alias("first"), F.round(F.sum("third"), 6).alias("third"))


@query("""select o_orderkey as id, case when o_orderkey % 5 > 0 then 'v' || o_orderkey % 7 end as prompt_version, 'Say ' || o_orderpriority || chr(10) || 'of ' || o_orderstatus as body from orders""")
def prompt_texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    head = F.concat(F.lit("# "), F.when(k % 5 > 0, F.concat(F.lit("prompt_version: v"), (k % 7).cast("string"))).otherwise("no version"), F.lit("\n# a note\n\n"))
    body = F.concat(F.lit("Say "), "o_orderpriority", F.lit("\nof "), "o_orderstatus", F.lit("\n# end\n"))
    rows = table(spark, d, "orders").select(k.alias("id"), F.concat(head, body).alias("value"))
    return seeds.prompts(rows.select(F.concat("value", F.lit("\u0001"), F.col("id").cast("string")).alias("value"))).select(
        F.element_at(F.split("body", "\u0001"), -1).cast("long").alias("id"), "prompt_version", F.btrim(F.element_at(F.split("body", "\u0001"), 1), F.lit("\n")).alias("body")
    )


@query("""select o_orderkey as id, '{"request_id":"r' || o_orderkey || '","status":' || o_orderkey % 5 * 100 || ',"path":"/' || o_orderstatus || '"}' as line from orders""")
def log_records(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select((k % 5 * 100).cast("long").alias("status"), F.concat(F.lit("/"), "o_orderstatus").alias("path"), F.concat(F.lit("r"), k.cast("string")).alias("request_id"))
    lines = reports.log_lines(rows, ["request_id"])
    return lines.select(F.substring(F.get_json_object("value", "$.request_id"), F.lit(2), F.lit(20)).cast("long").alias("id"), F.col("value").alias("line"))


@query("select o_orderkey as id, o_orderstatus as status from orders")
def one_status(spark: SparkSession, d: str) -> DataFrame:
    return screenings.exactly_one(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), "id", "status")


@query("""select o_orderkey as id, unnest([0, 1, 2]) as position, unnest(['a_reader', 'b_face', 'c_text']) as model, unnest([o_orderpriority, o_orderstatus, cast(o_custkey as varchar)]) as version from orders""")
def model_versions(spark: SparkSession, d: str) -> DataFrame:
    """Maps of versions, of which each order has two, merged and read as rows by name."""
    one = F.create_map(F.lit("c_text"), F.col("o_custkey").cast("string"), F.lit("a_reader"), F.col("o_orderpriority"))
    both = evidence.merged(one, F.create_map(F.lit("b_face"), F.col("o_orderstatus")))
    return evidence.model_rows(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), both.alias("model_versions")), "id")


@query("""select p_partkey as id, lower(p_name) as label from part""")
def label_keys(spark: SparkSession, d: str) -> DataFrame:
    """Labels as printed, with points, capitals and double spaces, folded."""
    printed = F.concat(F.lit(" . "), F.upper(F.replace("p_name", F.lit(" "), F.lit(" \t "))), F.lit(" :, "))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), extraction.label_key(printed).alias("label"))


@query("""select event_id as id, case when contains(coalesce(props, ''), cast(user_id as varchar)) then 'user ' || user_id else 'plain' end as said, case when event_id % 3 = 0 then 'none' when event_type = 'view' then 'view.' || event_id else 'none' end as request_id from events""")
def narrations(spark: SparkSession, d: str) -> DataFrame:
    """A text is kept if the printed data bear it out, an id if its characters are those of one."""
    user, k = F.col("user_id").cast("string"), F.col("event_id")
    asked = F.when(k % 3 == 0, F.repeat(F.lit("x"), 65)).when(F.col("event_type") == "view", F.concat(F.lit("view."), k.cast("string"))).otherwise("two words")
    printed = F.coalesce("props", F.lit(""))
    return table(spark, d, "events").select(k.alias("id"), text.narration(F.concat(F.lit("user "), user), printed, F.lit("plain")).alias("said"), text.request_id(asked, F.lit("none")).alias("request_id"))


@query("""select o_orderkey as entry, case when o_orderkey % 11 = 0 then 'entry_id' when o_orderkey % 4 = 3 then 'kind' when (o_orderkey % 4 = 2) <> (o_orderstatus = 'F') then 'matched_on' end as fault from orders""")
def watchlist_faults(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.get(F.array(*map(F.lit, ["blacklist", "stolen_document", "identity_seen", "other"])), (k % 4).cast("int"))
    hits = table(spark, d, "orders").select(k.alias("entry"), F.concat(F.lit("E-"), k.cast("string"), F.when(k % 11 == 0, " x").otherwise("")).alias("entry_id"), kind.alias("kind"), F.when(F.col("o_orderstatus") == "F", "identity").otherwise("document_number").alias("matched_on"))
    return evidence.hit_faults(hits).select("entry", "fault")


@query("""select l_orderkey as id, l_linenumber as n, l_linenumber <> 2 and l_linenumber <> 3 and l_linenumber <> 4 as finite from lineitem""")
def finite_values(spark: SparkSession, d: str) -> DataFrame:
    n, x = F.col("l_linenumber"), F.col("l_quantity").cast("double")
    value = F.when(n == 2, float("nan")).when(n == 3, float("-inf")).when(n != 4, x)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), n.alias("n"), geometry.finite(value).alias("finite"))


@query("""select vec_id, round(cast(embedding[1] as double) / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 9) as first, 1.0::double as length from embeddings""")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", geometry.unit(F.col("embedding")).alias("v"))
    return rows.select("vec_id", F.round(F.get("v", 0), 9).alias("first"), F.round(geometry.norm(F.col("v")), 9).alias("length"))


# Scores again from stored flags


@query("""select l_orderkey as key, round(sum(case l_returnflag when 'A' then 4 when 'N' then 2.5 else 1 end * l_discount), 6) as r1 from lineitem where l_linestatus = 'O' group by 1""")
def partial_scores(spark: SparkSession, d: str) -> DataFrame:
    """The sum of one tier's flags alone."""
    flags = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("id"), F.col("l_discount").cast("double").alias("value"), F.lit(False).alias("hard"), F.when(F.col("l_linestatus") == "O", "tier1").otherwise("tier2").alias("tier"))
    return risk.partial(flags, _weights(spark), "key", "tier1").select("key", F.round("r1", 6).alias("r1"))


def _weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("A", 4.0, "high"), ("N", 2.5, "review"), ("R", 1.0, "low")], "id string, weight double, band string")


@query("""select l_orderkey as key, l_returnflag as id, round(case l_returnflag when 'A' then 4 when 'N' then 2.5 else 1 end * l_discount, 9) as contribution from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus <> 'P'""")
def recomputed_contributions(spark: SparkSession, d: str) -> DataFrame:
    """Contributions of stored screenings; those without a ruleset have none."""
    stored = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", "rules-1").alias("ruleset_version"))
    flags = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("position"), F.col("l_returnflag").alias("id"), F.col("l_discount").cast("double").alias("value"))
    return runs.contributions_of(stored, flags, _weights(spark), "rules-1").select("key", "id", F.round("contribution", 9).alias("contribution"))
