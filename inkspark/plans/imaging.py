"""Image operators on planes made of the embeddings: an 8x8 vector, each value a square of 8x8 pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.operators import vision
from inkspark.plans.registry import query, table


def planes(spark: SparkSession, d: str) -> DataFrame:
    """One 64x64 plane a vector, level 128 + 256 * value."""
    level = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.round(x.cast("double") * 256).cast("int") + 128))
    byte = lambda x: F.repeat(F.lpad(F.hex(level(x)), 2, "0"), 8)
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.repeat(F.array_join(F.transform(F.slice("embedding", i * 8 + 1, 8), byte), ""), 8))
    data = F.unhex(F.array_join(rows, ""))
    image = F.struct(F.lit(64).alias("height"), F.lit(64).alias("width"), F.lit(1).alias("nChannels"), data.alias("data"))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), image.alias("image"))


@query("""with p as (select vec_id as id, list_transform(embedding, lambda x: greatest(0, least(255, cast(round(x::double * 256) as int) + 128))) as l from embeddings)
select id, round(list_sum(l) / 64.0::double, 6) as mean, round(len(list_filter(l, lambda x: x <= 5)) / 64.0::double, 6) as dark, round(len(list_filter(l, lambda x: x >= 250)) / 64.0::double, 6) as bright from p""")
def quality_exposure(spark: SparkSession, d: str) -> DataFrame:
    return vision.exposure(planes(spark, d), "id").select("id", *(F.round(c, 6).alias(c) for c in ("mean", "dark", "bright")))


@query()
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return vision.quality(planes(spark, d), "id")


@query()
def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    return vision.quality_flags(vision.quality(planes(spark, d), "id"), "id")


@query()
def ela_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return vision.heat(planes(spark, d), "id", "ela")


@query()
def noise_map(spark: SparkSession, d: str) -> DataFrame:
    return vision.heat(planes(spark, d), "id", "noise")


@query()
def copy_moves(spark: SparkSession, d: str) -> DataFrame:
    return vision.copy_moves(planes(spark, d), "id").groupBy("id").agg(F.count(F.lit(1)).alias("pairs"))


@query()
def glyph_components(spark: SparkSession, d: str) -> DataFrame:
    return vision.glyph_components(planes(spark, d), "id")


@query()
def face_suspicion(spark: SparkSession, d: str) -> DataFrame:
    return vision.suspicion(planes(spark, d), "id")


@query()
def anomaly_forest(spark: SparkSession, d: str) -> DataFrame:
    return vision.anomalies(planes(spark, d), "id")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """A made-up page for each supplier: three document types, clean or with one of four kinds of tampering."""
    from inkspark.functions.pages import FORMATS, TAMPERING
    from inkspark.sources.made_pages import made_pages

    k = F.col("s_suppkey")
    kind = F.get(F.array(*map(F.lit, FORMATS)), (k % 3).cast("int"))
    tampering = F.when(k % 5 > 0, F.array(F.get(F.array(*map(F.lit, TAMPERING)), (k % 5 - 1).cast("int"))))
    return made_pages(table(spark, d, "supplier").select(k.alias("id"), kind.alias("document_type"), tampering.alias("tampering")).repartition(32))


@query("select ['TD3', 'TD2', 'TD1'][s_suppkey % 3 + 1] as format, count(*) as pages, count(*) as zones_right, count(*) as manifests_right from supplier group by 1")
def zones_read(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose zone is read letter by letter as it was printed, clean and tampered ones."""
    from inkspark.functions.pages import font

    # What was printed goes along with the page, which is made once.
    read = vision.zones(corpus(spark, d), "id", font(), ("manifest", "problems"))
    rows = read.withColumn("m", F.from_json("manifest", "format string, mrz_lines array<string>"))
    return rows.groupBy("m.format").agg(F.count(F.lit(1)).alias("pages"), F.count_if((F.col("form") == F.col("m.format")) & (F.col("lines") == F.col("m.mrz_lines"))).alias("zones_right"), F.count_if(F.size("problems") == 0).alias("manifests_right"))


@query("""with p as (select s_suppkey % 5 as k, count(*) as n from supplier group by 1) select ['', 'text_edit', 'date_of_birth_change', 'photo_replacement', 'stamp_edit'][k + 1] as kind, n, case when k in (1, 2) then n else 0 end as with_text from p where k > 0""")
def tampering_truth(spark: SparkSession, d: str) -> DataFrame:
    """What was changed on the pages, from their manifests."""
    shape = "tampering array<struct<kind:string,field:string,original:string,replacement:string>>"
    rows = corpus(spark, d).select(F.explode(F.from_json("manifest", shape)["tampering"]).alias("t")).select("t.*")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("field").isNotNull()) & (F.col("original") != F.col("replacement"))).alias("with_text"))
