"""A content-addressed, encrypted store as a table: digest, size, sealed."""

from __future__ import annotations

import base64
import binascii
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = b"inkspark-blob-1:"


def reference(digest: Column, size: Column) -> Column:
    """sha256:<digest>:<size>"""
    return F.concat(F.lit("sha256:"), digest, F.lit(":"), size.cast("string"))


def parsed_reference(text: Column) -> Column:
    """digest and size of a reference; null if it isn't one."""
    shape = r"^sha256:([0-9a-f]{64}):(0|[1-9][0-9]*)$"
    return F.when(text.rlike(shape), F.struct(F.regexp_extract(text, shape, 1).alias("digest"), F.regexp_extract(text, shape, 2).cast("long").alias("size")))


def distinct_content(rows: DataFrame, key: str, content: str = "content") -> DataFrame:
    """One row for each content: digest, size, number of copies and least key.

    Digests are grouped, not contents, so bytes aren't shuffled.
    """
    digests = rows.select(key, F.sha2(content, 256).alias("digest"), F.octet_length(content).cast("long").alias("size"))
    return digests.groupBy("digest").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_key"))


def sealed(rows: DataFrame, master_key: bytes, content: str = "content", data_key: str = "data_key") -> DataFrame:
    """Contents under a data key each, and that key under the master key: AES-256-GCM, the digest authenticated."""
    digest = F.sha2(content, 256)
    bound = F.concat(F.lit(TAG), F.encode(digest, "UTF-8"))
    seal = lambda what, key: F.aes_encrypt(what, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), bound)
    wrapped = seal(F.col(data_key), F.lit(master_key))
    return rows.select(digest.alias("digest"), F.octet_length(content).cast("long").alias("size"), wrapped.alias("wrapped_key"), seal(F.col(content), F.col(data_key)).alias("body")).drop_duplicates(["digest"])


def opened(store: DataFrame, master_key: bytes) -> DataFrame:
    """Contents of sealed rows; ok only if size and digest are right. What can't be opened has null content."""
    bound = F.concat(F.lit(TAG), F.encode("digest", "UTF-8"))
    key = F.try_aes_decrypt("wrapped_key", F.lit(master_key), F.lit("GCM"), F.lit("DEFAULT"), bound)
    rows = store.withColumn("__key", key).withColumn("content", F.try_aes_decrypt("body", "__key", F.lit("GCM"), F.lit("DEFAULT"), bound))
    right = (F.octet_length("content") == F.col("size")) & (F.sha2("content", 256) == F.col("digest"))
    return rows.withColumn("ok", F.coalesce(right, F.lit(False))).drop("__key")


def added(store: DataFrame, new: DataFrame) -> DataFrame:
    """New rows whose digest isn't stored yet."""
    return new.join(store.select("digest"), "digest", "left_anti")


def blob_files(spark: SparkSession, folder: str) -> DataFrame:
    """digest, path and size of a folder's blobs by name; files of other names aren't blobs. Contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.blob").load(folder).select("path", F.col("length").alias("size"))
    digest = F.regexp_extract("path", r"/([0-9a-f]{64})\.blob$", 1)
    return files.select(digest.alias("digest"), "path", "size").filter("digest <> ''").orderBy("digest")


def write_atomically(spark: SparkSession, path: str, body: bytes) -> None:
    """A small file, whole or not at all: written beside its name, then renamed. It isn't for tables, whose writes Spark commits."""
    jvm, target = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = files.create(beside, False)
    try:
        out.write(bytearray(body))
        out.hsync()
    finally:
        out.close()
    # One step that puts the new file over the old one, so there is always one of the two.
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    try:
        context.rename(beside, target, options)
    except Exception:
        files.delete(beside, False)
        raise


def master_key(configured: str | None, environment: str) -> bytes:
    """32 bytes from base64. Without one production refuses to start; elsewhere a new one lasts as long as the process."""
    if not configured:
        if environment == "production":
            raise ValueError("production needs a master key")
        return os.urandom(32)
    try:
        key = base64.b64decode(configured.strip(), validate=True)
    except (binascii.Error, ValueError):
        raise ValueError("the master key isn't base64") from None
    if len(key) != 32:
        raise ValueError("a master key has 32 bytes")
    return key
