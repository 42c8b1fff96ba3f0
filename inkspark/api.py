"""The service's answers as DataFrames: lists, details, progress, decisions, verification, errors and versions.

No server is here. A request is a call, or a row of a table of requests; an
answer is a table whose columns are the response's fields (``RESPONSES``), so a
batch of requests is answered by one plan.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.functions.hashing import canonical, json_text
from inkspark.operators import anchoring, audit, runs, screenings, vision
from inkspark.operators.weights import RULESET_VERSION
from inkspark.sources.store import Store

APP_VERSION, PROMPT_VERSION = "0.2.0", "v1"
# Codes of refusals with status and sentence, and the decisions of an officer.
ERRORS = {code: (413 if "LARGE" in code else 415 if "MEDIA" in code else 422, text) for code, text in vision.REJECTS.items()} | {
    "SCREENING_NOT_FOUND": (404, "That screening could not be found."),
    "SCREENING_UNREADABLE": (500, "This result could not be read. Please try again later."),
    "INVALID_REQUEST": (422, "The request payload is invalid."),
    "INTERNAL_ERROR": (500, "The request could not be completed."),
}
ACTIONS = ["allow", "further_inspection", "reject"]
#: Fields of the responses.
RESPONSES = {
    "screening": "id string, status string, document_type string, created_at timestamp, image struct<width:int,height:int>, score double, band string, ruleset_version string, model_versions map<string,string>, summary string, flags array<struct<position:bigint,id:string,label:string,value:double>>, stage_trace array<struct<stage:bigint,tier:string,elapsed_ms:bigint>>, contributions array<struct<position:int,id:string,value:double,weight:double,contribution:double>>",
    "item": "id string, created_at timestamp, document_type string, status string, score double, band string",
    "decision": "screening_id string, action string, override boolean, error_code string",
    "verification": "id string, status string, batch bigint, checked array<string>",
    "progress": "id string, document string",
    "error": "status int, error struct<code:string,message:string>",
    "request": "request_id string, method string, path string, status int, elapsed_ms bigint",
}


@dataclass(frozen=True)
class Settings:
    """What a deployment sets, read from a mapping (as a rule the environment) and checked."""

    app_env: str = "development"
    log_level: str = "INFO"
    rate_limit_per_minute: int = 60
    cors_origins: tuple[str, ...] = field(default=())
    evidence_store_root: str | None = None
    local_llm_enabled: bool = False
    local_llm_timeout_seconds: float = 20.0

    @classmethod
    def of(cls, values: Mapping[str, str] | None = None) -> Settings:
        values = os.environ if values is None else values
        got = lambda name, default: values.get(name, default).strip()
        env, level, flag = got("APP_ENV", cls.app_env), got("LOG_LEVEL", cls.log_level).upper(), got("LOCAL_LLM_ENABLED", "false").lower()
        if env not in ("development", "test", "production"):
            raise ValueError("APP_ENV is development, test or production")
        if level not in ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"):
            raise ValueError("LOG_LEVEL is no level")
        if flag not in ("true", "false", "1", "0"):
            raise ValueError("LOCAL_LLM_ENABLED is true or false")
        limit, seconds = int(got("RATE_LIMIT_PER_MINUTE", str(cls.rate_limit_per_minute))), float(got("LOCAL_LLM_TIMEOUT_SECONDS", str(cls.local_llm_timeout_seconds)))
        if limit < 1 or not 0 < seconds < float("inf"):
            raise ValueError("limits are above zero")
        origins = tuple(o.strip() for o in got("CORS_ORIGINS", "").split(",") if o.strip())
        if any(o == "*" for o in origins) and env == "production":
            raise ValueError("production names its origins")
        return cls(env, level, limit, origins, values.get("EVIDENCE_STORE_ROOT") or None, flag in ("true", "1"), seconds)


@dataclass(frozen=True)
class Handles:
    """What answers are made from, handed in and never global: the session, the tables, the blobs' folder, the settings."""

    spark: SparkSession
    store: Store
    blobs: str | None = None
    settings: Settings = field(default_factory=Settings)

    def ready(self) -> DataFrame:
        """Whether the tables answer; an error of theirs is an answer, too."""
        try:
            return health(self.spark, self.store.ready())
        except Exception:
            return health(self.spark, False)


def error_of(code: Column) -> Column:
    """status and {code, message} of a refusal's code; null for none. A code that isn't known is an internal error."""
    table = F.create_map(*(F.lit(x) if not isinstance(x, tuple) else F.struct(F.lit(x[0]).alias("status"), F.lit(x[1]).alias("message")) for kv in ERRORS.items() for x in kv))
    known = F.when(code.isin(list(ERRORS)), code).otherwise(F.lit("INTERNAL_ERROR"))
    found = table[known]
    return F.when(code.isNotNull(), F.struct(found["status"].alias("status"), F.struct(known.alias("code"), found["message"].alias("message")).alias("error")))


def analyses(uploads: DataFrame, report: DataFrame, key: str = "id") -> DataFrame:
    """Answer to each upload (id, fault): its error, or the quality verdict and the failed checks of its image."""
    rows = uploads.join(vision.quality_verdict(report, key), key, "left")
    return rows.select(key, error_of(F.col("fault")).alias("refused"), F.when(F.col("fault").isNull(), F.struct("mode", "passed", "failed")).alias("quality"))


def screening_list(rows: DataFrame, offset: int = 0, limit: int = screenings.DEFAULT_PAGE, **filters) -> tuple[DataFrame, DataFrame]:
    """A page of the live rows that meet the filters, and how many there are in all."""
    found = screenings.matching(rows, **filters)
    return screenings.page(found, offset, limit).select(*(c for c in ("id", "created_at", "document_type", "status", "score", "band") if c in rows.columns)), found.agg(F.count(F.lit(1)).alias("total"))


def by_created(rows: DataFrame, newest_first: bool = False) -> DataFrame:
    """Rows by the text of their moment, one way or the other; equal ones by id."""
    text = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return rows.orderBy(text.desc() if newest_first else text.asc(), "id")


def documents_of(rows: DataFrame, ids: list) -> DataFrame:
    """The documents that a case names, in its order; one that isn't live is a row without columns."""
    wanted = rows.sparkSession.createDataFrame([(i, str(x)) for i, x in enumerate(ids)], "position int, wanted string")
    return wanted.join(screenings.live(rows).withColumn("__id", F.col("id").cast("string")), F.col("wanted") == F.col("__id"), "left").drop("__id").orderBy("position")


def _listed(rows: DataFrame, key: str, order: str, columns: list[str], name: str) -> DataFrame:
    """A row's own list: as many as it has flags or stages."""
    return rows.groupBy(F.col(key).alias("__key")).agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in columns if c != order)))).alias(name))


def details(rows: DataFrame, flags: DataFrame, trace: DataFrame, contributions: DataFrame) -> DataFrame:
    """Whole live screenings, with lists of flags (key, position, id, label, value), stages (key, stage, tier, elapsed_ms) and contributions (key, position, ...)."""
    out = screenings.live(rows)
    for part, order, columns, name in ((flags, "position", ["id", "label", "value"], "flags"), (trace, "stage", ["tier", "elapsed_ms"], "stage_trace"), (contributions, "position", ["id", "value", "weight", "contribution"], "contributions")):
        listed = _listed(part, "key", order, columns, name)
        out = out.join(listed, out["id"] == listed["__key"], "left").drop("__key").withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))
    image = [F.struct(F.col("image_width").alias("width"), F.col("image_height").alias("height")).alias("image")] if "image_width" in rows.columns else []
    return out.select(*(c for c in out.columns if c not in ("image_width", "image_height", "deleted_at")), *image)


def detail(rows: DataFrame, asked: DataFrame, *parts: DataFrame) -> DataFrame:
    """The details of asked ids; one that isn't live has the error of a missing screening."""
    whole = details(rows, *parts)
    known = whole.withColumnRenamed("id", "__id").withColumn("__there", F.lit(True))
    out = asked.select("id").distinct().join(known, F.col("id") == F.col("__id"), "left")
    return out.withColumn("refused", error_of(F.when(F.col("__there").isNull(), "SCREENING_NOT_FOUND"))).drop("__id", "__there")


def progress_documents(events: DataFrame, key: str) -> DataFrame:
    """Each run as one JSON document: its id, how many events, and the events in order."""
    one = canonical({"id": F.col("id").cast("string"), "type": json_text(F.col("type"))})
    listed = F.array_sort(F.collect_list(F.struct("created_at", "id", one.alias("e"))))
    rows = events.groupBy(key).agg(listed.alias("l"))
    texts = F.array_join(F.transform("l", lambda x: x["e"]), ",")
    return rows.select(key, F.concat(F.lit('{"count":'), F.size("l").cast("string"), F.lit(',"events":['), texts, F.lit('],"id":'), F.col(key).cast("string"), F.lit("}")).alias("document"))


def progress_steps(documents: DataFrame, key: str) -> DataFrame:
    """The steps of progress documents, in order; a document that can't be read has none."""
    parsed = F.from_json("document", "count int, events array<struct<id:bigint,type:string>>, id bigint")
    return documents.select(key, F.posexplode(parsed["events"]).alias("step", "e")).select(key, "step", "e.id", "e.type")


def trace_documents(trace: DataFrame, key: str) -> DataFrame:
    """Stages of runs (stage, tier, elapsed_ms) as one JSON document each, with their sum."""
    listed = F.array_sort(F.collect_list(F.struct("stage", "tier", "elapsed_ms")))
    return trace.groupBy(key).agg(F.to_json(F.struct(listed.alias("stages"), F.sum("elapsed_ms").alias("total_ms"))).alias("document"))


def decisions(requests: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers to decisions (screening_id, action, override, created_at), and the events they leave: the decision, and an override where one was needed.

    An action that isn't known, and a rejection against the system without
    ``override``, are refused; so is a screening that isn't live.
    """
    live = screenings.live(rows).select(F.col("id").alias("__id"), "band")
    asked = requests.join(live, requests["screening_id"] == live["__id"], "left").withColumn("__against", audit.contradicts("action", "band"))
    code = F.when(F.col("__id").isNull(), "SCREENING_NOT_FOUND").when(~F.coalesce(F.col("action").isin(ACTIONS), F.lit(False)) | (F.col("__against") & ~F.coalesce("override", F.lit(False))), "INVALID_REQUEST")
    asked = asked.withColumn("error_code", code)
    answers = asked.select("screening_id", "action", (F.col("error_code").isNull() & F.col("__against")).alias("override"), "error_code")
    taken = asked.filter(F.col("error_code").isNull())
    decided = taken.select("screening_id", F.lit("officer_decision").alias("event_type"), canonical({"action": json_text(F.col("action"))}).alias("payload"), "created_at")
    return answers, decided.unionByName(runs.override_events(taken.select("screening_id", "action", "band", "created_at")))


def verifications(verified: DataFrame, asked: DataFrame) -> DataFrame:
    return anchoring.explained(verified, asked)


def version(spark: SparkSession, models: dict[str, str] | None = None) -> DataFrame:
    """Versions of the application, the ruleset, the prompt and the models."""
    return spark.createDataFrame([(APP_VERSION, RULESET_VERSION, PROMPT_VERSION, dict(models or {}))], "app string, ruleset string, prompt string, models map<string,string>")


def health(spark: SparkSession, ready: bool | None = None) -> DataFrame:
    """ok, and, if the tables were asked, whether they answered."""
    return spark.createDataFrame([("ok", "unknown" if ready is None else "ready" if ready else "not_ready")], "status string, storage string")


def with_request_id(rows: DataFrame, given: str = "request_id") -> DataFrame:
    """Requests under the id they came with, if it is one, else a new one."""
    return rows.withColumn("request_id", F.when(F.col(given).rlike(r"^[A-Za-z0-9._:-]{1,64}$"), F.col(given)).otherwise(F.expr("uuid()")))


def request_log(requests: DataFrame) -> DataFrame:
    """One row a request (request_id, method, path, status, started, ended), without the query, whole milliseconds."""
    path = F.regexp_extract("path", r"^[^?#]*", 0)
    elapsed = F.greatest(F.lit(0), F.bround((F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1000)).cast("long")
    return requests.select("request_id", F.upper("method").alias("method"), path.alias("path"), "status", elapsed.alias("elapsed_ms"))
