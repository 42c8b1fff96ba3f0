"""A session with the settings that the engine's results depend on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "inkspark", cpus: int | None = None, **conf: str) -> SparkSession:
    """Local session; on a cluster, pass the master and sizes in ``conf``.

    Time zone UTC and ANSI mode fix the meaning of dates and casts. Adaptive
    execution is on: it splits skewed join partitions and merges small ones.
    """
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    settings = {
        "spark.master": f"local[{cpus}]",
        "spark.app.name": app,
        "spark.driver.memory": "12g",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def share_package(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver has it.

    On a cluster, install it on the executors or pass it with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
