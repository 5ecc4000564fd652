"""Session defaults shared by tests, bench and command line."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine; a cluster brings its own through spark-submit."""
    cpus = str(cpus or os.environ.get("BENCH_CPUS") or 8)
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tanmono")
    builder = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", cpus)
    builder = builder.config("spark.driver.host", "127.0.0.1")
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
