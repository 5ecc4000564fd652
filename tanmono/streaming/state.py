"""Streams: first-event state, windowed counts with late data, and incremental ingestion."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tanmono.plans.storage import shared_dir
from tanmono.sources.subtitles import parse_srt


def stream(spark: SparkSession, pattern: str, schema) -> DataFrame:
    """Files of a pattern as a stream; new files are picked up as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 50).parquet(pattern)


def drained(rows: DataFrame, mode: str, name: str, transform: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame | None:
    """Run a stream over what is there now; what each batch gave, with its number as batch, or None if there was none.

    A batch writes only its own rows, below its number, so one that is run again after a failure overwrites itself, and the work
    grows with the rows and not with the number of batches. Whoever reads merges the batches.
    """
    spark = rows.sparkSession
    root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    kept: dict = {}

    def write(batch: DataFrame, number: int) -> None:
        out = transform(batch)
        kept["schema"] = out.schema
        out.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")

    query = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if "schema" not in kept:
        return None
    return spark.read.schema(kept["schema"].add("batch", "long")).parquet(f"{root}/rows")


def first_events(events: DataFrame, key: str, time: str) -> DataFrame:
    """(key, first_at) kept up to date: first write wins, whatever the order of arrival."""
    rows = events.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("key"), F.col(time).alias("first_at"))
    earliest = lambda x: x.groupBy("key").agg(F.min("first_at").alias("first_at"))
    found = drained(rows, "append", "first-events", earliest)
    return events.sparkSession.createDataFrame([], rows.schema) if found is None else earliest(found)


def window_counts(events: DataFrame, kind: str, time: str, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(kind, start, n): events per window, whatever the order of arrival.

    With late, a watermark lets go of the state of windows that end that long before the latest event, and events that
    arrive after that are not counted; without it, every window is kept.
    """
    timed = events.withColumn("_t", F.col(time).cast("timestamp"))
    timed = timed if late is None else timed.withWatermark("_t", late)
    counts = timed.groupBy(F.window("_t", width).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    rows = counts.select("kind", F.col("w.start").alias("start"), "n")
    found = drained(rows, "update", "windows")
    if found is None:
        return events.sparkSession.createDataFrame([], rows.schema)
    return found.groupBy("kind", "start").agg(F.max_by("n", "batch").alias("n"))


def ingested_cues(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Cues of subtitle documents as they arrive; a document that comes again replaces its cues, also by none."""

    def parsed(batch: DataFrame) -> DataFrame:
        rows = batch.select(F.col(key).alias("key")).distinct()
        cues = parse_srt(batch, key, text)
        return rows.join(cues.select("key", F.struct(*(c for c in cues.columns if c != "key")).alias("cue")), "key", "left")

    found = drained(docs.select(key, text), "append", "cues", parsed)
    if found is None:
        return parse_srt(docs.sparkSession.createDataFrame([], docs.select(key, text).schema), key, text)
    last = found.groupBy("key").agg(F.max("batch").alias("batch"))
    return found.join(last, ["key", "batch"], "left_semi").filter("cue IS NOT NULL").select("key", "cue.*")
