"""Cutting lineage: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Names the current version of a published table.
POINTER = "current"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; an own one only where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or getattr(spark, "_tanmono_dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tanmono-")
        spark.sparkContext.setCheckpointDir(named)
        spark._tanmono_dir = named
    return named


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table into the shared folder and read it back.

    The table survives the loss of executors and holds compressed columns, so it takes less room than
    a checkpoint of rows. It is read with the schema it was written with.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete materialized tables that no later step reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = path(shared_dir(spark)).toUri().getPath()
    for frame in frames:
        for name in frame.inputFiles()[:1]:
            folder = path(name).getParent()
            if folder.getParent().toUri().getPath() == root:
                folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def publish(df: DataFrame, path: str) -> None:
    """Write a new version of a table below its path and make it the current one in one step, by a pointer file.

    Readers, by published(), see the old or the new version as a whole and there always is one; the version before stays for readers
    that have begun, older ones go.
    """
    spark = df.sparkSession
    java, context = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = java.org.apache.hadoop.fs.Path(path)
    files, version = at.getFileSystem(context), f"v-{uuid.uuid4().hex}"
    before = _current(spark, path)
    df.write.parquet(f"{path.rstrip('/')}/{version}")
    fresh = java.org.apache.hadoop.fs.Path(at, f"_{version}")
    out = files.create(fresh)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(java.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = java.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    whole = files.makeQualified(at)
    move = java.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), context)
    move.rename(files.makeQualified(fresh), java.org.apache.hadoop.fs.Path(whole, POINTER), overwrite)
    for status in files.listStatus(at):
        if status.getPath().getName().startswith("v-") and status.getPath().getName() not in (version, before):
            files.delete(status.getPath(), True)


def _current(spark: SparkSession, path: str) -> str | None:
    java = spark.sparkContext._jvm
    at = java.org.apache.hadoop.fs.Path(path, POINTER)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.text(at.toString()).first()[0] if files.exists(at) else None


def published(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table."""
    version = _current(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing was published at {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{version}")
