"""Tables that cut lineage: written to the folder that all executors share, then read again."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, one of our own if Spark runs in this process alone, as in tests, else an error: other machines wouldn't see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="textloom-"))
    return _own[0]


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Writes df as Parquet and reads it again; a lost executor then costs a read, not the lineage."""
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    return write_table(df, new_folder(df.sparkSession, label))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished jobs now, not when the driver next happens to collect its garbage. Python tells the JVM of tables that it dropped only within a second, and one collection leaves the last job's files."""
    gc.collect()
    time.sleep(1.2)
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(0.3)
