"""For iterative operators: tables between rounds, written to the folder that all executors share and read again, and sums that reach the driver."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of our own if Spark runs in this process alone, else an error: other machines wouldn't see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="textloom-"))
    return _own[0]


def kept(df: DataFrame, label: str) -> DataFrame:
    """df, written and read again; a lost executor then costs a read, not the rounds before."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def total(table: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of part(batch), `size` numbers, over all rows: within tasks, then within 32 groups of tasks, then of these on the driver. Always in the same order, as sums of floats depend on it."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                out += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["task", "sums"])

    def across(group: pa.Table) -> pa.Table:
        own = sorted(zip(group.column("task").to_pylist(), group.column("sums").to_pylist(), strict=True))
        return pa.table({"task": pa.array([own[0][0]], pa.int32()), "sums": pa.array([sum(np.frombuffer(x, np.float64) for _, x in own).tobytes()], pa.binary())})

    tasks = table.mapInArrow(within, "task int, sums binary")
    rows = tasks.groupBy(F.col("task") % 32).applyInArrow(across, "task int, sums binary").toArrow().sort_by("task")
    return sum((np.frombuffer(x, np.float64) for x in rows.column("sums").to_pylist()), np.zeros(size))
