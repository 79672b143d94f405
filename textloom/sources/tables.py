"""Sources and sinks: all-string CSV, tolerant and strict JSON lines, optional inputs, manifests."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def string_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Every column as text, blanks as '', a byte order mark tolerated."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)  # by the file's own header, whatever its order
    names = {c.lstrip("\ufeff"): c for c in df.columns}
    return df.select(*[(F.col(f"`{names[c]}`") if c in names else F.lit("")).alias(c) for c in columns]).na.fill("")


def json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def optional(spark: SparkSession, path: str, schema: T.StructType, read) -> DataFrame:
    """read(spark, path), or an empty table where nothing is at the path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    return read(spark, path) if there else spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns in a fixed order; missing ones are blank, others are left out."""
    have = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in columns}
    df.select(*[v.alias(c) for c, v in have.items()]).write.csv(path, header=True, escape='"', mode="overwrite")


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files under a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def completed(spark: SparkSession, path: str, schema: T.StructType, labels: str, status: str = "completion_status") -> DataFrame:
    """JSON lines whose status is 'completed', the struct of labels flattened into columns."""
    df = json_lines(spark, path, schema).where(F.lower(F.trim(status)) == "completed")
    return df.select(*[c for c in df.columns if c != labels], f"{labels}.*")


def by_header(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Columns of a sheet (a table whose header was read as names) by any of their spellings; case, blanks and signs don't count."""
    plain = lambda x: "".join(ch for ch in x.lower() if ch.isalnum())
    have = {}
    for c in df.columns:
        have.setdefault(plain(c), c)
    found = {name: next((have[plain(s)] for s in [name, *spellings] if plain(s) in have), None) for name, spellings in wanted.items()}
    if missing := sorted(n for n, c in found.items() if c is None):
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in found.items()])


def vectors(spark: SparkSession, path: str, id_col: str, vector: str) -> DataFrame:
    """(id, vector) of a Parquet table of dense vectors, as array<float>; only these two columns are read."""
    return spark.read.parquet(path).select(id_col, F.col(vector).cast("array<float>").alias(vector))


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """A workbook as a folder: one CSV folder a sheet."""
    for name, df in sheets.items():
        df.write.csv(f"{folder}/{name}", header=True, escape='"', mode="overwrite")


def metric_rows(df: DataFrame) -> DataFrame:
    """One row of metrics as rows (metric, value), values as text, blank for null, in the order of the columns."""
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("metric"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("value")) for i, c in enumerate(df.columns)])
    return df.select(F.explode(cells).alias("c")).select("c.place", "c.metric", "c.value")
