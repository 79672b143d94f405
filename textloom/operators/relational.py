"""Relational helpers: contracts, shares, caps, dense grids, unions and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, each of whose keys must be unique: a repeated one fails the query that reads it."""
    seen = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not seen.isEmpty():
        raise ValueError(f"keys {keys} are not unique")
    return df


def with_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def share(df: DataFrame, value: str, by: list[str], out: str, scale: float = 1.0) -> DataFrame:
    total = F.sum(value).over(Window.partitionBy(*by))
    return df.withColumn(out, F.coalesce(F.try_divide(F.col(value) * F.lit(scale), total), F.lit(0.0)))


def first_k(df: DataFrame, by: list[str], order: list[Column], k: int | Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1; Spark limits each group before the shuffle where k is a number."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def dense_grid(df: DataFrame, rows: DataFrame, cols: DataFrame, value: str) -> DataFrame:
    """Every combination of two small dimension tables, 0 where df has none."""
    keys = rows.columns + cols.columns
    return rows.crossJoin(F.broadcast(cols)).join(df, keys, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def top_n_and_rest(df: DataFrame, name: str, value: str, n: int, rest: str) -> DataFrame:
    top = [r[0] for r in df.groupBy(name).agg(F.sum(value).alias("v")).orderBy(F.desc("v"), name).limit(n).select(name).collect()]  # n names
    return df.withColumn(name, F.when(F.col(name).isin(*top), F.col(name)).otherwise(rest)).groupBy(name).agg(F.sum(value).alias(value))


def union_tagged(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """All frames under each other with a column naming the source; a column that one lacks is null there."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def pending(source: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of source that aren't done: what a resumed run still has to do."""
    return source.join(done.select(*keys), keys, "left_anti")


def flag_members(df: DataFrame, members: DataFrame, key: str, out: str) -> DataFrame:
    marked = members.select(key).distinct().withColumn(out, F.lit(1))
    return df.join(marked, key, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def md5_order(seed: str, *ids: str) -> Column:
    """An order that looks random and is the same on every engine and partitioning."""
    return F.md5(F.concat_ws("#", F.lit(seed), *[F.col(i).cast("string") for i in ids]).cast("binary"))
