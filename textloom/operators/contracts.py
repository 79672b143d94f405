"""Joins that state what they expect of their keys, and checks that tables keep their contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_key(*parts: Column) -> Column:
    """A composite key as text, blanks for nulls, joined by ||."""
    return F.concat_ws("||", *[F.trim(F.coalesce(p.cast("string"), F.lit(""))) for p in parts])


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; Spark drops the others before the shuffle where it can."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def left_deduplicated(left: DataFrame, right: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Left join to the first right row of each key: the left side keeps its rows, whatever repeats on the right."""
    return left.join(first_by(right, keys, order), keys, "left")


def left_to_dimension(df: DataFrame, dimension: DataFrame, key: str, defaults: dict[str, str]) -> DataFrame:
    """Left join to a table of labels; unmapped keys get the defaults."""
    return df.join(dimension, key, "left").na.fill(defaults)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def contract_of_many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: the right side's repeated keys and the left side's keys that it doesn't map. Both are 0 where the contract holds."""
    repeated = repeated_keys(right, keys).agg(F.count(F.lit(1)).alias("repeated_right"))
    unmapped = left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti").agg(F.count(F.lit(1)).alias("unmapped_left"))
    return repeated.join(unmapped, F.lit(True))  # one row each


def contract_of_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """As above, with the left side's repeated keys as well."""
    repeated = repeated_keys(left, keys).agg(F.count(F.lit(1)).alias("repeated_left"))
    return contract_of_many_to_one(left, right, keys).join(repeated, F.lit(True))


def holding(df: DataFrame, contract: DataFrame) -> DataFrame:
    """df, or an error that names what the one row of a contract counts."""
    counts = contract.first().asDict()
    broken = {k: n for k, n in counts.items() if n}
    if broken:
        raise ValueError(f"contract broken: {broken}")
    return df


def inner_chain(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows whose key stands in every frame."""
    return reduce(lambda a, b: a.join(b, keys), frames)


def suffixed(left: DataFrame, right: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """Left join; columns that both sides have get the suffix on the right."""
    return left.join(right.select(*[F.col(c) if c in keys else F.col(c).alias(c + suffix if c in left.columns else c) for c in right.columns]), keys, "left")


def full_comparison(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every key of either side with both values and their difference."""
    both = old.select(*keys, F.col(value).alias("old")).join(new.select(*keys, F.col(value).alias("new")), keys, "full")
    return both.withColumn("change", F.col("new") - F.col("old"))


def first_unused_match(wanted: DataFrame, rows: DataFrame, text: str, id_col: str) -> DataFrame:
    """Pairs each wanted row (pos, text) with a row of the same text, the nth of them with the nth, so that no row is taken twice."""
    nth = lambda df, order: df.withColumn("_nth", F.row_number().over(Window.partitionBy(text).orderBy(order)))
    return nth(wanted, "pos").join(nth(rows.select(text, id_col), id_col), [text, "_nth"], "left").drop("_nth")


def unexpected_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values outside a codebook, blanks among them, and how often they stand."""
    value = F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return df.select(value.alias("value")).where(~F.col("value").isin(*allowed)).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def named_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(name, passed, verdict): each check, an aggregate that is true or false; the last row, ALL, holds them together. One pass."""
    row = df.agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("passed")) for n in checks], F.struct(F.lit("ALL").alias("name"), F.expr(" AND ".join(f"`{n}`" for n in checks)).alias("passed")))
    return row.select(F.explode(listed).alias("c")).select("c.name", "c.passed", F.when(F.col("c.passed"), "PASS").otherwise("FAIL").alias("verdict"))


def conflicting(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys whose rows don't agree: how many rows and how many different ones."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.struct(*values)).alias("versions")).where("versions > 1")


def alignment(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: ids on one side only, and on both."""
    both = a.select(F.col(key), F.lit(1).alias("_a")).join(b.select(F.col(key), F.lit(1).alias("_b")), key, "full")
    n = lambda c: F.count_if(c)
    return both.agg(n(F.col("_b").isNull()).alias("only_a"), n(F.col("_a").isNull()).alias("only_b"), n(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"))


def seeded(rows: DataFrame, key: str, ok: Column, order: str) -> DataFrame:
    """For each key the first row that is ok, else the last one seen."""
    rank = F.struct((~ok).alias("bad"), F.when(ok, F.col(order)).otherwise(-F.col(order)).alias("at"))
    w = Window.partitionBy(key).orderBy(rank)
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
