"""Pivots, roll-ups and summary statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import scalars as S
from textloom.operators import quantiles


def pivot(df: DataFrame, rows: str, columns: str, values: list, cell: Column, prefix: str = "") -> DataFrame:
    """A column for each of the given values, in their order, 0 where there is no cell. The values are given, so that no pass is spent on finding them."""
    wide = df.groupBy(rows).pivot(columns, values).agg(cell).na.fill(0)
    return wide.select(rows, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def pivot_percent(df: DataFrame, rows: str, columns: str, values: list, prefix: str = "") -> DataFrame:
    """Each row's cells in percent of the row."""
    wide = pivot(df, rows, columns, values, F.count(F.lit(1)), prefix)
    names = [f"{prefix}{v}" for v in values]
    total = sum((F.col(n) for n in names), F.lit(0))
    return wide.select(rows, *[(F.col(n) * 100 / total).alias(n) for n in names])


def filled(x: Column) -> Column:
    """The value, null where it is blank."""
    return F.nullif(F.trim(x.cast("string")), F.lit(""))


def two_level(df: DataFrame, by: str, item: str) -> DataFrame:
    """For each group its distinct items, its rows, and the most rows that one item has."""
    return df.groupBy(by, item).agg(F.count(F.lit(1)).alias("n")).groupBy(by).agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("rows"), F.max("n").alias("most"))


def value_counts(df: DataFrame, listed: Column) -> DataFrame:
    """(value, n) of the values in lists separated by semicolons."""
    return df.select(F.explode(S.split_values(listed)).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def top_values_text(df: DataFrame, by: str, value: str, order: str, k: int) -> DataFrame:
    """'value: n; ...' of each group's k most frequent values; ties in order of first appearance."""
    c = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "first"))
    top = c.withColumn("rank", rank).where(F.col("rank") <= k)
    cells = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.col(value).cast("string"), F.lit(": "), F.col("n").cast("string")).alias("text"))))
    return top.groupBy(by).agg(F.array_join(F.transform(cells, lambda c: c["text"]), "; ").alias("top"))


def corpus_audit(df: DataFrame, by: str, valid: Column, posts: str, groups: str) -> DataFrame:
    """For each group: rows, valid and excluded ones, distinct posts and subgroups, blanks ignored."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("excluded"), F.countDistinct(filled(F.col(posts))).alias("posts"), F.countDistinct(filled(F.col(groups))).alias("groups"))


def outlier_rate(t: DataFrame, by: str) -> DataFrame:
    return t.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("topic") == -1).cast("double")).alias("outlier_rate"))


def spread(df: DataFrame, by: str, value: str) -> DataFrame:
    """Median and the 2.5 and 97.5 percent quantiles, exact, by linear interpolation."""
    return quantiles.quantiles(df, by, value, {"median": 0.5, "low": 0.025, "high": 0.975})


def weighted_average(df: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    return df.groupBy(by).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("average"))


def annotation_rollup(df: DataFrame, by: str, annotated: Column, positive: Column) -> DataFrame:
    """Totals, annotated and positive rows, and their rates to four places, 0 where there is nothing to divide by."""
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(annotated).alias("annotated"), F.count_if(annotated & positive).alias("positive"))
    rate = lambda a, b: F.round(S.ratio(F.col(a), F.col(b)), 4)
    return g.withColumns({"annotated_rate": rate("annotated", "total"), "positive_rate": rate("positive", "annotated")})


def meta_themes(t: DataFrame, themes: DataFrame, by: str, unmapped: str = "Unmapped") -> DataFrame:
    """Topics counted under their themes, in percent of each group's documents that have a topic, ranked within the group."""
    c = t.where("topic <> -1").join(F.broadcast(themes), "topic", "left").groupBy(by, F.coalesce("theme", F.lit(unmapped)).alias("theme")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by)
    return c.withColumns({"percent": F.col("n") * 100 / F.sum("n").over(w), "rank": F.row_number().over(w.orderBy(F.desc("n"), "theme"))})


def stance_composition(df: DataFrame, by: list[str], stance: str) -> DataFrame:
    """Each stance's rows and its percent of its group."""
    c = df.groupBy(*by, stance).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("percent", F.col("n") * 100 / F.sum("n").over(Window.partitionBy(*by)))


def robustness_summary(c: DataFrame) -> DataFrame:
    """From counts (ref, cand, n) of two partitions, -1 being outliers: topics, outlier rates and largest share of the second, agreement on who is an outlier, and overlaps of the reference topics."""
    from textloom.operators.robustness import best_overlap

    n, inside = F.col("n"), F.col("cand") != -1
    sizes = c.groupBy("cand").agg(F.sum("n").alias("n")).agg(F.count_if(inside).alias("topics"), (F.max(F.when(inside, n)) / F.sum(n)).alias("largest_share"))
    rates = c.agg((F.sum(F.when(~inside, n).otherwise(0)) / F.sum(n)).alias("outlier_rate"), (F.sum(F.when((F.col("ref") == -1) == ~inside, n).otherwise(0)) / F.sum(n)).alias("status_agreement"))
    best = best_overlap(c).select("ref", "jaccard")
    weights = c.where("ref <> -1").groupBy("ref").agg(F.sum("n").alias("w"))
    overlaps = weights.join(best, "ref", "left").withColumn("jaccard", F.coalesce("jaccard", F.lit(0.0)))
    found = overlaps.agg(F.try_divide(F.sum(F.col("jaccard") * F.col("w")), F.sum("w")).alias("weighted_jaccard"), F.median("jaccard").alias("median_jaccard"), F.count_if(F.col("jaccard") >= 0.5).alias("at_half"), F.count_if(F.col("jaccard") >= 0.33).alias("at_third"))
    return sizes.join(rates, F.lit(True)).join(found, F.lit(True))  # one row each
