"""Exact quantiles of groups of any size, by refining histograms.

A quantile lies between two rows of the group's order. For each of these an interval of values is kept that holds it, and the
number of rows below. A pass counts the interval's rows in BINS bins, within tasks first, with each bin's least and
greatest value; the bin that holds the wanted row is the next interval. A bin of one value ends the search, and one of few
rows is sorted. No group's values meet in one place, and only counts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import stages

BINS = 2048
#: An interval of so few rows is sorted instead of refined.
FEW = 2048


def quantiles(df: DataFrame, by: str, value: str, at: dict[str, float]) -> DataFrame:
    """One row for each group: `by`, and for each name its quantile, linear between rows. Null values don't count; a group of nulls alone has nulls."""
    rows = df.select(F.col(by).alias("g"), F.col(value).cast("double").alias("x"))
    ends = stages.kept(rows.groupBy("g").agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")), "ends")
    place = F.array(*[F.lit(q) * (F.col("n") - 1) for q in at.values()])
    wanted = ends.where("n > 0").select("g", "low", "high", "n", F.explode(F.array_distinct(F.concat(F.transform(place, lambda p: F.floor(p)), F.transform(place, lambda p: F.ceil(p))))).alias("row"))
    # `row` counts from 0 within the interval that begins at `low`; `k` within the group.
    wanted = wanted.select("g", F.col("row").alias("k"), "low", "high", "n", "row")
    rows, found = rows.where("x IS NOT NULL"), None
    for _ in range(1100):
        wanted = stages.kept(wanted, "wanted")
        done = wanted.where("low = high").select("g", "k", F.col("low").alias("x"))
        few = wanted.where((F.col("low") < F.col("high")) & (F.col("n") <= FEW))
        wanted = wanted.where((F.col("low") < F.col("high")) & (F.col("n") > FEW))
        spans = few.select("g", "low", "high").distinct()
        inside = (F.col("g").eqNullSafe(F.col("h"))) & F.col("x").between(F.col("low"), F.col("high"))
        lists = rows.join(spans.withColumnRenamed("g", "h"), inside).groupBy("h", "low", "high").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # FEW values each
        lists = lists.select("h", F.col("low").alias("l"), F.col("high").alias("u"), "xs")
        sorted_out = few.join(lists, F.col("g").eqNullSafe(F.col("h")) & (F.col("low") == F.col("l")) & (F.col("high") == F.col("u"))).select("g", "k", F.get("xs", F.col("row").cast("int")).alias("x"))
        one = stages.kept(done.union(sorted_out), "found")
        found = one if found is None else found.union(one)
        if wanted.isEmpty():
            break
        spans = wanted.select(F.col("g").alias("h"), "low", "high").distinct()
        share = (F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)  # halves don't overflow
        bins = rows.join(spans, inside).withColumn("bin", F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        bins = bins.groupBy("h", "low", "high", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("new_low"), F.max("x").alias("new_high"))
        below = Window.partitionBy("h", "low", "high").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows
        bins = bins.withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0)))
        bins = bins.select("h", F.col("low").alias("l"), F.col("high").alias("u"), "n", "new_low", "new_high", "below")
        here = F.col("g").eqNullSafe(F.col("h")) & (F.col("low") == F.col("l")) & (F.col("high") == F.col("u")) & (F.col("row") >= F.col("below")) & (F.col("row") < F.col("below") + F.col("m"))
        wanted = wanted.drop("n").join(bins.withColumnRenamed("n", "m"), here).select("g", "k", F.col("new_low").alias("low"), F.col("new_high").alias("high"), F.col("m").alias("n"), (F.col("row") - F.col("below")).alias("row"))
    values = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("v"))  # two for each quantile
    values = values.select(F.col("g").alias("h"), "v")
    joined = ends.join(values, F.col("g").eqNullSafe(F.col("h")), "left")
    out = [F.col("g").alias(by)]
    for name, q in at.items():
        p = F.lit(q) * (F.col("n") - 1)
        low, high = (F.try_element_at("v", f(p)) for f in (F.floor, F.ceil))
        out.append((low + (high - low) * (p - F.floor(p))).alias(name))
    return joined.select(*out)
