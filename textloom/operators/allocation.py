"""Stratified samples: shares by square roots, apportioned to an exact sum, and rows drawn for them with a cap by post.

Shares that are rounded and clamped miss their sum. Rows are then taken one by one from the largest share, or given to the stratum
with the most rows left, ties going by name. That levels the values from the top: down to some level L all that are higher, and
the first few by name one below it. Level and rest follow from the histogram of values and its running sums, in closed form;
no loop and no list of strata on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import ranking
from textloom.operators.relational import md5_order


def levelled(values: DataFrame, by: str, name: str, value: str, excess: str, floor: int) -> DataFrame:
    """values (by, name, value, excess) with `value` lowered by `excess` in all within each group, always the largest first, of equals the first by name, and none below `floor`; what can't be taken is left."""
    steps = values.where(F.col(value) > floor).groupBy(by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"), F.max(excess).alias("e"))
    down = Window.partitionBy(by).orderBy(F.desc("v"))  # distinct values, far fewer than strata
    above = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumns({"n": F.sum("c").over(above), "s": F.sum(F.col("c") * F.col("v")).over(above), "below": F.coalesce(F.lead("v").over(down), F.lit(floor))})
    # Lowering all to L, between a value and the one below it, takes s - n L.
    steps = steps.where(F.col("s") - F.col("n") * F.col("v") <= F.col("e"))
    level = steps.groupBy(by).agg(F.min_by(F.struct("n", "s", "below", "e"), "v").alias("x")).select(by, "x.*")
    level = level.withColumn("_level", F.greatest(F.ceil((F.col("s") - F.col("e")) / F.col("n")), F.col("below")))
    level = level.select(by, "_level", F.when(F.col("_level") > floor, F.col("e") - F.col("s") + F.col("n") * F.col("_level")).otherwise(0).alias("_rest"))
    joined = values.join(level, by, "left").withColumn("_high", F.coalesce(F.col(value) >= F.col("_level"), F.lit(False)))
    first = ranking.ranked(joined, [F.desc("_high"), name], "_nth", [by])
    lowered = F.when(F.col("_high"), F.col("_level") - (F.col("_nth") <= F.col("_rest")).cast("long")).otherwise(F.col(value))
    return first.withColumn(value, lowered).drop("_level", "_rest", "_high", "_nth")


def sqrt_allocation(sizes: DataFrame, by: str, name: str, n: str, target: Column) -> DataFrame:
    """sizes (by, name, n) with `share`: target in proportion to the square roots of n (halves to even), at least 1, at most n; then exact, if the group has so many rows and no more strata than target. target is one number for a group. Strata without rows are left out."""
    rows = sizes.where(F.col(n) > 0).withColumn("_target", target.cast("long"))
    total = rows.groupBy(by).agg(F.sum(F.sqrt(n)).alias("_root"), F.sum(n).alias("_all"))
    rows = rows.join(total, by).withColumn("_target", F.least("_target", "_all"))
    rows = rows.withColumn("share", F.least(F.greatest(F.bround(F.col("_target") * F.sqrt(n) / F.col("_root")).cast("long"), F.lit(1)), F.col(n)))
    sums = rows.groupBy(by).agg(F.sum("share").alias("_sum"))
    rows = rows.join(sums, by).withColumns({"_over": F.greatest(F.col("_sum") - F.col("_target"), F.lit(0)), "_under": F.greatest(F.col("_target") - F.col("_sum"), F.lit(0))})
    rows = levelled(rows, by, name, "share", "_over", 1)
    left = levelled(rows.withColumn("_gap", F.col(n) - F.col("share")), by, name, "_gap", "_under", 0)
    return left.withColumn("share", F.col(n) - F.col("_gap")).select(*sizes.columns, "share")


def _drawn(df: DataFrame, strata: list[str], post: str, id_col: str, cap: int, seed: str, most: str) -> DataFrame:
    """In md5 order at most `most` rows of each stratum: at most `cap` of a post first, then those beyond it."""
    order = [md5_order(seed, id_col), F.col(id_col)]
    nth = F.row_number().over(Window.partitionBy(*strata, post).orderBy(*order))
    rows = df.withColumn("beyond", (nth > cap).cast("int"))
    return ranking.ranked(rows, ["beyond", *order], "_rank", strata).where(F.col("_rank") <= F.col(most)).drop("_rank")


def stratified_sample(df: DataFrame, group: str, stratum: str, post: str, id_col: str, target: int, cap: int, seed: str, shares: DataFrame | None = None) -> DataFrame:
    """`target` rows of each group (all, if it has fewer), shared among its strata by square roots; with `beyond`, 1 where a row exceeds the cap of its post.

    shares (group, stratum, share) may be given instead; where they draw fewer rows than target, rows of the group's other ones fill up. Where there
    are more strata than target, the first by name count. Null groups, strata and posts count as ''; rows without an id are left out.
    """
    rows = df.where(F.col(id_col).isNotNull()).withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (group, stratum, post)})
    if shares is None:
        sizes = rows.groupBy(group, stratum).agg(F.count(F.lit(1)).alias("n"))
        shares = sqrt_allocation(sizes, group, stratum, "n", F.lit(target))
    first = _drawn(rows.join(shares.select(group, stratum, "share"), [group, stratum]), [group, stratum], post, id_col, cap, seed, "share").drop("share")
    have = first.groupBy(group).agg(F.count(F.lit(1)).alias("_have"))
    missing = rows.select(group).distinct().join(have, group, "left").select(group, (F.lit(target) - F.coalesce("_have", F.lit(0))).alias("_missing")).where("_missing > 0")
    rest = rows.join(first.select(id_col), id_col, "left_anti").join(missing, group)
    more = _drawn(rest, [group], post, id_col, cap, seed, "_missing").drop("_missing")
    both = first.withColumn("_late", F.lit(0)).unionByName(more.withColumn("_late", F.lit(1)))
    cut = ranking.ranked(both, ["_late", stratum, "beyond", md5_order(seed, id_col), id_col], "_rank", [group])
    return cut.where(F.col("_rank") <= target).drop("_rank", "_late")
