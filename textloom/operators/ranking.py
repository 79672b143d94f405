"""Row numbers over all rows, or within groups of any size, without gathering them in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import stages

_PLACE_BITS = 33  # of monotonically_increasing_id, the row's place within its task


def ranked(df: DataFrame, order: Sequence[Column | str], rank: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """Column `rank`, from 1, by `order` within each group of `by` (of all rows without it); nulls in `by` are one group.

    Rows are sorted by ranges, so a large group stands in several tasks, one after another. Each task's number of rows of each of
    its groups gives, summed over the tasks before, what to add to the places within the task. Ties in `order` are numbered
    as they come.
    """
    by = list(by)
    rows = stages.kept(df.orderBy(*by, *order).withColumn("_place", F.monotonically_increasing_id()), "ranked")
    rows = rows.withColumns({"_task": F.shiftright("_place", _PLACE_BITS), "_place": F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))})
    per = rows.groupBy("_task", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that holds the group
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    per = per.select(F.col("_task").alias("_t"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], (F.col("_before") - F.col("_first") + 1).alias("_add"))
    same = [F.col("_task") == F.col("_t"), *[F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]]
    out = rows.join(per if by else F.broadcast(per), reduce(lambda a, b: a & b, same))  # without groups, a row for each task
    return out.select(*df.columns, (F.col("_place") + F.col("_add")).alias(rank))
