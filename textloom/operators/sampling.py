"""Deterministic samples: square-root allocation, caps by post, balanced and disjoint samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import ranking
from textloom.operators.relational import md5_order


def sqrt_allocation(sizes: dict[str, int], target: int) -> dict[str, int]:
    """Shares of target in proportion to the square roots of the sizes, at least 1, at most the size, summing to the target if that can be."""
    if not sizes:
        return {}
    root = sum(math.sqrt(n) for n in sizes.values())
    out = {k: min(max(round(target * math.sqrt(n) / root), 1), n) for k, n in sizes.items()}
    target = min(target, sum(sizes.values()))
    while (total := sum(out.values())) != target:
        if total > target:
            most = min(out, key=lambda k: (-out[k], k))
            if out[most] <= 1:
                break
            out[most] -= 1
        else:
            gap = min(out, key=lambda k: (out[k] - sizes[k], k))
            out[gap] += 1
    return out


def capped_sample(df: DataFrame, by: list[str], post: str, id_col: str, cap: int, size: int, seed: str) -> DataFrame:
    """size rows of each group in md5 order, at most cap of a post; where that is too few, rows beyond the cap fill up."""
    order = [md5_order(seed, id_col), F.col(id_col)]
    nth = F.row_number().over(Window.partitionBy(*by, post).orderBy(*order))
    over = F.when(nth <= cap, 0).otherwise(1)
    ranked = df.withColumn("topped_up", over)
    return ranking.ranked(ranked, ["topped_up", *order], "rank", by).where(F.col("rank") <= size)


def balanced_sample(df: DataFrame, group: str, post: str, id_col: str, cap: int, seed: str) -> DataFrame:
    """At most cap rows of each (group, post), then as many of each group as the smallest has."""
    order = [md5_order(seed, id_col), F.col(id_col)]
    capped = df.withColumn("nth", F.row_number().over(Window.partitionBy(group, post).orderBy(*order))).where(F.col("nth") <= cap)
    least = capped.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"))
    ranked = ranking.ranked(capped, order, "rank", [group])
    return ranked.crossJoin(F.broadcast(least)).where("rank <= least").drop("least")


def disjoint_samples(df: DataFrame, id_col: str, score: str, k_random: int, k_enriched: int, seed: str) -> DataFrame:
    """k_random rows in md5 order, and of the others the k_enriched with the highest positive scores."""
    first = df.orderBy(md5_order(seed, id_col), id_col).limit(k_random).withColumn("sample", F.lit("random"))
    rest = df.where(F.col(score) > 0).join(first.select(id_col), id_col, "left_anti")
    return first.unionByName(rest.orderBy(F.desc(score), id_col).limit(k_enriched).withColumn("sample", F.lit("enriched")))
