"""Connected components over a table of links, by alternating large and small stars.

Every node is linked to the smallest node of its component in a number of rounds that grows with the
logarithm of the component's size. Each round is written to the shared folder. Only two numbers a
round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links (a, b), without loops -> (node, component), component being the smallest node reached."""
    spark = links.sparkSession
    folder = storage.new_folder(spark, "components")
    now = storage.write_table(links.select("a", "b").where("a <> b").distinct(), f"{folder}/0")
    before = None
    for i in range(1, max_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        now = storage.write_table(_small_star(_large_star(now)), f"{folder}/{i}")
        if i > 1:
            storage.remove_folder(spark, f"{folder}/{i - 1}")
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
