"""Adjusted mutual information of two partitions, its expectation summed by Spark.

The expectation is over all tables with the same margins. It depends on a reference and a candidate cluster through their sizes
alone, so pairs of distinct sizes stand for all pairs of clusters; there are no more distinct sizes than the root of twice the
rows. For a pair, the rows that they share by chance follow a hypergeometric distribution, whose terms are cut into ranges. Each
range is summed from the ratios of neighbouring terms, relative to its own largest one, and the ranges of a pair are put
together by a running sum of their logarithms. Terms are divided by their own total at the end, so that no factorial is
needed and sizes of any order keep their precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Terms that are summed at once.
RANGE = 1 << 16


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of terms k from `first` to before `until`, relative to the first one: log of the one at `until`, log of the largest, and, relative to that, their sum and that of their information."""
    for batch in batches:
        out = []
        for a, b, n, first, until in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n", "first", "until")), strict=True):
            k = np.arange(first, until, dtype=np.float64)
            with np.errstate(divide="ignore"):
                up = np.log(a - k) + np.log(b - k) - np.log(k + 1) - np.log(n - a - b + k + 1)
            logs = np.concatenate([[0.0], np.cumsum(up)])
            logs, after = logs[:-1], logs[-1]
            top = logs.max()
            weight = np.exp(logs - top)
            inside = np.maximum(k, 1)
            out.append((after, top, weight.sum(), (weight * k / n * (np.log(inside / a) - np.log(b / n))).sum()))
        if out:
            names = ["after", "top", "weight", "information"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("a", "b", "first", "times")], *[pa.array(c, pa.float64()) for c in zip(*out, strict=True)]], ["a", "b", "first", "times", *names])


def adjusted_mutual_information(c: DataFrame, ref: str = "ref", cand: str = "cand") -> DataFrame:
    """One row: n, mutual information, its expectation, ami (by the mean of the entropies), from a contingency table (ref, cand, n). Two partitions that can't but agree have 1. An empty table has n 0 and nulls."""
    c = c.where("n > 0")
    side = lambda by: c.groupBy(by).agg(F.sum("n").alias("m"))
    total = c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_n"))
    # n ln n, summed over cells and clusters, gives information and entropies.
    bits = lambda df, m, out: df.agg(F.sum(F.col(m) * F.ln(m)).alias(out))
    base = total.crossJoin(bits(c, "n", "h")).crossJoin(bits(side(ref), "m", "ha")).crossJoin(bits(side(cand), "m", "hb"))  # single rows
    sizes = lambda by, out: side(by).groupBy(F.col("m").alias(out)).agg(F.count(F.lit(1)).alias(f"{out}_times"))
    pairs = sizes(ref, "a").crossJoin(F.broadcast(sizes(cand, "b"))).crossJoin(F.broadcast(total.withColumnRenamed("all_n", "n")))  # distinct sizes: few
    low = F.greatest(F.col("a") + F.col("b") - F.col("n"), F.lit(0))
    ranges = pairs.select("a", "b", "n", (F.col("a_times") * F.col("b_times")).alias("times"), F.explode(F.sequence(low, F.least("a", "b"), F.lit(RANGE))).alias("first"))
    ranges = ranges.withColumn("until", F.least(F.col("first") + RANGE, F.least("a", "b") + 1)).repartition("a", "b", "first")
    summed = ranges.mapInArrow(_terms, "a long, b long, first long, times long, after double, top double, weight double, information double")
    before = Window.partitionBy("a", "b").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    summed = summed.withColumn("log", F.coalesce(F.sum("after").over(before), F.lit(0.0)) + F.col("top"))
    summed = summed.withColumn("share", F.exp(F.col("log") - F.max("log").over(Window.partitionBy("a", "b"))))
    each = summed.groupBy("a", "b", "times").agg((F.sum(F.col("share") * F.col("information")) / F.sum(F.col("share") * F.col("weight"))).alias("e"))
    expected = each.agg(F.sum(F.col("times") * F.col("e")).alias("expected"))
    n = F.col("all_n")
    of_ref, of_cand = F.ln(n) - F.col("ha") / n, F.ln(n) - F.col("hb") / n
    found = base.crossJoin(expected).select(n.alias("n"), (of_ref + of_cand - (F.ln(n) - F.col("h") / n)).alias("mutual"), "expected", ((of_ref + of_cand) / 2).alias("mean"))
    spread = F.col("mean") - F.col("expected")
    ami = F.when(F.abs(spread) < 1e-12, 1.0).otherwise((F.col("mutual") - F.col("expected")) / spread)
    return found.select("n", "mutual", "expected", ami.alias("ami"))
