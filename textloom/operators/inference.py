"""Inference over clustered rows: bootstrap of rates, logistic models with cluster-robust errors."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Combinations of factor levels that a model may have; its design matrix is held by the driver.
MOST_CELLS = 10_000
_Z = 1.959963984540054  # the 0.975 quantile of the normal distribution


def cluster_bootstrap(df: DataFrame, cluster: str, by: str, hit: str, draws: int = 2000, seed: int = 445) -> DataFrame:
    """The rate of hit (0 or 1) in each class, with a 95 % percentile interval from resampled clusters.

    Clusters with equal (hits, rows) in a class are interchangeable: a class becomes a histogram of such pairs, and a draw of
    as many clusters as there are is one multinomial over it. A task holds a class's distinct pairs, not its clusters.
    Clusters without rows of a class count as (0, 0); draws without rows are left out. Null clusters are one cluster, a null
    hit counts as 0, null classes give no row, an empty table an empty one. The point estimate doesn't depend on the seed.
    """
    rows = df.select(F.coalesce(F.col(cluster).cast("string"), F.lit("")).alias("c"), F.col(by).cast("string").alias(by), F.coalesce(F.col(hit).cast("long"), F.lit(0)).alias("b"))
    per = rows.where(F.col(by).isNotNull()).groupBy(by, "c").agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("n"))
    pairs = per.groupBy(by, "b", "n").agg(F.count(F.lit(1)).alias("m")).crossJoin(F.broadcast(rows.agg(F.count_distinct("c").alias("clusters"))))  # one row

    def draw(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["b", "n"])
        clusters, m = int(g["clusters"].iloc[0]), g["m"].to_numpy()
        p = np.append(m, clusters - m.sum()) / clusters
        b, n = np.append(g["b"].to_numpy(), 0), np.append(g["n"].to_numpy(), 0)
        rng, rates, block = np.random.default_rng([seed, zlib.crc32(key[0].encode())]), [], max(1, (1 << 22) // len(p))
        for first in range(0, draws, block):
            times = rng.multinomial(clusters, p, size=min(block, draws - first))
            total = times @ n
            rates.append((times @ b)[total > 0] / total[total > 0])
        low, high = np.quantile(np.concatenate(rates), [0.025, 0.975])
        total = int((m * g["n"]).sum())
        return pd.DataFrame({by: [key[0]], "n": [total], "rate": [(m * g["b"]).sum() / total], "ci_low": [low], "ci_high": [high], "clusters": [clusters]})

    return pairs.groupBy(by).applyInPandas(draw, f"`{by}` string, n long, rate double, ci_low double, ci_high double, clusters long")


def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, probabilities and the inverse information of a logistic model of cells with y hits of n."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ beta)))
        inverse = np.linalg.pinv(x.T @ (x * (n * p * (1 - p))[:, None]))
        step = inverse @ (x.T @ (y - n * p))
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    p = 1 / (1 + np.exp(-(x @ beta)))
    return beta, p, np.linalg.pinv(x.T @ (x * (n * p * (1 - p))[:, None]))


def logit(df: DataFrame, y: str, factors: dict[str, str], cluster: str) -> tuple[DataFrame, DataFrame]:
    """A logistic model of y (0 or 1) on factors {column: reference level}: (parameters, predicted probabilities).

    Rows with equal levels are one cell, so the fit needs the cells alone; the sandwich needs each cluster's score, which is
    summed on the executors. Its errors carry the usual correction G / (G - 1) * (N - 1) / (N - k). Rows with a null level, y or
    cluster are left out. Where a level has only hits or only misses its coefficient has no finite value; the last step counts.
    """
    spark, names = df.sparkSession, list(factors)
    rows = df.select(*[F.col(f).cast("string").alias(f) for f in names], F.col(y).cast("long").alias("y"), F.col(cluster).cast("string").alias("c")).dropna()
    per = rows.groupBy("c", *names).agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
    cells = [tuple(r) for r in per.groupBy(*names).agg(F.sum("y").alias("y"), F.sum("n").alias("n")).orderBy(*names).limit(MOST_CELLS + 1).collect()]
    if len(cells) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} combinations of {names}")
    params = "term string, coef double, std_err double, p_value double, odds_ratio double, ci_low_or double, ci_high_or double"
    predicted = ", ".join(f"`{f}` string" for f in names) + ", probability double"
    if not cells:
        return spark.createDataFrame([], params), spark.createDataFrame([], predicted)
    levels = [(i, f, v) for i, f in enumerate(names) for v in sorted({c[i] for c in cells}) if v != factors[f]]
    design = lambda values: [1.0] + [float(values[i] == v) for i, _, v in levels]
    x, hits, n = np.array([design(c) for c in cells]), np.array([c[-2] for c in cells], float), np.array([c[-1] for c in cells], float)
    beta, p, bread = _fit(x, hits, n)
    known = spark.createDataFrame([(*c[:-2], float(q), design(c)) for c, q in zip(cells, p, strict=True)], ", ".join(f"`{f}` string" for f in names) + ", p double, x array<double>")
    k = x.shape[1]
    scored = per.join(F.broadcast(known), names)  # MOST_CELLS rows at most
    scores = scored.groupBy("c").agg(*[F.sum(F.col("x")[j] * (F.col("y") - F.col("n") * F.col("p"))).alias(f"s{j}") for j in range(k)])
    sums = scores.agg(F.count(F.lit(1)).alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    meat = np.array([[sums[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    g, total = sums["g"], n.sum()
    scale = g / (g - 1) * (total - 1) / (total - k) if g > 1 and total > k else float("nan")
    errors = np.sqrt(np.diag(bread @ meat @ bread) * scale)
    out = []
    for name, b, e in zip(["intercept", *[f"{f}={v}" for _, f, v in levels]], beta.tolist(), errors.tolist(), strict=True):
        out.append((name, b, e, math.erfc(abs(b / e) / math.sqrt(2)) if e else float("nan"), math.exp(b), math.exp(b - _Z * e), math.exp(b + _Z * e)))
    grid = [()]
    for i in range(len(names)):
        grid = [(*head, v) for head in grid for v in sorted({c[i] for c in cells})]
    return spark.createDataFrame(out, params), spark.createDataFrame([(*v, float(1 / (1 + np.exp(-(np.array(design(v)) @ beta))))) for v in grid], predicted)

