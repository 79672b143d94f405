"""Multinomial logistic models on several factors, fitted by Newton steps whose sums are taken on the executors.

Rows with equal levels and outcome are one cell with a count. A step adds up, over all cells, the log-likelihood, its gradient
and all blocks of its Hessian (one for each two outcomes); the driver gets these sums alone, whose size the model's
parameters fix, and halves a step that lowers the likelihood. Errors are robust to dependence within clusters: each
cluster's score is summed by a shuffle on (cluster, parameter), and their outer products again on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import neighbours, stages

#: Parameters that a model may have; its Hessian is solved by the driver.
MOST_PARAMETERS = 1_500
_PARAMS = "outcome string, term string, coef double, std_err double, p_value double"


class Model:
    """Outcomes other than the base, and design columns: an intercept and each level of a factor but its reference."""

    def __init__(self, outcomes: list[str], levels: list[list[str]]):
        self.outcomes = outcomes
        self.first = 1 + np.cumsum([0, *(len(v) for v in levels)])  # a factor's first column
        self.width = int(self.first[-1])
        self.size = self.width * len(outcomes)

    def design(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Design rows, outcomes as 0/1 columns, counts, from codes that are 0 for the reference and the base."""
        codes = neighbours.matrix(batch.column("x")).astype(int)
        x = np.zeros((len(codes), self.width))
        x[:, 0] = 1
        for i, c in enumerate(codes.T):
            at = np.flatnonzero(c)
            x[at, self.first[i] + c[at] - 1] = 1
        y = batch.column("y").to_numpy()[:, None] == np.arange(1, len(self.outcomes) + 1)
        return x, y.astype(float), batch.column("n").to_numpy().astype(float)

    def chances(self, x: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of the base, and the other outcomes' probabilities."""
        f = x @ beta.reshape(len(self.outcomes), self.width).T
        top = np.maximum(f.max(1), 0)
        log_sum = top + np.log(np.exp(-top) + np.exp(f - top[:, None]).sum(1))
        return -log_sum, np.exp(f - log_sum[:, None])

    def sums(self, batch: pa.RecordBatch, beta: np.ndarray) -> np.ndarray:
        """Number of rows, log-likelihood, gradient, information."""
        x, y, n = self.design(batch)
        base, p = self.chances(x, beta)
        f = x @ beta.reshape(len(self.outcomes), self.width).T
        gradient = ((y - p) * n[:, None]).T @ x
        k = len(self.outcomes)
        information = np.empty((k, self.width, k, self.width))
        for i in range(k):
            for j in range(i, k):
                block = x.T @ (x * (n * p[:, i] * ((i == j) - p[:, j]))[:, None])
                information[i, :, j], information[j, :, i] = block, block.T
        return np.concatenate([[n.sum(), n @ (base + (y * f).sum(1))], gradient.ravel(), information.ravel()])


def multinomial(df: DataFrame, outcome: str, factors: dict[str, str], base: str, cluster: str | None = None, steps: int = 60) -> DataFrame:
    """(outcome, term, coef, std_err, p_value) of a model of outcome on factors {column: reference level}; std_err is null without clusters.

    Rows with a null outcome, level or cluster are left out. Errors carry the correction G / (G - 1) * (N - 1) / (N - parameters). Where a
    level never meets an outcome, or always does, its coefficient has no finite value; the last step counts. Without rows of the base or
    of another outcome there is no model: no rows. A factor without its reference level is an error.
    """
    spark, names = df.sparkSession, list(factors)
    own = [F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(names)] + [F.col(outcome).cast("string").alias("o")]
    own.append(F.col(cluster).cast("string").alias("c") if cluster else F.lit("").alias("c"))
    cols = [f"f{i}" for i in range(len(names))]
    per = stages.kept(df.select(*own).dropna().groupBy("c", "o", *cols).agg(F.count(F.lit(1)).alias("n")), "cells")
    values = {}
    for c in ["o", *cols]:
        values[c] = sorted(r[0] for r in per.select(c).distinct().limit(MOST_PARAMETERS + 1).collect())
    wanted = dict(zip(cols, factors.values(), strict=True))
    if base not in values["o"] or len(values["o"]) < 2:
        return spark.createDataFrame([], _PARAMS)
    for c, reference in wanted.items():
        if reference not in values[c]:
            raise ValueError(f"no row has the level {reference}")
    levels = [[v for v in values[c] if v != wanted[c]] for c in cols]
    outcomes = [v for v in values["o"] if v != base]
    model = Model(outcomes, levels)
    if model.size > MOST_PARAMETERS:
        raise ValueError(f"more than {MOST_PARAMETERS} parameters")
    code = lambda c, known: F.coalesce(F.array_position(F.array(*[F.lit(v) for v in known]).cast("array<string>"), F.col(c)), F.lit(0)).cast("int")
    coded = per.select("c", F.array(*[code(c, v) for c, v in zip(cols, levels, strict=True)]).cast("array<int>").alias("x"), code("o", outcomes).alias("y"), "n")
    cells = stages.kept(coded.groupBy("x", "y").agg(F.sum("n").alias("n")), "cells")
    k, beta = model.size, np.zeros(model.size)

    def at(b: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        out = stages.total(cells, lambda batch: model.sums(batch, b), 2 + k + k * k)
        return out[0], out[1], out[2 : 2 + k], out[2 + k :].reshape(k, k)

    n, value, gradient, information = at(beta)
    step = np.linalg.pinv(information) @ gradient
    for _ in range(steps):
        _, better, g, i = at(beta + step)
        if better < value - 1e-12 * abs(value):
            step /= 2
            continue
        done = np.abs(step).max() < 1e-9 or better - value < 1e-13 * abs(value)
        beta, value, gradient, information = beta + step, better, g, i
        if done:
            break
        step = np.linalg.pinv(information) @ gradient
    errors = _robust(coded, model, beta, information, n) if cluster else np.full(k, np.nan)
    terms = ["intercept", *[f"{f}={v}" for f, own in zip(names, levels, strict=True) for v in own]]
    out = []
    for i, (b, e) in enumerate(zip(beta.tolist(), errors.tolist(), strict=True)):
        sure = math.isfinite(e) and e > 0
        out.append((outcomes[i // model.width], terms[i % model.width], b, e if math.isfinite(e) else None, math.erfc(abs(b / e) / math.sqrt(2)) if sure else None))
    return spark.createDataFrame(out, _PARAMS)  # MOST_PARAMETERS rows at most


def _robust(coded: DataFrame, model: Model, beta: np.ndarray, information: np.ndarray, n: float) -> np.ndarray:
    k = model.size

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, count = model.design(batch)
            residual = (y - model.chances(x, beta)[1]) * count[:, None]
            row, column = np.nonzero(x)
            places = (column[:, None] + np.arange(len(model.outcomes)) * model.width).ravel()
            who = batch.column("c").take(pa.array(np.repeat(row, len(model.outcomes))))
            yield pa.RecordBatch.from_arrays([who, pa.array(places, pa.int32()), pa.array(residual[row].ravel())], ["c", "at", "s"])

    summed = coded.mapInArrow(scores, "c string, at int, s double").groupBy("c", "at").agg(F.sum("s").alias("s"))
    lists = summed.groupBy("c").agg(F.collect_list(F.struct("at", "s")).alias("e"))  # MOST_PARAMETERS for each cluster at most

    def outer(batch: pa.RecordBatch) -> np.ndarray:
        sizes = np.diff(batch.column("e").offsets.to_numpy())
        flat, s = batch.column("e").flatten(), np.zeros((len(sizes), k))
        s[np.repeat(np.arange(len(sizes)), sizes), flat.field("at").to_numpy()] = flat.field("s").to_numpy()
        return np.append(s.T @ s, len(sizes))

    found = stages.total(lists, outer, k * k + 1)
    groups, bread = found[-1], np.linalg.pinv(information)
    if groups < 2 or n <= k:
        return np.full(k, np.nan)
    return np.sqrt(np.diag(bread @ found[:-1].reshape(k, k) @ bread) * groups / (groups - 1) * (n - 1) / (n - k))
