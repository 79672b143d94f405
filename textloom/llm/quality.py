"""Quality by positive-unlabelled learning.

Documents marked good are trusted positives; every other text is unlabelled, not bad. With the class prior p,
the share of good texts, a scorer f minimises the non-negative unbiased risk over the logistic loss l,

    p E_pos[l(f, +1)] + max(0, E_unl[l(f, -1)] - p E_pos[l(f, -1)]),

the second part being the risk on bad texts as the unlabelled ones and the prior imply it (Kiryo et al., 2017).
Both means are over all texts of their kind, with no sample: one pass over the texts writes a few
statistics of each to the shared folder, and every step of the fit adds up gradient, curvature and risk over
that table on the executors. Their sums, of a size that the features alone fix, reach the driver, which
takes a Newton step and halves it while the risk grows, or while the part that can't be negative would be.
The prior is estimated from the labelled rows, as the share of good ones. Its error shifts scores, not their order.

Statistics are shares and means that don't depend on a language's words: of signs by kind, capitals, words that
repeat, that stand beside their like, that carry signs or are long, of lines that repeat, and the length. Each
is cut at fixed knots into ramps, so that a scorer linear in them follows any smooth dependence on each.

Defined results: a null text equals an empty one; its statistics are 0 and it is scored like any other. Labels that
are null are no labels. A null id counts as the text '' for the fold and meets no label. Repeated rows stay repeated,
and count each time in the risk. Without positives every score is 0. An empty table gives an empty table. Columns
that aren't named in the parameters are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

FOLDS, HELD_OUT = 4, 2
_ALL = bytes(range(256))
_SPACE = b" \t\n\x0b\f\r"
#: Kinds of bytes whose shares count.
KINDS = {
    "capitals": bytes(range(0x41, 0x5B)),
    "small": bytes(range(0x61, 0x7B)),
    "beyond": bytes(range(0x80, 0x100)),
    "digits": b"0123456789",
    "space": _SPACE,
    "sentence": b".,;:?'\"()-",
    "calls": b"!",
    "bars": b"|",
    "marks": b"#$%&*+<=>@[\\]^_`{}~/",
}
_others = {k: bytes(b for b in _ALL if b not in v) for k, v in KINDS.items()}
_signs = bytes(b for b in _ALL if not (chr(b).isascii() and chr(b).isalpha() or b >= 0x80 or b in _SPACE))
STATISTICS = (*KINDS, "distinct", "beside", "marked", "mean_word", "longest", "short", "lines_again", "line", "words")
#: Statistics are in [0, 1]; a ramp rises from one knot to the next.
KNOTS = np.array([0.0, 0.02, 0.06, 0.12, 0.2, 0.3, 0.45, 0.6, 0.8, 1.0])
WIDTH = len(STATISTICS) * (len(KNOTS) - 1) + 1


def statistics(text: str | None) -> list[float]:
    """Of one whole text, in the order of STATISTICS."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, out = len(words), [len(data.translate(None, _others[k])) / len(data) for k in KINDS]
    lines = [x for x in data.split(b"\n") if x]
    sizes = list(map(len, words))
    clean = data.translate(None, _signs).split()
    log = lambda x, most: min(1.0, math.log1p(x) / math.log1p(most))
    out.append(len(set(words)) / n)
    out.append(sum(map(eq, words, words[1:])) / n)
    out.append(1 - len(set(words).intersection(clean)) / len(set(words)))  # distinct words that hold a sign
    out.append(log(sum(sizes) / n, 60))
    out.append(log(max(sizes), 5000))
    out.append(sum(x < 3 for x in sizes) / n)
    out.append(1 - len(set(lines)) / len(lines) if lines else 0.0)
    out.append(log(len(data) / max(1, len(lines)), 20_000))
    out.append(log(n, 20_000))
    return out


def ramps(x: np.ndarray) -> np.ndarray:
    """Statistics, a row for each text -> features, the last of which is 1."""
    parts = np.clip((x[:, :, None] - KNOTS[:-1]) / np.diff(KNOTS), 0, 1).reshape(len(x), -1)
    return np.hstack([parts, np.ones((len(x), 1))])


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; HELD_OUT is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([statistics(t) for t in batch.column("text").to_pylist()], np.float32).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATISTICS)).cast(pa.list_(pa.float32()))], ["doc_id", "x"])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of each whole text; the texts are read once, here."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return storage.materialise(narrow.mapInArrow(_measure, f"doc_id {kind}, x array<float>"), "quality-statistics")


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return ramps(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)).astype(np.float64))


def _total(table: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of part(batch), an array of `size`: within tasks, then in groups of tasks, then of these few on the driver."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, task = np.zeros(size), TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                out += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["task", "sums"])

    def across(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("task").to_numpy())  # always in the same order, as float sums depend on it
        own = [np.frombuffer(x, np.float64) for x in group.column("sums").to_pylist()]
        return pa.table({"task": group.column("task").take(pa.array(order[:1])), "sums": pa.array([sum(own[i] for i in order).tobytes()], pa.binary())})

    tasks = table.mapInArrow(within, "task int, sums binary")
    rows = tasks.groupBy(F.col("task") % 32).applyInArrow(across, "task int, sums binary").toArrow().sort_by("task")
    return sum((np.frombuffer(x, np.float64) for x in rows.column("sums").to_pylist()), np.zeros(size))


def loss(margin: np.ndarray, side: int) -> np.ndarray:
    return np.logaddexp(0, -side * margin)


def sums(x: np.ndarray, positive: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of some texts: their number, positives, risks of positives as +1 and -1, of all as -1, both gradients, and the curvature. The gradient of a positive is l'(f, +1) - l'(f, -1) = -1 times its features, whatever f is."""
    f = x @ w
    s = 1 / (1 + np.exp(-np.clip(f, -500, 500)))
    p = positive.astype(np.float64)
    head = [len(x), p.sum(), p @ loss(f, 1), p @ loss(f, -1), loss(f, -1).sum()]
    return np.concatenate([head, p @ x, s @ x, (x.T @ (x * (s * (1 - s))[:, None])).ravel()])


@dataclass
class Risk:
    """At some weights: the unlabelled minus the positives' part, which can't be negative; the whole; gradient and curvature of the unbiased risk."""

    negatives: float
    whole: float
    gradient: np.ndarray
    curvature: np.ndarray


def risk(total: np.ndarray, prior: float, w: np.ndarray, penalty: float) -> Risk:
    n, k, as_good, as_bad, all_bad = total[:5]
    of_positives, of_all, curvature = total[5 : 5 + WIDTH], total[5 + WIDTH : 5 + 2 * WIDTH], total[5 + 2 * WIDTH :].reshape(WIDTH, WIDTH)
    ridge = np.full(WIDTH, penalty)
    ridge[-1] = 0
    negatives = all_bad / n - prior * as_bad / k
    whole = prior * as_good / k + max(0.0, negatives) + 0.5 * ridge @ (w * w)
    return Risk(negatives, whole, of_all / n - prior * of_positives / k + ridge * w, curvature / n + np.diag(ridge))


def fit(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", penalty: float = 1e-3, steps: int = 15) -> np.ndarray | None:
    """Weights learnt from the measured texts that aren't held out; None without positives."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("mark")).where((fold_of(F.col(id_col)) != HELD_OUT) & F.col("mark").isNotNull())
    known, good = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("mark") == 1).cast("long")), F.lit(0))).first()
    if not good:
        return None
    prior = min(max(good / known, 0.01), 0.99)
    trusted = marks.where("mark = 1").select("doc_id").distinct().withColumn("positive", F.lit(True))
    learnt = table.where(fold_of(F.col("doc_id")) != HELD_OUT).join(trusted, "doc_id", "left").select("x", F.coalesce("positive", F.lit(False)).alias("positive"))
    learnt = storage.materialise(learnt, "quality-learnt")
    size = 5 + 2 * WIDTH + WIDTH * WIDTH

    def at(w: np.ndarray) -> Risk | None:
        total = _total(learnt, lambda batch: sums(_rows(batch), batch.column("positive").to_numpy(zero_copy_only=False), w), size)
        return risk(total, prior, w, penalty) if total[1] else None

    w = np.zeros(WIDTH)
    w[-1] = math.log(prior / (1 - prior))
    now = at(w)
    if now is None:
        return None
    step = np.linalg.solve(now.curvature, now.gradient)
    for _ in range(steps):
        there = at(w - step)
        if there.whole > now.whole or there.negatives < 0:
            step /= 2
            if np.abs(step).max() < 1e-3:
                break
            continue
        gain, w, now = now.whole - there.whole, w - step, there
        if gain < 1e-7:
            break
        step = np.linalg.solve(now.curvature, now.gradient)
    return w


def score(table: DataFrame, w: np.ndarray | None) -> DataFrame:
    """(doc_id, score): the probability of label 1, from measured texts."""
    if w is None:
        return table.select("doc_id", F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = _rows(batch) @ w
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(margin, -500, 500))), pa.float64())], ["doc_id", "score"])

    return table.mapInArrow(run, f"doc_id {table.schema['doc_id'].dataType.simpleString()}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    table = measured(docs, id_col, text_col)
    scored = score(table, fit(table, labels, id_col, label_col))
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
