"""Toxicity by non-negative positive-unlabelled learning.

Known toxic documents are positives; every other text is unlabelled, not negative. With the class
prior p, the risk of a linear scorer f over its loss l is

    p E_pos[l(f, +1)] + max(0, E_unl[l(f, -1)] - p E_pos[l(f, -1)]),

the second part being the risk on negatives as the unlabelled texts and the prior imply it; where
it falls below zero the step goes the other way, so that the scorer doesn't fit the unlabelled toxic
texts as negatives (Kiryo et al., 2017). Classifiers are trained by numpy on the driver from samples
whose bounds are parameters; their average is one table of weights of a fixed size, which scores
every whole text on the executors. The prior is counted over all labelled rows.

A text's features are its words, lower-cased and cut at everything but letters, and the beginnings of
its words, hashed into BUCKETS. A feature counts by the share of the text's words that have it, up to a
bound, so that beginnings met by chance in long texts count little; a whole word counts something
wherever it stands. A language that forms many words from one stem needs no example of each.

Training reads whole texts: executors add up each bucket's values, one row for each bucket, and of a
sampled text the driver gets only the buckets that these sums select. Features that positives don't
hold significantly more of than unlabelled texts get no weight.

Defined results: a null or empty text, or one without letters, has no word and gets the score of the
intercept. Labels that are null are no labels. An id that is null counts as the text '' for the fold.
Repeated rows stay repeated. Without positives every score is 0. An empty table gives an empty table.
Columns that aren't named in the parameters are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
#: Bounds of the two training samples, in documents.
MAX_POSITIVES = 6_000
MAX_UNLABELLED = 18_000
FOLDS = 5
#: Lengths of the beginnings of words, in bytes of UTF-8.
STEMS = range(3, 8)
#: A feature that n of a text's N words have counts min(MOST, SHARE * n / (N + FEW)), a whole word LEAST at least.
SHARE, FEW, MOST, LEAST = 50.0, 20, 2.0, 0.1
#: Bytes of text that are cut into words at once, but for a longer text.
_CHUNK = 1 << 20
_letters = bytes(b if chr(b).isalpha() or b >= 0x80 else 0x20 for b in range(256))
_U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(max(n, _CHUNK + (_CHUNK >> 2)), base, np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def _bucket(x: np.ndarray, length: int) -> np.ndarray:
    """The bucket of a hash of words (length 0) or of the bytes of their beginnings."""
    x = x + _U(length * 0x9E3779B9)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return ((x ^ (x >> _U(31))) & _U(BUCKETS - 1)).astype(np.int64)


def _occurrences(texts: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Cleaned texts -> [(text number, bucket)] of all features of all words, and the number of words of each text."""
    data = b" ".join([*texts, b" " * 8])
    b = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], b != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    of = np.searchsorted(first, starts, "right") - 1
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + _U(1)) * _powers_of(_BASE, len(b)), out=sums[1:])
    out = [(of, _bucket((sums[ends] - sums[starts]) * _powers_of(_INVERSE, len(b) + 1)[starts], 0))]
    length = ends - starts
    for k in STEMS:
        at = np.flatnonzero(length >= k)
        stem = np.zeros(len(at), np.uint64)
        for i in range(k):
            stem |= b[starts[at] + i].astype(np.uint64) << _U(8 * i)
        out.append((of[at], _bucket(stem, k)))
    return out, np.bincount(of, minlength=len(texts))


def features(texts: list[str | None], seen: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For chunks of texts: (the first one's place, text, bucket, value, words): a value for each feature of each text, by text and bucket, and the words of each. seen: only these buckets."""
    first, held, size = 0, [], 0
    for i, text in enumerate([*texts, None]):
        if held and (size >= _CHUNK or i == len(texts)):
            found, n = _occurrences(held)
            codes = [(of[keep] << 18) | at[keep] for of, at in found for keep in [slice(None) if seen is None else seen[at]]]
            ends = np.unique(codes[0])
            codes, times = np.unique(np.concatenate(codes), return_counts=True)
            of = codes >> 18
            value = np.minimum(MOST, SHARE * times / (n[of] + FEW))
            whole = np.searchsorted(codes, ends)
            value[whole] = np.maximum(value[whole], LEAST)
            yield first, of, codes & (BUCKETS - 1), value.astype(np.float32), n
            first, held, size = i, [], 0
        held.append((text or "").lower().encode().translate(_letters))
        size += len(held[-1])


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


@dataclass
class Classifier:
    weights: np.ndarray
    intercept: float

    def margins(self, texts: list[str | None]) -> np.ndarray:
        out, seen = np.empty(len(texts)), self.weights != 0
        for first, of, at, x, n in features(texts, seen):
            out[first : first + len(n)] = self.intercept + np.bincount(of, self.weights[at].astype(np.float64) * x, len(n))
        return out


class _Sparse:
    """Rows of (buckets, values), the buckets renumbered by `place`."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], place: np.ndarray):
        self.rows = [(place[at], x) for at, x in rows]

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Columns, values and row numbers of the chosen rows, end to end."""
        rows = [self.rows[i] for i in at]
        return np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])


@dataclass
class Sums:
    """Over texts with words: how many there are, and for each bucket how many hold it, the sum of its values and of their squares."""

    texts: int
    held: np.ndarray
    total: np.ndarray
    squares: np.ndarray


def telling(p: Sums, u: Sums, least: int = 5, least_z: float = 4.0) -> np.ndarray:
    """Which buckets at least `least` positives hold, and positives more of than unlabelled texts by `least_z` standard errors."""
    n = p.texts + u.texts
    mean = (p.total + u.total) / n
    variance = np.maximum((p.squares + u.squares) / n - mean**2, 1e-9)
    z = (p.total / p.texts - u.total / u.texts) / np.sqrt(variance * (1 / p.texts + 1 / u.texts))
    return (p.held >= least) & (z >= least_z)


def train(positives: list, unlabelled: list, prior: float, seed: int = 0, steps: int = 1_000, batch: int = 1024, rate: float = 0.05, penalty: float = 2e-5) -> Classifier:
    """One classifier by Adam over mini-batches of rows (buckets, values); sigmoid loss, which is bounded, so that no text outweighs the others."""
    rng = np.random.default_rng(seed)
    used = np.unique(np.concatenate([at for at, _ in [*positives, *unlabelled]] or [np.empty(0, np.int32)]))
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used))
    p, u, k = _Sparse(positives, place), _Sparse(unlabelled, place), len(used)
    w, m, v = (np.zeros(k + 1) for _ in range(3))
    w[-1] = -1.0
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    per = max(1, min(batch, len(positives)))
    step = 0
    while step < steps:
        order = rng.permutation(len(unlabelled))
        for at in range(0, len(order), batch):
            bu = order[at : at + batch]
            bp = rng.choice(len(positives), per, replace=len(positives) < per)
            (pc, px, pr), (uc, ux, ur) = p.take(bp), u.take(bu)
            fp = w[-1] + np.bincount(pr, w[pc] * px, len(bp))
            fu = w[-1] + np.bincount(ur, w[uc] * ux, len(bu))
            sp, su = sigmoid(fp), sigmoid(fu)  # the loss of a positive is 1 - s, that of a negative s
            gp, gu = risk_gradient(sp, su, prior)
            g = 0.0 + np.bincount(pc, gp[pr] * px, k + 1) + np.bincount(uc, gu[ur] * ux, k + 1)
            g[-1] = gp.sum() + gu.sum()
            g[:-1] += penalty * w[:-1]
            step += 1
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w[:-1]
    return Classifier(weights, float(w[-1]))


def risk_gradient(sp: np.ndarray, su: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The step's direction by the margin of each positive and each unlabelled text, given their scores."""
    of_negatives, of_unlabelled = -prior * sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
    if su.mean() - prior * sp.mean() < 0:  # only the part that went below zero is stepped back
        return -of_negatives, -of_unlabelled
    return of_negatives - prior * sp * (1 - sp) / len(sp), of_unlabelled


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, held, total, squares); bucket -1 holds the number of texts with words."""
    held, total, squares, texts = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS), np.zeros(BUCKETS), 0
    for batch in batches:
        for _, _, at, x, n in features(batch.column("text").to_pylist()):
            held += np.bincount(at, minlength=BUCKETS)
            total += np.bincount(at, x, BUCKETS)
            squares += np.bincount(at, x * x, BUCKETS)
            texts += int((n > 0).sum())
    used = np.flatnonzero(held)
    if texts:
        # Values as whole millionths: their sums don't depend on the order of partitions.
        rows = [np.append(used, -1).astype(np.int32), np.append(held[used], texts), *(np.append(np.rint(a[used] * 1e6), 0).astype(np.int64) for a in (total, squares))]
        yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], ["bucket", "held", "total", "squares"])


def _sums(texts: DataFrame) -> Sums:
    """Over whole texts; what reaches the driver is BUCKETS + 1 rows at most, whatever the corpus."""
    rows = texts.select("text").mapInArrow(_sum_batches, "bucket int, held long, total long, squares long").groupBy("bucket")
    rows = rows.agg(*[F.sum(c).alias(c) for c in ("held", "total", "squares")]).toArrow()
    out = {c: np.zeros(BUCKETS + 1, np.int64) for c in ("held", "total", "squares")}
    for c, a in out.items():
        a[rows.column("bucket").to_numpy()] = rows.column(c).to_numpy()
    return Sums(int(out["held"][-1]), out["held"][:-1], out["total"][:-1] / 1e6, out["squares"][:-1] / 1e6)


def _sample(texts: DataFrame, most: int) -> DataFrame:
    """At most `most` texts, those whose ids hash lowest: the same whatever the partitions."""
    ids = texts.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # ids alone are sorted; at most `most` rows
    return texts.join(F.broadcast(ids.distinct()), "doc_id", "left_semi").select("text")


def _selected(texts: DataFrame, seen: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text with words, its buckets that are seen, and their values."""
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for _, of, at, x, n in features(batch.column("text").to_pylist(), own):
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(n)))]).astype(np.int32))
                arrays = [pa.ListArray.from_arrays(offsets, pa.array(v)).filter(pa.array(n > 0)) for v in (at.astype(np.int32), x)]
                yield pa.RecordBatch.from_arrays(arrays, ["at", "x"])

    rows = texts.mapInArrow(run, "at array<int>, x array<float>").toArrow()
    return [(np.asarray(a.as_py(), np.int32), np.asarray(x.as_py(), np.float32)) for a, x in zip(rows.column("at"), rows.column("x"), strict=True)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED, members: int = 3) -> Classifier | None:
    """Learns from the rows that aren't held out; None without positives."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("mark")).where((fold_of(F.col(id_col)) != 0) & F.col("mark").isNotNull())
    known, toxic = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("mark") == 1).cast("long")), F.lit(0))).first()
    if not toxic:
        return None
    prior = min(max(toxic / known, 1e-4), 0.5)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(fold_of(F.col(id_col)) != 0)
    confirmed = marks.where("mark = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positives)
    positives = _sample(texts.join(F.broadcast(confirmed), "doc_id", "left_semi"), max_positives)
    unlabelled = _sample(texts, max_unlabelled)
    of_positives, of_texts = _sums(positives), _sums(texts)  # of all texts, not of the sample alone
    if not of_positives.texts or not of_texts.texts:
        return None
    seen = telling(of_positives, of_texts)
    rows = _selected(positives, seen), _selected(unlabelled, seen)
    fitted = [train(*rows, prior, seed) for seed in range(members)]
    return Classifier(np.mean([c.weights for c in fitted], axis=0), float(np.mean([c.intercept for c in fitted])))


def score(docs: DataFrame, model: Classifier | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the probability of label 1."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return narrow.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.tobytes(), model.intercept))  # BUCKETS numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(np.frombuffer(shared.value[0], np.float32), shared.value[1])
        for batch in batches:
            margins = own.margins(batch.column("text").to_pylist())
            probability = 1 / (1 + np.exp(-np.clip(margins, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(probability, pa.float64())], ["doc_id", "score"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, score double")


def toxic_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels, id_col, text_col, label_col), id_col, text_col)
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Classifier | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold. No row moves between tasks."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))
    least = float(np.log(threshold / (1 - threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array(own.margins(batch.column(text_col).to_pylist()) < least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
