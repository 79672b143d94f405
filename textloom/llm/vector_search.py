"""Approximate nearest neighbours by adaptive dimension scan over an inverted-list index.

Vectors are turned by a random orthogonal matrix, so that the first columns of a difference are a fair
sample of all of it, and kept in lists by their nearest centroid, in blocks of bounded size. Each
query probes the lists of its nearest centroids, all side by side. Within a block of a probed list the
columns are read some at a time: after d of D columns a candidate whose partial squared distance, scaled by D / d,
exceeds the k-th best of the block's first rows by the margin (1 + EPSILON / sqrt(d))^2 fails the hypothesis test that it
may still belong to the nearest, and is abandoned (Gao and Long, 2023). That bound is each block's own;
none is carried from list to list. Survivors get their full
distance; reported distances are computed from the original vectors in double precision.

Queries and blocks meet by list in a shuffle; a list's rows are dealt over blocks of a fixed size, so
that a list that holds a third of all vectors is scanned by many tasks. Each block gives at most k rows
for each query.

Defined results: vectors that are null, all zero, of another length than most of the table's, or hold a
null or a non-finite component take no part, nor do rows with a null id. Ties go to the smaller id. Rows
that repeat both id and vector count once; an id that stands with several vectors is a query with each of them, and has no neighbour
of its own id. Fewer than k candidates give as many rows. An empty table
gives an empty table. Columns other than the id and the vector are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage

#: The sample that centroids are fitted on, in vectors; every vector is indexed.
MAX_TRAINING = 20_000
#: The share of the lists that a query probes, measured for a recall of 0.9 and more on vectors without clusters.
PROBED = 0.7
EPSILON = 2.1
COLUMNS = 16
BLOCK_ROWS = 2_048


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm on the sample."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        near = nearest_centroids(sample, centroids, 1)[:, 0]
        counts = np.bincount(near, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def nearest_centroids(vectors: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The numbers of the `probes` nearest centroids of each vector, nearest first."""
    squared = (centroids**2).sum(axis=1)[None, :] - 2 * vectors @ centroids.T
    if probes >= len(centroids):
        return np.argsort(squared, axis=1, kind="stable")
    near = np.argpartition(squared, probes - 1, axis=1)[:, :probes]
    order = np.argsort(np.take_along_axis(squared, near, axis=1), axis=1, kind="stable")
    return np.take_along_axis(near, order, axis=1)


def rotation(size: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def scan_block(turned: np.ndarray, query: np.ndarray, k: int, bound: float, columns: int = COLUMNS, epsilon: float = EPSILON) -> tuple[np.ndarray, int]:
    """Rows of a block that may be among the k nearest of a (turned) query -> (their numbers, components read).

    bound: the k-th best squared distance known so far. The first rows are read in full to give a bound.
    """
    size, read = turned.shape[1], 0
    alive = np.arange(len(turned))
    first = alive[: 4 * k]
    exact = ((turned[first] - query) ** 2).sum(axis=1)
    read += exact.size * size
    if len(exact) >= k:
        bound = min(bound, float(np.partition(exact, k - 1)[k - 1]))
    partial = np.zeros(len(turned))
    for at in range(0, size, columns):
        stop = min(at + columns, size)
        part = turned[alive, at:stop] - query[at:stop]
        partial[alive] += np.einsum("ij,ij->i", part, part)
        read += part.size
        margin = 1.0 if stop == size else (1 + epsilon / math.sqrt(stop)) ** 2 * stop / size
        alive = alive[partial[alive] <= bound * margin * (1 + 1e-6)]
        if len(alive) > k and stop == size:
            cut = np.partition(partial[alive], k - 1)[k - 1]
            alive = alive[partial[alive] <= cut * (1 + 1e-6)]
    return alive, read


class InvertedLists:
    """Centroids, the rotation, and the table of lists; fitted on a bounded sample, holding every usable vector."""

    def __init__(self, vectors: DataFrame, id_col: str, vector_col: str, lists: int | None = None, max_training: int = MAX_TRAINING):
        spark = vectors.sparkSession
        rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
        most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        self.size = most["n"] if most else 0
        self.rows, self.spark = rows.where(F.size("v") == self.size), spark
        if not self.size:
            return
        chosen = self.rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_training).select("v").toArrow().column("v")
        sample = np.array([r.as_py() for r in chosen])
        lists = min(len(sample), lists or max(1, round(math.sqrt(min(most["count"], 64 * max_training)) / 2)))
        self.turn = rotation(self.size)
        self.centroids = fit_centroids(sample, lists) @ self.turn
        # Both are bounded: by the square of the vectors' length, and by the size of the training sample.
        self.shared = spark.sparkContext.broadcast((self.turn, self.centroids))

    def assigned(self, rows: DataFrame, probes: int) -> DataFrame:
        """(vec_id, v, list, nth): the `probes` nearest lists of each vector, nth counting from 0."""
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turn, centroids = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                near = nearest_centroids(v @ turn, centroids, probes)
                at = np.repeat(np.arange(batch.num_rows), near.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), batch.column("v").take(pa.array(at)), pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(near.shape[1]), batch.num_rows).astype(np.int32))], ["vec_id", "v", "list", "nth"])

        return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, list int, nth int")


def search(vectors: DataFrame, is_query: Column, k: int = 10, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row for which is_query (over the column vec_id) holds."""
    spark = vectors.sparkSession
    index = InvertedLists(vectors, id_col, vector_col, lists)
    if not index.size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    probes = min(len(index.centroids), probes or max(16, math.ceil(PROBED * len(index.centroids))))
    folder = storage.new_folder(spark, "vector-lists")
    listed = storage.write_table(index.assigned(index.rows, 1), f"{folder}/lists")
    sizes = listed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    members = listed.join(F.broadcast(sizes), "list").select("list", block.alias("block"), "vec_id", "v")  # a row for each centroid
    asked = index.assigned(index.rows.where(is_query), probes).join(F.broadcast(sizes), "list")
    asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "v")

    shared = index.shared

    def scan(left: Iterator[pa.RecordBatch], right: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, _ = shared.value
        queries, rows = list(left), list(right)
        if not rows or not queries:
            return
        ids, v = _matrix(rows)
        order = np.argsort(ids, kind="stable")
        ids, v = _once(ids[order], v[order])  # repeated rows are in one block, since their lists and ids are equal
        turned = np.ascontiguousarray(v @ turn)
        qids, qv = _matrix(queries)
        qids, qv = _once(*(x[np.argsort(qids, kind="stable")] for x in (qids, qv)))
        own = np.searchsorted(ids, qids, "right") - np.searchsorted(ids, qids)
        for qid, q, tq, n in zip(qids, qv, qv @ turn, own.tolist(), strict=True):
            found, _ = scan_block(turned, tq, k + n, math.inf)  # rows of the query's own id don't count
            found = found[ids[found] != qid]
            score = np.sqrt(((v[found] - q) ** 2).sum(axis=1))
            best = np.lexsort((ids[found], score))[:k]
            key = zlib.crc32(q.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), qid)), pa.array(np.full(len(best), key)), pa.array(ids[found][best]), pa.array(score[best])], ["query_id", "query_key", "vec_id", "score"])

    # A block holds about BLOCK_ROWS vectors; its queries grow with the table, and are read as blocks of their own.
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(_parts(index.rows.where(is_query).count(), index, probes))))
    parts = asked.select(F.col("list").alias("l"), F.col("block").alias("b"), F.col("part").alias("p")).distinct()
    dealt = members.join(parts, (F.col("list") == F.col("l")) & (F.col("block") == F.col("b"))).select("list", "block", F.col("p").alias("part"), "vec_id", "v")
    asked = asked.select("list", "block", "part", "vec_id", "v")
    found = asked.groupBy("list", "block", "part").cogroup(dealt.groupBy("list", "block", "part")).applyInArrow(_tables(scan), "query_id long, query_key long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _parts(queries: int, index: InvertedLists, probes: int) -> int:
    """Over how many tasks the queries of one block are dealt, so that each has some thousands."""
    return max(1, math.ceil(queries * probes / len(index.centroids) / 20_000))


def _matrix(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(batches)
    ids = table.column("vec_id").to_numpy()
    v = table.column("v").combine_chunks()
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return ids, v.flatten().to_numpy().reshape(len(ids), -1)


def _once(ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by id without repeats of both id and vector."""
    keep = np.ones(len(ids), bool)
    for s, e in zip(*(lambda at: (np.concatenate([[0], at]), np.concatenate([at, [len(ids)]])))(np.flatnonzero(ids[1:] != ids[:-1]) + 1), strict=True):
        if e - s > 1:
            keep[s:e] = False
            keep[s + np.unique(v[s:e], axis=0, return_index=True)[1]] = True
    return ids[keep], v[keep]


def _tables(scan):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = list(scan(iter(left.to_batches()), iter(right.to_batches())))
        schema = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        return pa.Table.from_batches(out, schema) if out else schema.empty_table()

    return run
