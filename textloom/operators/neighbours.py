"""Nearest neighbours of vectors, approximately, in blocks of bounded size.

Each turn rotates the vectors at random onto a few axes, sorts all rows by the interleaved bits of their places on
these (a Z-order curve), and compares the rows of overlapping blocks of BLOCK consecutive ones. A turn is one sort
by ranges; no block depends on how the data lie, so copies and dense regions split like anything else. Turns differ in
their axes, so that two near rows which one curve parts meet on another. Last, rows that one row names as neighbours are
compared with each other, which finds most of what all turns have missed. A table of BLOCK rows or fewer is one block, and
its neighbours are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import stages

BLOCK = 1024
TURNS = 4
#: Numbers of the vectors in a part whose lists are compared, and its rows at most; smaller tables still have up to _PARTS parts.
PART_NUMBERS, PART_ROWS, _PARTS = 1 << 21, 1 << 15, 12
_AXES, _BITS, _BLOCKS_IN_TASK, _TILE = 7, 63, 4, 128


def usable(v: str):
    """Vectors that aren't null, empty, zero, or with components null or not finite."""
    return F.col(v).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _axes(width: int, turn: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([seed, turn]).normal(size=(width, min(width, _AXES))))[0]


def on_curves(rows: DataFrame, width: int, turns: int, seed: int) -> DataFrame:
    """rows (id, v) and an array of the places on each turn's curve."""
    axes = np.hstack([_axes(width, t, seed) for t in range(turns)])
    k, n = min(width, _AXES), axes.shape[1]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, n))
        for batch in batches:
            x = matrix(batch.column("v")) @ axes
            out += np.stack([x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(out[0]), pa.array(out[1])], ["axis", "total", "squares"])

    counted = rows.count()
    sums = rows.select("v").mapInArrow(moments, "axis long, total double, squares double").groupBy("axis").agg(F.sum("total").alias("total"), F.sum("squares").alias("squares")).orderBy("axis").toPandas()
    mean = sums["total"].to_numpy() / counted
    spread = np.sqrt(np.maximum(sums["squares"].to_numpy() / counted - mean**2, 1e-30))
    bits = _BITS // k

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = (matrix(batch.column("v")) @ axes - mean) / spread
            at = (1 / (1 + np.exp(-1.7 * x)) * (1 << bits)).astype(np.int64).clip(0, (1 << bits) - 1).reshape(len(x), turns, k)
            z = np.zeros((len(x), turns), np.int64)
            for bit in range(bits - 1, -1, -1):
                for axis in range(k):
                    z = (z << 1) | ((at[:, :, axis] >> bit) & 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), turns).cast(pa.list_(pa.int64()))], [*batch.schema.names, "z"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return stages.kept(rows.mapInArrow(place, f"{schema}, z array<bigint>"), "curves")


def in_blocks(curves: DataFrame, turn: int, rows: int, work: Callable[[pa.Table], pa.Table], schema: str, block: int) -> DataFrame:
    """work(block of rows) along a turn's curve; each row stands in the middle of some block, but for the ends of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = None, False
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held, fresh = (new if held is None else pa.concat_tables([held, new])), True
            while held.num_rows > block:
                yield from work(held.slice(0, block)).combine_chunks().to_batches()
                held = held.slice(block // 2)
        if held is not None and fresh:
            yield from work(held).combine_chunks().to_batches()

    tasks = max(1, rows // (_BLOCKS_IN_TASK * block))
    along = curves.withColumn("_z", F.col("z")[turn]).drop("z")
    return along.repartitionByRange(tasks, "_z", "id").sortWithinPartitions("_z", "id").drop("_z").mapInArrow(run, schema)


def parts(curves: DataFrame, rows: int, most: int, least: int = BLOCK) -> DataFrame:
    """(id, part): stretches of about `least` to `most` rows along the first curve, whatever lies there."""
    n = max(-(-rows // most), min(_PARTS, -(-rows // least)), 1)
    along = curves.select("id", F.col("z")[0].alias("z")).repartitionByRange(n, "z", "id")
    return stages.kept(along.select("id", F.spark_partition_id().alias("part")), "parts")


def squared(x: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """Squared distances of the rows `of`, all where it is not given, to all rows of a block, from differences, so that equal rows are at 0."""
    of = x if of is None else of
    out, gap = np.zeros((len(of), len(x))), np.empty((len(of), len(x)))
    for one, other in zip(of.T, x.T, strict=True):
        np.subtract(one[:, None], other[None, :], out=gap)
        out += np.multiply(gap, gap, out=gap)
    return out


def tiles(rows: int) -> Iterator[slice]:
    """Stretches of a block's rows whose distances to all of it stay in a core's cache."""
    return (slice(s, min(s + _TILE, rows)) for s in range(0, rows, _TILE))


def _first(d: np.ndarray, most: int) -> np.ndarray:
    """The places of the `most` smallest of each row in order; of equals the first."""
    bound = np.partition(d, most - 1, axis=1)[:, most - 1 : most]
    less, same = d < bound, d == bound
    same &= np.cumsum(same, axis=1, dtype=np.int32) <= most - less.sum(1, keepdims=True)
    at = np.nonzero(less | same)[1].reshape(len(d), most)
    return np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, 1), axis=1, kind="stable"), 1)


def _nearest_in(k: int) -> Callable[[pa.Table], pa.Table]:
    def work(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, x = t.column("id").to_numpy(), matrix(t.column("v").combine_chunks())
        most = min(k, len(ids) - 1)
        if most < 1:
            return pa.table({"id": ids[:0], "other": ids[:0], "distance": np.empty(0)})
        if x.shape[1] <= _AXES or len(ids) <= 2 * k + 16:
            found = []
            for own in tiles(len(ids)):
                d = np.sqrt(squared(x, x[own]))
                d[np.arange(len(d)), np.arange(own.start, own.stop)] = np.inf
                at = _first(d, most)
                found.append((at, np.take_along_axis(d, at, 1)))
            at, near = (np.concatenate(f) for f in zip(*found, strict=True))
        else:  # inner products choose candidates, of which differences give the distances
            norm = (x * x).sum(1)
            rough = norm[:, None] + norm[None, :] - 2 * (x @ x.T)
            np.fill_diagonal(rough, -np.inf)
            at = np.argpartition(rough, most + 8, axis=1)[:, : most + 9]
            d = np.stack([np.sqrt(((x[i] - x[at[i]]) ** 2).sum(1)) for i in range(len(ids))])
            d = np.where(at == np.arange(len(ids))[:, None], np.inf, d)
            by = np.lexsort((at, d))[:, :most]
            near, at = np.take_along_axis(d, by, 1), np.take_along_axis(at, by, 1)
        return pa.table({"id": np.repeat(ids, most), "other": ids[at].ravel(), "distance": near.ravel()})

    return work


def _among(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Lists (centre, member) and the members' vectors -> for each id its k nearest of those that stand in a list with it. A pair that several lists share is compared once."""

    def work(lists: pa.Table, held: pa.Table) -> pa.Table:
        ids = held.column("id").to_numpy()
        order = np.argsort(ids)
        ids, x = ids[order], matrix(held.column("v").combine_chunks())[order]
        centre, member = (lists.column(c).to_numpy() for c in ("centre", "member"))
        by = np.lexsort((member, centre))
        at, first = np.searchsorted(ids, member[by]), np.flatnonzero(np.append(True, np.diff(centre[by]) != 0))
        sizes, pairs = np.diff(np.append(first, len(by))), [np.empty(0, np.int64)]
        for m in np.unique(sizes):
            i, j = np.triu_indices(int(m), 1)
            own = first[sizes == m]
            step = max(1, (1 << 22) // max(1, len(i)))
            for part in (own[s : s + step] for s in range(0, len(own), step)):
                pairs.append(np.unique(at[part[:, None] + i] * len(ids) + at[part[:, None] + j]))
        a, b = np.divmod(np.unique(np.concatenate(pairs)), max(1, len(ids)))
        step, d = max(1, (1 << 21) // max(1, x.shape[1])), np.empty(len(a))
        for s in range(0, len(a), step):
            d[s : s + step] = np.sqrt(((x[a[s : s + step]] - x[b[s : s + step]]) ** 2).sum(1))
        one, other, d = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d])
        by = np.lexsort((other, d, one))
        start = np.searchsorted(one[by], one[by], "left")
        by = by[np.arange(len(by)) - start < k]
        return pa.table({"id": ids[one[by]], "other": ids[other[by]], "distance": d[by]})

    return work


EDGE = "id long, other long, distance double"


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each row's candidates, of which each turn and round gives a bounded number."""
    lists = edges.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct("distance", "other"))), 1, k).alias("near"))
    return lists.select("id", F.posexplode("near").alias("at", "e")).select("id", F.col("e.other").alias("other"), F.col("e.distance").alias("distance"), (F.col("at") + 1).alias("rank"))


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = batch.column("v")
        x, sizes = v.flatten().to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy())
        length = np.zeros(len(sizes))
        for m in np.unique(sizes):  # rows may differ in their length here
            at = np.flatnonzero(sizes == m)
            own = x[(v.offsets.to_numpy() - v.offsets[0].as_py())[at][:, None] + np.arange(m)]
            length[at] = np.sqrt(np.cumsum(own * own, axis=1)[:, -1])
        offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, pa.array(x / np.repeat(length, sizes)))], ["id", "v"])


def prepared(vectors: DataFrame, id_col: str, v_col: str, unit: bool = False) -> DataFrame:
    """(id, v): the usable vectors, at length one if unit; of rows that share an id the smallest vector counts."""
    v = F.col(v_col).cast("array<double>")
    rows = vectors.where(F.col(id_col).isNotNull() & usable(v_col)).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))
    return stages.kept(rows.mapInArrow(_unit, "id long, v array<double>") if unit else rows, "vectors")


def nearest(rows: DataFrame, k: int, block: int = BLOCK, turns: int = TURNS, seed: int = 42, curves: DataFrame | None = None) -> DataFrame:
    """(id, other, distance, rank from 1) of the k nearest other rows of each, from rows (id, v) as `prepared` gives them.

    Distances are Euclidean; ties go to the smaller id. A table of k rows or fewer gives fewer; an empty one none.
    """
    first = rows.select(F.size("v").alias("n")).first()
    if first is None:
        return rows.sparkSession.createDataFrame([], f"{EDGE}, rank int")
    curves, n = curves or on_curves(rows, first["n"], turns, seed), rows.count()
    if n <= block:
        return stages.kept(_best(in_blocks(curves, 0, n, _nearest_in(k), EDGE, block), k), "neighbours")
    found = None
    for turn in range(turns):
        one = in_blocks(curves, turn, n, _nearest_in(k), EDGE, block)
        found = one if found is None else found.unionByName(one)
    near = stages.kept(_best(found, k), "neighbours")

    # A part's lists share most of their members, so each vector goes once to a part, not to each list.
    members = near.select(F.col("id").alias("centre"), F.col("other").alias("member")).union(rows.select("id", "id"))
    part = parts(curves, n, min(PART_ROWS, PART_NUMBERS // first["n"] + 1))
    lists = members.join(part.withColumnRenamed("id", "centre"), "centre")
    held = lists.select("part", F.col("member").alias("id")).distinct().join(rows, "id").select(F.col("part").alias("part"), "id", "v")
    among = lists.groupBy("part").cogroup(held.groupBy("part")).applyInArrow(_among(k), EDGE)
    return stages.kept(_best(near.select("id", "other", "distance").unionByName(among), k), "neighbours")
