"""Reduction of vectors by their neighbour graph: its fuzzy edges, and its leading eigenvectors by sparse products in Spark.

An edge's weight falls with the distance beyond the nearest neighbour's, at a rate that gives each row's edges the same total; two
rows' views of their edge are united as fuzzy sets are, w + w' - w w'. Coordinates are the leading eigenvectors of the
graph's normalised adjacency besides the trivial one, as in spectral layouts and diffusion maps.

Eigenvectors come from a block Krylov space: from a block of start vectors, each step multiplies the last block by the edge
table and makes it orthogonal to those before. Rows that are near each other form parts of bounded size. A part's edges stay
where they are, and its values are one matrix, so that Spark moves a row for each part and for each pair of parts with
edges between them, not one for each row or edge; a row's values go once to each part that has an edge to it. Parts carry the
last two blocks; all blocks meet once at the end of a cycle. What reaches the driver are each part's inner products, of a size
that the number of blocks fixes. From these the driver solves a small dense problem, and the vectors that it finds start the
next cycle until their residuals are small. Within a cycle blocks are persisted, not written; a lost executor costs the cycle's
steps for its parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import neighbours, stages

#: Words that a task counts at once, but for a longer text.
_WORDS = 1 << 20
#: Rows of a part of the graph, whose edges a task multiplies at once: the more, the fewer products leave their part.
PART_LEAST, PART_ROWS = 1 << 12, 1 << 17
_LEVEL = StorageLevel.MEMORY_AND_DISK
#: Rows in a batch that leaves the parts.
_ROWS = 1 << 13
# A row for each part: the other parts that want rows of it, the places of these among its ids, its ids, a matrix with a row for each id, and the inner products of its columns.
_STATE = "part int, to array<int>, places array<binary>, ids binary, q binary, gram binary"
_MAIL = "part int, source int, to array<int>, places array<binary>, ids binary, q binary"
_LINKS = "part int, source int, a binary, b binary, weight binary, wanted binary"
_ARROW = {"int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}
_STATE_ARROW, _MAIL_ARROW, _LINKS_ARROW = (pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in t.split(", ")]) for t in (_STATE, _MAIL, _LINKS))


def fuzzy_graph(near: DataFrame) -> DataFrame:
    """(a, b, weight), each edge both ways, from a neighbour table (id, other, distance, rank)."""
    lists = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "distance"))).alias("near"))  # k rows for each id
    lists = lists.select("id", F.col("near.other").alias("other"), F.col("near.distance").alias("distance"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, others = batch.column("id").to_numpy(), batch.column("other")
            sizes = np.diff(others.offsets.to_numpy())
            d = np.full((len(ids), max(1, int(sizes.max(initial=0)))), np.inf)
            d[np.arange(d.shape[1]) < sizes[:, None]] = batch.column("distance").flatten().to_numpy()
            beyond = np.maximum(d - d[:, :1], 0)
            wanted, low, high = np.log2(np.maximum(sizes, 2)), np.zeros(len(ids)), np.full(len(ids), np.inf)
            rate = np.ones(len(ids))  # halved or doubled until bracketed, then bisected
            for _ in range(64):
                over = np.exp(-beyond / rate[:, None]).sum(1) > wanted
                high, low = np.where(over, rate, high), np.where(over, low, rate)
                rate = np.where(np.isinf(high), rate * 2, (low + high) / 2)
            floor = 1e-3 * np.nanmean(np.where(np.isinf(d), np.nan, d), 1)
            w = np.exp(-beyond / np.maximum(rate, np.maximum(floor, 1e-12))[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), others.flatten(), pa.array(w[np.isfinite(d)])], ["a", "b", "weight"])

    one = lists.mapInArrow(weigh, "a long, b long, weight double")
    both = one.union(one.select("b", "a", "weight")).groupBy("a", "b")
    together = F.sum("weight") - F.when(F.count(F.lit(1)) > 1, F.min("weight") * F.max("weight")).otherwise(0.0)
    return both.agg(together.alias("weight"))


def _opened(value: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(value, np.float64).reshape(-1, columns)


def _gram(state: DataFrame, size: int) -> np.ndarray:
    """All inner products of the columns of q: each part's own reach the driver, which adds them in the parts' order."""
    rows = state.select("part", "gram").toArrow().sort_by("part")
    return sum((_opened(x, size) for x in rows.column("gram").to_pylist()), np.zeros((size, size)))


def _packed(edges: pa.Table) -> pa.Table:
    """A part's edges (a, b, weight, source), b being in the part `source`, as a row for each source: places of a among the part's ids, places of b among those that the part wants of the source (of itself: all), and weights."""
    a, b, weight, source = (edges.column(c).to_numpy() for c in ("a", "b", "weight", "source"))
    own, ids, out = edges.column("part")[0].as_py(), np.unique(a), []
    by = np.lexsort((b, a, source))  # sums of floats depend on their order
    for one in np.split(by, np.flatnonzero(np.diff(source[by])) + 1):
        wanted = ids if source[one[0]] == own else np.unique(b[one])
        places = [np.searchsorted(among, x[one]).astype(np.int32).tobytes() for among, x in ((ids, a), (wanted, b))]
        out.append((own, int(source[one[0]]), *places, weight[one].tobytes(), wanted.tobytes()))
    return pa.table(list(zip(*out, strict=True)), _LINKS_ARROW)


def _started(rows: pa.Table, wants: pa.Table) -> pa.Table:
    """A part's rows (id, q) in the order of their ids, and where each other part's wanted rows are among them."""
    rows, wants = rows.sort_by("id"), wants.filter(pc.not_equal(wants.column("part"), wants.column("to"))).sort_by("to")
    ids, q = rows.column("id").to_numpy(), neighbours.matrix(rows.column("q").combine_chunks())
    places = [np.searchsorted(ids, np.frombuffer(w, np.int64)).astype(np.int32).tobytes() for w in wants.column("wanted").to_pylist()]
    return pa.Table.from_batches([_state(rows.column("part")[0].as_py(), wants.column("to").to_pylist(), places, ids.tobytes(), q)])


def _state(part: int, to: list[int], places: list[bytes], ids: bytes, q: np.ndarray) -> pa.RecordBatch:
    row = (part, to, places, ids, np.ascontiguousarray(q).tobytes(), (q.T @ q).tobytes())
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _STATE_ARROW.types, strict=True)], schema=_STATE_ARROW)


def _mixed(state: DataFrame, by: np.ndarray) -> DataFrame:
    """state with q times a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                yield _state(row["part"], row["to"], row["places"], row["ids"], _opened(row["q"], len(by)) @ by)

    return state.mapInArrow(run, _STATE)


def _times(links: DataFrame, tasks: int, state: DataFrame, by: np.ndarray, width: int) -> DataFrame:
    """state with q times a matrix, and as further columns the edges times the last `width` columns of that. A part's q goes whole to itself, and to each other part those of its rows that are wanted there, once."""
    size = by.shape[1]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                q = _opened(row["q"], len(by)) @ by
                last = q[:, size - width :]
                yield letter(row["part"], row["part"], row["to"], row["places"], row["ids"], q)
                for to, places in zip(row["to"], row["places"], strict=True):
                    yield letter(to, row["part"], None, None, None, last[np.frombuffer(places, np.int32)])

    def letter(*row) -> pa.RecordBatch:
        row = (*row[:-1], np.ascontiguousarray(row[-1]).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _MAIL_ARROW.types, strict=True)], schema=_MAIL_ARROW)

    def product(links: pa.Table, mail: pa.Table) -> pa.Table:
        row = mail.filter(pc.equal(mail.column("source"), mail.column("part"))).to_pylist()[0]
        q = _opened(row["q"], size)
        y, at = np.zeros((width, len(q))), {s: i for i, s in enumerate(mail.column("source").to_pylist())}
        links = links.sort_by("source")
        for i, source in enumerate(links.column("source").to_pylist()):
            a, b = (np.frombuffer(links.column(c)[i].as_py(), np.int32) for c in ("a", "b"))
            weight = np.frombuffer(links.column("weight")[i].as_py(), np.float64)
            x = q[:, size - width :] if source == row["part"] else _opened(mail.column("q")[at[source]].as_py(), width)
            for j in range(width):
                y[j] += np.bincount(a, weight * np.ascontiguousarray(x[:, j])[b], len(q))
        return pa.Table.from_batches([_state(row["part"], row["to"], row["places"], row["ids"], np.hstack([q, y.T]))])

    mail = state.mapInArrow(send, _MAIL).repartition(tasks, "part")
    return links.groupBy("part").cogroup(mail.groupBy("part")).applyInArrow(product, _STATE)


def _together(blocks: list[tuple[DataFrame, int, list[int]]], tasks: int) -> DataFrame:
    """state whose q has the named columns of each block's q (state, its columns, those that count) side by side."""
    rows = None
    for j, (state, size, columns) in enumerate(blocks):

        def cut(batches: Iterator[pa.RecordBatch], j=j, size=size, columns=columns) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in (batch.slice(i, 1) for i in range(batch.num_rows)):
                    q = np.ascontiguousarray(_opened(row.column("q")[0].as_py(), size)[:, columns]).tobytes()
                    given = [row.column(c) if j == 0 else pa.nulls(1, _STATE_ARROW.field(c).type) for c in ("to", "places", "ids")]
                    yield pa.RecordBatch.from_arrays([row.column("part"), pa.array([j], pa.int32()), *given, pa.array([q], pa.binary())], schema=_MAIL_ARROW)

        one = state.mapInArrow(cut, _MAIL)
        rows = one if rows is None else rows.unionByName(one)
    counts = [len(c) for _, _, c in blocks]

    def join(group: pa.Table) -> pa.Table:
        own = group.sort_by("source").to_pylist()
        q = np.hstack([_opened(r["q"], n) for r, n in zip(own, counts, strict=True)])
        return pa.Table.from_batches([_state(own[0]["part"], own[0]["to"], own[0]["places"], own[0]["ids"], q)])

    return rows.repartition(tasks, "part").groupBy("part").applyInArrow(join, _STATE)


def _orthonormal(g: np.ndarray, known: int, width: int) -> tuple[np.ndarray, int, np.ndarray]:
    """From the inner products of the first `known` columns, which are orthonormal, and `width` more: the matrix that makes these orthogonal to the first and of length one (columns that depend on the others go), how many are left, and the matrix that gives the old columns from all new ones."""
    size = known + width
    cross = np.linalg.lstsq(g[:known, :known], g[:known, known:], rcond=None)[0]
    own = g[known:, known:] - cross.T @ g[:known, known:]
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    left = values > 1e-20 + 1e-14 * np.diag(g)[known:].max(initial=0)
    into = np.zeros((size, known + int(left.sum())))
    into[:known, :known] = np.eye(known)
    scaled = vectors[:, left] / np.sqrt(values[left])
    into[known:, known:], into[:known, known:] = scaled, -cross @ scaled
    back = np.vstack([cross, np.sqrt(values[left])[:, None] * vectors[:, left].T])
    return into, int(left.sum()), back


def leading(graph: DataFrame, dims: int, steps: int = 10, cycles: int = 12, tolerance: float = 1e-6, seed: int = 42, parts: DataFrame | None = None) -> tuple[DataFrame, np.ndarray]:
    """The `dims` leading eigenvectors besides the trivial one of the normalised adjacency of a symmetric graph (a, b, weight): (id, x), of unit length, the greatest component positive; and their eigenvalues.

    A graph of fewer than dims + 1 nodes has fewer. parts (id, part) says which rows are worked on together; where it is not given, their ids' hashes do.
    """
    degree = stages.kept(graph.groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("degree")), "degrees")
    rows, whole = degree.agg(F.count(F.lit(1)), F.sum("degree")).first()
    if parts is None:
        parts = degree.select("id", F.pmod(F.xxhash64("id"), F.lit(rows // PART_ROWS + 1)).cast("int").alias("part"))
    tasks = 2 * (parts.agg(F.count_distinct("part")).first()[0] or 1)  # parts are dealt by hash
    placed = degree.join(parts, "id")
    by = [placed.select(F.col("id").alias(e), F.col("degree").alias(f"d{e}"), F.col("part").alias(p)) for e, p in (("a", "part"), ("b", "source"))]
    edges = graph.join(by[0], "a").join(by[1], "b").select("part", "source", "a", "b", (F.col("weight") / F.sqrt(F.col("da") * F.col("db"))).alias("weight"))
    edges = stages.kept(edges, "adjacency")
    links = edges.repartition(tasks, "part").groupBy("part").applyInArrow(_packed, _LINKS).repartition(tasks, "part").persist(_LEVEL)
    width = dims + 3
    random = [F.xxhash64("id", F.lit(seed), F.lit(i)) / F.lit(2.0**63) for i in range(width)]
    start = placed.select("id", "part", F.array(F.sqrt(F.col("degree") / F.lit(whole)), *random).alias("q"))  # the trivial vector comes first
    wants = links.select(F.col("source").alias("part"), F.col("part").alias("to"), "wanted")
    blocks = []
    try:
        state = stages.kept(start.repartition(tasks, "part").groupBy("part").cogroup(wants.groupBy("part")).applyInArrow(_started, _STATE), "vectors")
        for _ in range(cycles):
            into, width, _ = _orthonormal(_gram(state, 1 + width), 1, width)
            if not width:
                return degree.select("id", F.array().cast("array<double>").alias("x")), np.empty(0)
            # Of the basis a row carries two blocks: the operator is symmetric, so that a product is orthogonal to those before.
            before, blocks, backs = 0, [], []
            for step in range(steps):
                state = _times(links, tasks, state, into, width).persist(_LEVEL)
                blocks.append((state, before, width))
                if step == steps - 1:
                    break
                into, new, back = _orthonormal(_gram(state, 1 + before + 2 * width), 1 + before + width, width)
                if not new:
                    break
                backs.append(back)
                into = np.delete(into, np.s_[1 : 1 + before], axis=1)
                before, width = width, new
            size = 1 + sum(w for _, _, w in blocks)
            every = size + width  # the basis, and the last block's products
            into, at = np.zeros((every, size - 1)), 1  # gives all products from these
            for back, (_, old, w) in zip(backs, blocks, strict=False):
                into[0, at - 1 : at + w - 1] = back[0]
                into[at - old : at - old + len(back) - 1, at - 1 : at + w - 1] = back[1:]
                at += w
            into[size:, size - 1 - width :] = np.eye(width)
            counting = [(done, 1 + old + 2 * w, [0] * (j == 0) + list(range(1 + old, 1 + old + w * (1 + (j == len(blocks) - 1))))) for j, (done, old, w) in enumerate(blocks)]
            found_rows = _together(counting, tasks).persist(_LEVEL)
            blocks.append((found_rows, 0, 0))
            g = _gram(found_rows, every)
            qq, qy, yy = g[1:size, 1:size], (g @ into)[1:size], into.T @ g @ into
            values, vectors = np.linalg.eigh(qq)
            white = vectors[:, values > 1e-8] / np.sqrt(values[values > 1e-8])
            inner = white.T @ ((qy + qy.T) / 2) @ white
            values, vectors = np.linalg.eigh(inner)
            found = white @ vectors[:, ::-1]
            values = values[::-1]
            most = min(dims, len(values))
            residual = [np.sqrt(max(0.0, u @ yy @ u - 2 * v * (u @ qy @ u) + v * v * (u @ qq @ u))) for u, v in zip(found.T[:most], values, strict=False)]
            width = min(dims + 3, found.shape[1])
            last = np.zeros((every, 1 + width))
            last[0, 0], last[1:size, 1:] = 1, found[:, :width]
            state = stages.kept(_mixed(found_rows, last), "vectors")
            for done, _, _ in blocks:
                done.unpersist()
            if max(residual) <= tolerance:
                break
    finally:
        for done, _, _ in blocks:
            done.unpersist()
        links.unpersist()

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, q in zip(batch.column("ids"), batch.column("q"), strict=True):
                ids, x = np.frombuffer(own.as_py(), np.int64), _opened(q.as_py(), 1 + width)[:, 1 : 1 + most]
                for at in range(0, len(ids), _ROWS):
                    part = np.ascontiguousarray(x[at : at + _ROWS])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + _ROWS]), pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), most).cast(pa.list_(pa.float64()))], ["id", "x"])

    table = state.select("ids", "q").mapInArrow(unpacked, "id long, x array<double>")
    ends = table.agg(*[F.max_by(F.col("x")[i], F.struct(F.round(F.abs(F.col("x")[i]), 9), -F.col("id"))).alias(f"s{i}") for i in range(most)]).first()
    signs = [1.0 if ends[f"s{i}"] >= 0 else -1.0 for i in range(most)]
    return table.select("id", F.array(*[F.col("x")[i] * s for i, s in enumerate(signs)]).alias("x")), values[:most]


def _bucket_counts(width: int) -> Callable[[Column], Column]:
    """Lists of buckets -> how often each of `width` buckets stands in the list."""

    @F.arrow_udf("array<double>")
    def counts(lists: pa.Array) -> pa.Array:
        sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
        ends, out, at = np.cumsum(sizes), np.zeros((len(sizes), width)), 0
        while at < len(sizes):  # so many rows that their words take little memory
            until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _WORDS, "right")))
            own = flat[ends[at - 1] if at else 0 : ends[until - 1]]
            out[at:until] = np.bincount(np.repeat(np.arange(until - at), sizes[at:until]) * width + own, minlength=(until - at) * width).reshape(-1, width)
            at = until
        return pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), width).cast(pa.list_(pa.float64()))

    return counts


def text_vectors(docs: DataFrame, words: str, width: int = 256) -> DataFrame:
    """Column v: each row's words as hashed counts, weighted by ln((1 + rows) / (1 + rows with the bucket)). Rows without words get zeros. One pass over the words for the counts, one for the rows that hold each bucket; no row moves, and of a row only its buckets reach Python."""
    buckets = F.transform(F.coalesce(F.col(words), F.array().cast("array<string>")), lambda w: F.pmod(F.xxhash64(w), F.lit(width)).cast("int"))
    counted = stages.kept(docs.withColumn("v", _bucket_counts(width)(buckets)), "counts")
    held = stages.total(counted, lambda b: np.append((neighbours.matrix(b.column("v")) > 0).sum(0), b.num_rows).astype(float), width + 1)
    weight = F.array(*[F.lit(float(x)) for x in np.log((1 + held[-1]) / (1 + held[:-1]))])
    return counted.withColumn("v", F.zip_with("v", weight, lambda x, w: x * w))


def reduced(vectors: DataFrame, id_col: str, v_col: str, dims: int = 5, k: int = 15, block: int = neighbours.BLOCK, turns: int = neighbours.TURNS, seed: int = 42) -> DataFrame:
    """(id, v): `dims` coordinates of each usable vector, from the neighbour graph by cosine distance of k neighbours.

    A coordinate is an eigenvector's component over the square root of the row's share in the graph's total degree, so that rows
    of one dense region are near each other whatever their degrees. Vectors null, empty, zero or with components null or not
    finite are left out, as are rows without an id; of rows that share an id the smallest vector counts. A table of one row or
    none gives an empty one.
    """
    rows = neighbours.prepared(vectors, id_col, v_col, unit=True)
    first = rows.select(F.size("v").alias("n")).first()
    if first is None:
        return rows
    curves = neighbours.on_curves(rows, first["n"], turns, seed)
    near = neighbours.nearest(rows, k, block, turns, seed, curves)
    if near.isEmpty():
        return rows.where("false")
    parts = neighbours.parts(curves, rows.count(), PART_ROWS, PART_LEAST)
    graph = stages.kept(fuzzy_graph(near.withColumn("distance", F.col("distance") * F.col("distance") / 2)), "graph")  # of unit vectors, 1 - cosine
    x, _ = leading(graph, dims, cycles=4, tolerance=1e-4, seed=seed, parts=parts)
    degree = graph.groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("degree"))
    whole = graph.agg(F.sum("weight")).first()[0]
    return stages.kept(x.join(degree, "id").select("id", F.transform("x", lambda c: c / F.sqrt(F.col("degree") / F.lit(whole))).alias("v")), "reduced")
