"""Hierarchical density clustering: a minimum spanning tree over mutual reachability, condensed to clusters of a least size.

The distance of two rows is the greatest of their Euclidean distance and of the two distances to their least_near-th nearest row
(a row counts as its own nearest). Edges come from a table of near neighbours and from blocks along sorting curves
(`neighbours`), so that no table of all pairs arises; where one block holds all rows, every step is exact.

The tree is built in Boruvka rounds. Each component takes its least edge to another one: from the neighbour table by a
group-by, and from the blocks, each of which gives one edge for each component that it holds. Edges are ordered by (weight,
ids), so the chosen ones form no circle.

A cluster of the hierarchy is a component of `least` rows or more. It begins where small components grow together to that size;
a row counts in it from the weight on at which its own component has that size. `births` finds these in rounds that only merge
small components, and only up to the first edge that leads out of a group, which makes each merge the one that the sorted
edges would give. What is left is a tree of the begun clusters, at most rows / least of them, whose merges the driver sorts;
the rows' share in each cluster's stability is added up on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import neighbours, stages

#: Begun clusters whose merges the driver may sort.
MOST_CLUSTERS = 1_000_000
#: Weights below this count as this: rows at the same place leave their cluster at a finite density.
_LEAST_WEIGHT = 1e-9
_EDGE = "a long, b long, weight double"


def _ordered(edges: DataFrame) -> DataFrame:
    """Edges (x, y, weight) as (a, b, weight), a < b."""
    return edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "weight")


def reachability(near: DataFrame, least_near: int) -> tuple[DataFrame, DataFrame]:
    """Core distances (id, core) and the neighbour table's edges (a, b, weight), each once."""
    core = near.groupBy("id").agg(F.coalesce(F.max(F.when(F.col("rank") < least_near, F.col("distance"))), F.lit(0.0)).alias("core"))
    core = stages.kept(core, "cores")
    other = core.select(F.col("id").alias("other"), F.col("core").alias("other_core"))
    edges = near.join(core, "id").join(other, "other").select(F.col("id").alias("x"), F.col("other").alias("y"), F.greatest("distance", "core", "other_core").alias("weight"))
    return core, _ordered(edges).distinct()


def _outward(t: pa.Table) -> pa.Table:
    """In one block, each component's least edge to another component."""
    ids, core, comp = (t.column(c).to_numpy() for c in ("id", "core", "comp"))
    if len(np.unique(comp)) < 2:
        return pa.table({"comp": pa.array([], pa.int64()), "to": pa.array([], pa.int64()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "weight": pa.array([], pa.float64())})
    v, found = neighbours.matrix(t.column("v").combine_chunks()), []
    for own in neighbours.tiles(len(ids)):
        w = neighbours.squared(v, v[own])
        np.maximum(np.sqrt(w, out=w), core[own, None], out=w)
        np.maximum(w, core[None, :], out=w)
        w[comp[own, None] == comp[None, :]] = np.inf
        least = w.min(1)
        i, j = np.nonzero((w == least[:, None]) & np.isfinite(least)[:, None])  # ties go by ids
        found.append((i + own.start, j, w[i, j]))
    x, y, weight = (np.concatenate(f) for f in zip(*found, strict=True))
    a, b = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
    by = np.lexsort((b, a, weight, comp[x]))
    first = by[np.unique(comp[x][by], return_index=True)[1]]
    return pa.table({"comp": comp[x][first], "to": comp[y][first], "a": a[first], "b": b[first], "weight": weight[first]})


def _roots(pointers: DataFrame, label: str) -> DataFrame:
    """(comp, to), a forest but for pairs that point at each other -> (comp, root); of such a pair the smaller is the root. `to` without a row of its own is a root."""
    back = pointers.select(F.col("comp").alias("to"), F.col("to").alias("again"))
    now = pointers.join(back, "to", "left").select("comp", F.when((F.col("again") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("root"))
    now = stages.kept(now, label)
    while True:
        for _ in range(2):  # each doubles the length of the paths that are followed
            onward = now.select(F.col("comp").alias("root"), F.col("root").alias("next"))
            after = now.join(onward, "root", "left").select("comp", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved"))
            now, before = after.select("comp", "root"), after
        kept = stages.kept(before, label)
        now = kept.select("comp", "root")
        if kept.where("moved").isEmpty():
            return now


def spanning_tree(rows: DataFrame, near: DataFrame, least_near: int, block: int = neighbours.BLOCK, turns: int = neighbours.TURNS, seed: int = 42) -> DataFrame:
    """The tree's edges (a, b, weight), from rows (id, v) and their neighbour table."""
    spark = rows.sparkSession
    n = rows.count()
    if n < 2:
        return spark.createDataFrame([], _EDGE)
    core, edges = reachability(near, least_near)
    width = rows.select(F.size("v").alias("n")).first()["n"]
    placed = rows.join(core, "id", "left").select("id", "v", F.coalesce("core", F.lit(0.0)).alias("core"))
    curves = neighbours.on_curves(placed, width, turns, seed)
    edges, label = stages.kept(edges, "edges"), stages.kept(rows.select("id", F.col("id").alias("comp")), "components")
    tree = None
    for _ in range(64):
        ends = [label.select(F.col("id").alias(e), F.col("comp").alias(f"c{e}")) for e in ("a", "b")]
        edges = stages.kept(edges.select("a", "b", "weight").join(ends[0], "a").join(ends[1], "b").where("ca <> cb"), "edges")
        both = edges.select(F.inline(F.array(*[F.struct(F.col(f"c{x}").alias("comp"), F.col(f"c{y}").alias("to"), "a", "b", "weight") for x, y in ("ab", "ba")])))
        for turn in range(1 if n <= block else turns):
            held = curves.join(label, "id")
            both = both.unionByName(neighbours.in_blocks(held, turn, n, lambda t: _outward(t), "comp long, to long, a long, b long, weight double", block))
        chosen = both.groupBy("comp").agg(F.min_by(F.struct("a", "b", "weight", "to"), F.struct("weight", "a", "b")).alias("e")).select("comp", "e.*")
        chosen = stages.kept(chosen, "chosen")
        if chosen.isEmpty():
            break
        tree = chosen.select("a", "b", "weight") if tree is None else tree.union(chosen.select("a", "b", "weight"))
        root = _roots(chosen.select("comp", "to"), "roots")
        label = stages.kept(label.join(root, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")), "components")
        if label.agg(F.min("comp") == F.max("comp")).first()[0]:
            break
    return stages.kept(tree.distinct(), "tree") if tree is not None else spark.createDataFrame([], _EDGE)


def births(rows: DataFrame, tree: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, weight) of rows whose component ever has `least` rows: a begun cluster that it is then part of, and the weight from which on; and the tree's edges between begun clusters (x, y, a, b, weight)."""
    order = F.struct("weight", "a", "b")
    label = stages.kept(rows.select("id", F.col("id").alias("comp")), "components")
    sizes = label.select("comp", F.lit(1).cast("long").alias("size"))  # of small components
    edges = stages.kept(tree.select(F.col("a").alias("x"), F.col("b").alias("y"), "a", "b", "weight"), "edges")
    done = None
    while True:
        both = edges.select(F.inline(F.array(*[F.struct(F.col(p).alias("comp"), F.col(q).alias("to"), "a", "b", "weight") for p, q in ("xy", "yx")])))
        small = both.join(sizes, "comp")
        chosen = stages.kept(small.groupBy("comp", "size").agg(F.min_by(F.struct("a", "b", "weight", "to"), order).alias("e")).select("comp", "size", "e.*"), "chosen")
        if chosen.isEmpty():
            break
        root = _roots(chosen.select("comp", "to"), "roots")
        grouped = chosen.join(root, "comp").withColumn("e", order)
        # A root that has itself chosen an edge is small: a group of small components. Else it is a begun cluster.
        grouped = grouped.join(chosen.select(F.col("comp").alias("root"), F.lit(True).alias("small")), "root", "left").withColumn("small", F.coalesce("small", F.lit(False)))
        grouped = stages.kept(grouped, "groups")
        group = grouped.where("small").select("comp", F.col("root").alias("group"))
        other = group.select(F.col("comp").alias("to"), F.col("group").alias("to_group"))
        out = small.join(group, "comp").join(other, "to", "left").where("to_group IS NULL OR to_group <> group").groupBy("group").agg(F.min(order).alias("out"))
        first = Window.partitionBy("root").orderBy("e", "comp").rowsBetween(Window.unboundedPreceding, 0)
        # The pair at the root shares one edge; the second of it makes the merge. What comes before the way out merges now.
        g = grouped.where("small").join(out.withColumnRenamed("group", "root"), "root", "left").withColumn("grown", F.sum("size").over(first))
        g = g.withColumn("inside", F.col("out").isNull() | (F.col("e") < F.col("out")))
        born = g.where("inside").groupBy("root").agg(F.min(F.when(F.col("grown") >= least, F.col("e"))).alias("birth"), F.sum("size").alias("merged"))
        g = g.join(born, "root").withColumn("weight", F.when(F.col("birth").isNotNull(), F.greatest("weight", F.col("birth.weight"))).otherwise(F.col("weight")))
        moved = g.select("comp", F.when(F.col("birth").isNotNull() | F.col("inside"), F.col("root")).otherwise(F.col("comp")).alias("new"), F.col("birth").isNotNull().alias("big"), "weight", "size")
        moved = stages.kept(moved.unionByName(grouped.where("NOT small").select("comp", F.col("root").alias("new"), F.lit(True).alias("big"), "weight", "size")), "moved")
        now = label.join(moved, "comp", "left")
        begun = stages.kept(now.where("big").select("id", F.col("new").alias("cluster"), "weight"), "begun")
        done = begun if done is None else done.union(begun)
        label = stages.kept(now.where("big IS NULL OR NOT big").select("id", F.coalesce("new", "comp").alias("comp")), "components")
        sizes = stages.kept(label.groupBy("comp").agg(F.count(F.lit(1)).alias("size")), "sizes")
        to = [moved.select(F.col("comp").alias(p), F.col("new").alias(f"n{p}")) for p in ("x", "y")]
        edges = edges.join(to[0], "x", "left").join(to[1], "y", "left").select(F.coalesce("nx", "x").alias("x"), F.coalesce("ny", "y").alias("y"), "a", "b", "weight")
        edges = stages.kept(edges.where("x <> y"), "edges")
    if done is None:
        done = rows.sparkSession.createDataFrame([], "id long, cluster long, weight double")
    return stages.kept(done, "births"), edges


class Hierarchy:
    """Clusters and their merges: parent, and the weights at which a cluster ends above (it merges) and splits below."""

    def __init__(self, leaves: list[int], edges: list[tuple[int, int, int, int, float]]):
        at = {c: i for i, c in enumerate(leaves)}
        self.leaf, k = leaves, len(leaves)
        self.parent, self.top, self.children = list(range(k)), [np.inf] * k, [()] * k
        find, top_of = list(range(k)), list(range(k))
        for x, y, a, b, weight in sorted(edges, key=lambda e: (e[4], e[2], e[3])):
            x, y = self._find(find, at[x]), self._find(find, at[y])
            pair = (top_of[x], top_of[y])
            for c in pair:
                self.parent[c], self.top[c] = len(self.parent), weight
            find[y], top_of[x] = x, len(self.parent)
            self.parent.append(len(self.parent))
            self.top.append(np.inf)
            self.children.append(pair)

    @staticmethod
    def _find(find: list[int], x: int) -> int:
        while find[x] != x:
            find[x] = find[find[x]]
            x = find[x]
        return x

    def selected(self, rows: np.ndarray, density: np.ndarray) -> np.ndarray:
        """For each cluster the chosen one that it is or is part of, or -1; from the number of rows that leave each cluster itself and the sum of 1 / weight at which they do.

        Clusters are chosen for the greatest sum of stabilities; one that has no parent isn't, unless nothing else is there.
        """
        n = len(self.parent)
        total, best, chosen = rows.astype(float), np.zeros(n), np.zeros(n, bool)
        for c in range(n):  # children come before parents
            below = sum(best[x] for x in self.children[c])
            inside = sum(total[x] for x in self.children[c])
            total[c] += inside
            if self.parent[c] == c:
                continue
            end = 1 / max(self.top[c], _LEAST_WEIGHT)
            split = 1 / max(self.top[self.children[c][0]], _LEAST_WEIGHT) if self.children[c] else 0.0
            own = density[c] - rows[c] * end + inside * (split - end)
            chosen[c] = own >= below
            best[c] = max(own, below)
        out = np.full(n, -1)
        for c in range(n - 1, -1, -1):
            p = self.parent[c]
            out[c] = out[p] if p != c and out[p] >= 0 else c if chosen[c] else -1
        return out


def labels(rows: DataFrame, least: int, least_near: int, k: int | None = None, block: int = neighbours.BLOCK, turns: int = neighbours.TURNS, seed: int = 42) -> DataFrame:
    """(id, topic): clusters of `least` rows and more, numbered by size, then by smallest id; -1 for rows outside.

    rows (id, v) as `neighbours.prepared` gives them. Rows at one place are at distance 0. Where the rows never come apart into two
    clusters of `least` rows, and in tables of fewer rows, all are outside. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    near = neighbours.nearest(rows, max(k or 0, least_near), block, turns, seed)
    begun, edges = births(rows, spanning_tree(rows, near, least_near, block, turns, seed), least)
    leaves = [r[0] for r in begun.select("cluster").distinct().orderBy("cluster").limit(MOST_CLUSTERS + 1).collect()]
    if len(leaves) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters of {least} rows")
    tree = Hierarchy(leaves, [tuple(r) for r in edges.select("x", "y", "a", "b", "weight").collect()])  # fewer than MOST_CLUSTERS
    shared = spark.sparkContext.broadcast((np.array(leaves, np.int64), np.array(tree.parent, np.int64), np.array(tree.top)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, parent, top = shared.value
        for batch in batches:
            at, weight = np.searchsorted(leaf, batch.column("cluster").to_numpy()), batch.column("weight").to_numpy()
            while (up := weight >= top[at]).any():
                at = np.where(up, parent[at], at)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(at), pa.array(weight)], ["id", "node", "weight"])

    placed = stages.kept(begun.mapInArrow(place, "id long, node long, weight double"), "placed")
    per = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum(1 / F.greatest("weight", F.lit(_LEAST_WEIGHT))).alias("density")).toPandas()
    n, density = np.zeros(len(tree.parent), np.int64), np.zeros(len(tree.parent))
    n[per["node"]], density[per["node"]] = per["n"], per["density"]
    chosen = [(i, int(c)) for i, c in enumerate(tree.selected(n, density)) if c >= 0]
    of = spark.createDataFrame(chosen, "node long, chosen long")  # 2 * MOST_CLUSTERS rows at most
    found = rows.select("id").join(placed.select("id", "node"), "id", "left").join(of, "node", "left").select("id", "chosen")
    found = stages.kept(found, "labels")
    sizes = found.where("chosen IS NOT NULL").groupBy("chosen").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    numbered = sizes.withColumn("topic", F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), "least")).cast("long") - 1)  # a row for each cluster
    return found.join(numbered, "chosen", "left").select("id", F.coalesce("topic", F.lit(-1).cast("long")).alias("topic"))
