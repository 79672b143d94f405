"""Neighbours, density clustering and spectral reduction against plain versions over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import density, neighbours, spectral

SF = "/root/testdata/sf0.01"


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def distances(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))


def clusters_by_hand(x, least, least_near):
    """All pairs, sorted edges one by one, the clusters that grow, their stabilities and the choice among them."""
    n, d = len(x), distances(x)
    core = np.sort(d, 1)[:, min(least_near, n) - 1]
    w = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    a, b = np.triu_indices(n, 1)
    order = np.lexsort((b, a, w[a, b]))
    comp, members = list(range(n)), {i: [i] for i in range(n)}
    cluster, at, leave = {}, [None] * n, [None] * n
    parent, top, children = [], [], []
    for e in order:
        i, j, weight = comp[a[e]], comp[b[e]], w[a[e], b[e]]
        if i == j:
            continue
        ci, cj = cluster.get(i), cluster.get(j)
        both = members[i] + members[j]
        if ci is not None and cj is not None:
            new = len(parent)
            for c in (ci, cj):
                parent[c], top[c] = new, weight
            parent.append(None), top.append(np.inf), children.append([ci, cj])
        elif ci is not None or cj is not None:
            new = ci if ci is not None else cj
            for p in members[j] if ci is not None else members[i]:
                at[p], leave[p] = new, weight
        elif len(both) >= least:
            new = len(parent)
            parent.append(None), top.append(np.inf), children.append([])
            for p in both:
                at[p], leave[p] = new, weight
        else:
            new = None
        members[i] = both
        for p in members.pop(j):
            comp[p] = i
        cluster.pop(j, None)
        if new is not None:
            cluster[i] = new
    for p in range(n):
        while at[p] is not None and leave[p] >= top[at[p]]:
            at[p] = parent[at[p]]
    lam = lambda v: 1 / max(v, 1e-9)
    size, best, chosen = [0] * len(parent), [0.0] * len(parent), [False] * len(parent)
    for c in range(len(parent)):
        own = [p for p in range(n) if at[p] == c]
        inside = sum(size[k] for k in children[c])
        size[c] = len(own) + inside
        if parent[c] is None:
            continue
        s = sum(lam(leave[p]) - lam(top[c]) for p in own) + inside * ((lam(top[children[c][0]]) if children[c] else 0) - lam(top[c]))
        below = sum(best[k] for k in children[c])
        chosen[c], best[c] = s >= below, max(s, below)
    out = []
    for p in range(n):
        found, c = None, at[p]
        while c is not None:
            found = c if chosen[c] else found
            c = parent[c]
        out.append(found)
    groups = {c: [p for p in range(n) if out[p] == c] for c in set(out) - {None}}
    names = {c: t for t, (c, _) in enumerate(sorted(groups.items(), key=lambda g: (-len(g[1]), g[1][0])))}
    return [names.get(c, -1) for c in out]


def agreement(a, b):
    """Adjusted Rand index."""
    pairs = lambda x: (x * (x - 1) / 2).sum()
    a, b = (np.unique(v, return_inverse=True)[1] for v in (a, b))
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    rows, cols, n = pairs(table.sum(1)), pairs(table.sum(0)), pairs(np.array([len(a)]))
    return 1.0 if rows == cols == n else (pairs(table) - rows * cols / n) / ((rows + cols) / 2 - rows * cols / n)


def blobs(n, width, k, seed, spread=0.4):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(k, width)) * 3
    x = centre[r.integers(0, k, n)] + r.normal(size=(n, width)) * spread
    x[: n // 10] = r.normal(size=(n // 10, width)) * 5
    return x


@pytest.mark.parametrize(("n", "least", "least_near", "seed"), [(1000, 15, 5, 1), (120, 5, 1, 3), (12, 20, 3, 4)])
def test_clusters_equal_all_pairs(spark, n, least, least_near, seed):
    x = blobs(n, 3, 6, seed)
    x[5:9] = x[4]  # rows at one place
    got = density.labels(frame(spark, x), least, least_near).orderBy("id").collect()
    assert [r.topic for r in got] == clusters_by_hand(x, least, least_near)


def test_clusters_of_odd_tables(spark):
    rows = frame(spark, blobs(40, 2, 1, 5))
    assert density.labels(rows.where("false"), 5, 3).count() == 0
    assert [r.topic for r in density.labels(rows.limit(1), 5, 3).collect()] == [-1]
    same = spark.createDataFrame([(i, [1.0, 1.0] if i < 20 else [5.0, 5.0]) for i in range(40)], "id long, v array<double>")
    assert sorted(r.topic for r in density.labels(same, 5, 3).collect()) == [0] * 20 + [1] * 20


def test_clusters_over_many_blocks(spark):
    """Blocks far smaller than the table: approximate, near to all pairs."""
    x = blobs(2000, 4, 8, 7)
    got = density.labels(frame(spark, x), 25, 5, k=15, block=128).orderBy("id").collect()
    assert agreement([r.topic for r in got], clusters_by_hand(x, 25, 5)) >= 0.95


def test_neighbours(spark):
    x = np.vstack([blobs(1500, 8, 10, 8), np.zeros((60, 8)) + 1.0])
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    want = [set(np.lexsort((np.arange(len(x)), row))[:10]) for row in d]
    for block, least in ((2048, 1.0), (128, 0.95)):
        got = neighbours.nearest(frame(spark, x), 10, block=block).collect()
        assert all(r.distance == pytest.approx(d[r.id, r.other], abs=1e-9) for r in got)
        far = np.array([sorted(row)[9] for row in d])
        found = sum(r.distance <= far[r.id] + 1e-12 for r in got) / (10 * len(x))  # ties may stand for each other
        assert found >= least, found
        if block > len(x):
            assert all({r.other for r in got if r.id == i} == want[i] for i in range(0, 1500, 100))


def test_prepared(spark):
    rows = [(1, [3.0, 4.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, float("nan")]), (None, [1.0, 1.0]), (5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [])]
    got = neighbours.prepared(spark.createDataFrame(rows, "k long, x array<double>").withColumn("v", F.lit("clash")), "k", "x", unit=True).orderBy("id").collect()
    assert [(r.id, r.v) for r in got] == [(1, [0.6, 0.8]), (5, [0.0, 1.0])]


def graph_by_hand(d, k):
    """Fuzzy weights of all rows' k nearest, by a fine search for each row's rate."""
    n = len(d)
    w = np.zeros((n, n))
    for i in range(n):
        near = sorted((d[i, j], j) for j in range(n) if j != i)[:k]
        gap = np.array([x - near[0][0] for x, _ in near])
        low, high = 1e-12, 1e6
        for _ in range(200):
            mid = (low * high) ** 0.5
            low, high = (low, mid) if np.exp(-gap / mid).sum() > np.log2(len(near)) else (mid, high)
        for (_, j), g in zip(near, gap):
            w[i, j] = np.exp(-g / low)
    return w + w.T - w * w.T


def test_fuzzy_graph(spark):
    x = blobs(80, 3, 3, 9)
    d = distances(x)
    want = graph_by_hand(d, 6)
    got = np.zeros_like(want)
    for r in spectral.fuzzy_graph(neighbours.nearest(frame(spark, x), 6)).collect():
        got[r.a, r.b] = r.weight
    assert np.allclose(got, want, atol=1e-6)


def test_eigenvectors(spark):
    x = blobs(150, 3, 4, 10)
    graph = spectral.fuzzy_graph(neighbours.nearest(frame(spark, x), 10))
    found, values = spectral.leading(graph, 4, steps=6)
    w = np.zeros((150, 150))
    for r in graph.collect():
        w[r.a, r.b] = r.weight
    a = w / np.sqrt(np.outer(w.sum(0), w.sum(0)))
    real, vectors = np.linalg.eigh(a)
    assert values == pytest.approx(real[::-1][1:5], abs=1e-8)
    got = np.array([r.x for r in found.orderBy("id").collect()])
    assert np.allclose(got.T @ got, np.eye(4), atol=1e-8) and np.abs(a @ got - got * values).max() < 1e-5
    for i in range(4):
        if min(abs(real[-2 - i] - real[-1 - i]), abs(real[-2 - i] - real[-3 - i])) > 1e-3:
            v = vectors[:, -2 - i]
            assert np.allclose(got[:, i], v * np.sign(v[np.argmax(np.abs(v))]), atol=1e-4)


def test_eigenvectors_of_small_and_parted_graphs(spark):
    edges = [(1, 2, 1.0), (2, 3, 0.5), (7, 8, 1.0)]
    found, values = spectral.leading(spark.createDataFrame(edges + [(b, a, w) for a, b, w in edges], "a long, b long, weight double"), 8)
    w = np.zeros((5, 5))
    for a, b, x in edges:
        i, j = ([1, 2, 3, 7, 8].index(v) for v in (a, b))
        w[i, j] = w[j, i] = x
    real = np.linalg.eigvalsh(w / np.sqrt(np.outer(w.sum(0), w.sum(0))))[::-1]
    assert values == pytest.approx(real[1:], abs=1e-8) and found.count() == 5


def test_reduction_keeps_neighbours(spark):
    """Texts of one language stay together, though nothing but hashed words is known of them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 200")
    rows = spectral.text_vectors(docs.select("doc_id", "lang", F.split(F.lower("text"), "[^a-zà-ÿ]+").alias("w")), "w", 128)
    assert rows.select("v").first().v != [0.0] * 128
    low = spectral.reduced(rows, "doc_id", "v")
    truth = {r.doc_id: r.lang for r in rows.select("doc_id", "lang").collect()}
    got = low.orderBy("id").collect()
    assert len(got) >= 0.99 * len(truth) and all(len(r.v) == 5 for r in got)
    d = distances(np.array([r.v for r in got]))
    np.fill_diagonal(d, np.inf)
    same = np.mean([truth[got[i].id] == truth[got[j].id] for i, row in enumerate(d) for j in np.argsort(row)[:10]])
    assert same >= 0.95, same
    assert spectral.reduced(rows.where("false"), "doc_id", "v").count() == 0
