"""Plans and results of steps that must grow no faster than their input."""

import contextlib
import io

from pyspark.sql import functions as F

from textloom.operators import text, topics


def _plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_class_tfidf_gathers_no_class_in_a_task(spark):
    rows = [("a", ["x", "y", "x"]), ("a", None), ("b", ["x", "z"]), (None, ["y", "z", "z"]), ("b", [])]
    docs = spark.createDataFrame(rows, "industry string, words array<string>")
    got = topics.class_tfidf(docs, "words", "industry", 100, 1.0, 1, 3)
    plan = _plan(got)
    assert not [line for line in plan.splitlines() if "unboundedfollowing" in line.lower() and "[industry#" in line.rsplit(")", 1)[-1]]
    want = {}
    for by, words in rows:
        for n in (1, 2, 3):
            for i in range(len(words or []) - n + 1):
                key = by, " ".join(words[i : i + n])
                want[key] = want.get(key, 0) + 1
    assert {(r.industry, r.term) for r in got.collect()} == set(want)
    total = {by: sum(n for (b, _), n in want.items() if b == by) for by in ("a", "b", None)}
    import math

    mean = sum(total.values()) / 3
    for r in got.collect():
        f = sum(n for (_, t), n in want.items() if t == r.term)
        assert math.isclose(r.score, want[r.industry, r.term] / total[r.industry] * math.log(1 + mean / f))


def _words(spark):
    rows = [(i, "yes" if i % 2 else "no", [f"w{(i * k) % 13}" for k in range(i % 9)]) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, gate string, words array<string>")


def test_terms_arise_after_documents_are_dealt(spark):
    docs = _words(spark).unionByName(_words(spark).where("doc_id < 3"))  # ids that repeat count as one document
    stats = text.term_stats(docs, "words", ["gate"], 2)
    plan = _plan(stats)
    assert "hashpartitioning(gate" not in plan.split("Generate")[0].split("partial_sum")[-1]  # no shuffle of each document's terms
    seen, of = {}, {}
    for r in docs.collect():
        for i in range(len(r.words) - 1):
            key = r.gate, f"{r.words[i]} {r.words[i + 1]}"
            seen[key] = seen.get(key, 0) + 1
            of.setdefault(key, set()).add(r.doc_id)
    assert {(r.gate, r.term): (r.f, r.df) for r in stats.collect()} == {k: (n, len(of[k])) for k, n in seen.items()}


def test_keyness_counts_terms_once(spark):
    got = text.keyness(_words(spark), "words", "gate", 2, 1, 1).select("term", "z")
    got.collect()
    assert got._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") > 0


def test_collocations_look_around_keywords_only(spark):
    docs = _words(spark)
    got = text.collocations(docs, "words", spark.createDataFrame([("w1",), ("w6",)], "term string"), 2, 1, 100)
    plan = _plan(got)
    assert "array_distinct" not in plan and plan.count("size(") <= 4  # no filter repeats the words or the pairs
    want = {}
    for r in docs.collect():
        for i, x in enumerate(r.words):
            for y in r.words[max(0, i - 2) : i] + r.words[i + 1 : i + 3]:
                if x in ("w1", "w6") and x != y:
                    n, of = want.setdefault((x, y), [0, set()])
                    want[x, y] = [n + 1, of | {r.doc_id}]
    assert {(r.keyword, r.collocate): (r.pairs, r.df) for r in got.collect()} == {k: (n, len(of)) for k, (n, of) in want.items()}


def test_text_vectors_send_only_buckets_to_python(spark, monkeypatch):
    from textloom.operators import spectral

    seen = []
    kept = spectral.stages.kept
    monkeypatch.setattr(spectral.stages, "kept", lambda df, label: seen.append(_plan(df)) or kept(df, label))
    monkeypatch.setattr(spectral, "_WORDS", 4)  # several parts in a batch
    rows = spark.createDataFrame([(i, [f"w{j}" for j in range(i)] if i else None) for i in range(7)], "doc_id long, words array<string>")
    got = {r.doc_id: r.v for r in spectral.text_vectors(rows, "words", 8).collect()}
    assert "MapInArrow" not in seen[0] and "ArrowEvalPython" in seen[0]
    assert [sum(x > 0 for x in got[i]) for i in (0, 1)] == [0, 1] and len(got) == 7 and all(len(v) == 8 for v in got.values())


def test_krylov_steps_write_nothing_and_parts_agree(spark, monkeypatch):
    import numpy as np

    from textloom.operators import spectral

    rng = np.random.default_rng(5)
    pairs = {(i, j) for i in range(60) for j in (i + 1, int(rng.integers(0, 60))) if i < j < 60}
    rows = [(a, b, 1.0 + (a * b) % 3) for a, b in pairs]
    graph = spark.createDataFrame(rows + [(b, a, w) for a, b, w in rows], "a long, b long, weight double")
    written, kept = [], spectral.stages.kept
    monkeypatch.setattr(spectral.stages, "kept", lambda df, label: written.append(label) or kept(df, label))
    got = []
    for parts in (None, graph.selectExpr("a AS id", "CAST(a % 3 AS INT) AS part").distinct()):
        x, values = spectral.leading(graph, 2, steps=6, cycles=1, parts=parts)
        got.append((np.array([r.x for r in x.orderBy("id").collect()]), values))
    assert len(written) == 8  # degrees, edges, and the vectors that a cycle starts from and finds; none for each step
    assert np.allclose(got[0][0], got[1][0], atol=1e-9) and np.allclose(got[0][1], got[1][1], atol=1e-12)


def test_neighbours_lists_share_their_vectors(spark, monkeypatch):
    import numpy as np

    from textloom.operators import neighbours

    x = np.random.default_rng(6).normal(size=(300, 9))
    monkeypatch.setattr(neighbours, "PART_ROWS", 90)
    tables, kept = [], neighbours.stages.kept

    def keep(df, label):
        tables.append((label, _plan(df), kept(df, label)))
        return tables[-1][2]

    monkeypatch.setattr(neighbours.stages, "kept", keep)
    got = neighbours.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), 4, block=64).collect()
    (_, _, first), (_, plan, _) = [t for t in tables if t[0] == "neighbours"]
    assert "FlatMapCoGroupsInArrow" in plan  # no list carries vectors of its own
    lists = {i: {i} for i in range(300)}
    best = {i: {} for i in range(300)}
    for r in first.collect():
        lists[r.id].add(r.other)
        best[r.id][r.other] = r.distance
    for members in lists.values():
        for a in members:
            best[a].update({b: np.sqrt(((x[a] - x[b]) ** 2).sum()) for b in members if b != a})
    assert {(r.id, r.other, r.rank) for r in got} == {(a, b, n + 1) for a, near in best.items() for n, b in enumerate(sorted(near, key=lambda b: (near[b], b))[:4])}


def test_krylov_steps_move_a_row_for_each_part(spark, monkeypatch):
    import numpy as np

    from textloom.operators import spectral

    rng = np.random.default_rng(8)
    w = np.triu(rng.random((90, 90)) * (rng.random((90, 90)) < 0.1), 1)
    w += np.diag(np.full(89, 0.5), 1)
    w += w.T
    graph = spark.createDataFrame([(3 * int(a), 3 * int(b), float(w[a, b])) for a, b in zip(*np.nonzero(w), strict=True)], "a long, b long, weight double")
    steps, times = [], spectral._times
    monkeypatch.setattr(spectral, "_times", lambda *given: steps.append(times(*given)) or steps[-1])
    monkeypatch.setattr(spectral, "_ROWS", 7, raising=False)
    parts = graph.selectExpr("a AS id", "CAST(5 * (a % 4) AS INT) AS part").distinct()
    x, values = spectral.leading(graph, 3, steps=8, cycles=3, parts=parts)
    assert {s.count() for s in steps[:3]} == {4}  # not one for each row of the graph
    a = w / np.sqrt(np.outer(w.sum(0), w.sum(0)))
    got = {r.id: r.x for r in x.collect()}
    assert sorted(got) == [3 * i for i in range(90)]
    got = np.array([got[3 * i] for i in range(90)])
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][1:4], atol=1e-9) and np.abs(a @ got - got * values).max() < 1e-5


def test_sweep_runs_settings_at_once(spark, tmp_path):
    import threading

    from textloom.operators import clustering

    both = threading.Barrier(2, timeout=60)
    runs = []

    def fit(df, k):
        runs.append(k)
        both.wait()  # broken where one run waits for the other's end
        return df.withColumn("k", F.lit(k) + F.col("id") * df.where(f"id < {k}").count())

    rows = spark.range(9)
    out = clustering.swept(rows, {"x": {"k": 3}, "y": {"k": 5}, "again": {"k": 3}}, fit, str(tmp_path), at_once=2)
    assert sorted(runs) == [3, 5] and {n: d.where("id = 2").first().k for n, d in out.items()} == {"x": 9, "y": 15, "again": 9}
    assert clustering.swept(rows, {"y": {"k": 5}}, fit, str(tmp_path), at_once=2)["y"].count() == 9 and len(runs) == 2


def test_blocks_are_worked_on_in_tiles():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from textloom.operators import density, neighbours

    rng = np.random.default_rng(9)
    x = rng.integers(0, 9, (1024, 3)).astype(float)  # many rows at one place, and ties
    ids, core, comp = rng.permutation(1024) * 5, rng.integers(0, 3, 1024) * 1.0, rng.integers(0, 4, 1024)
    block = pa.table({"id": ids, "v": x.tolist(), "core": core, "comp": comp})
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    peaks, got = [], []
    for work in (neighbours._nearest_in(7), density._outward):
        tracemalloc.start()
        got.append(work(block).to_pylist())
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert max(peaks) < 12 << 20, peaks  # distances of all pairs are 8 MB alone, and each order or mask of them as much again
    near = {int(ids[i]): [(d[i, j], int(ids[j])) for j in np.lexsort((ids, d[i])) if j != i][:7] for i in range(1024)}
    found = {}
    for r in got[0]:
        found.setdefault(r["id"], []).append((r["distance"], r["other"]))
    assert found == near
    w = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    for c in range(4):
        inside = [(w[i, j], min(ids[i], ids[j]), max(ids[i], ids[j])) for i in np.flatnonzero(comp == c) for j in np.flatnonzero(comp != c) if w[i, j] <= 1]
        assert [(r["weight"], r["a"], r["b"]) for r in got[1] if r["comp"] == c] == [min(inside)]
