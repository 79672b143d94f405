"""Bootstrap, logistic models, discovery of topics, assembly and sources against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators import assembly, clustering, inference, text, topics
from textloom.sources import tables


def test_bootstrap_as_by_hand(spark):
    rng = np.random.default_rng(1)
    rows = [(int(c), "ab"[int(a)], int(h)) for c, a, h in zip(rng.integers(0, 40, 600), rng.integers(0, 2, 600), rng.random(600) < 0.3, strict=True)]
    rows += [(None, "a", 1), (3, None, 1), (4, "a", None)]
    got = {r["k"]: r for r in inference.cluster_bootstrap(spark.createDataFrame(rows, "c int, k string, h int"), "c", "k", "h").collect()}
    assert set(got) == {"a", "b"}
    for k in "ab":
        own = [(c, h or 0) for c, a, h in rows if a == k]
        ids = sorted({c for c, _, _ in rows}, key=str)
        b, n = (np.array([sum(x for c, x in [(c, f(h)) for c, h in own] if c == i) for i in ids]) for f in (lambda h: h, lambda h: 1))
        draws = [(b[s].sum() / n[s].sum()) for s in np.random.default_rng(7).integers(0, len(ids), (2000, len(ids)))]
        assert got[k]["n"] == len(own) and got[k]["clusters"] == len(ids) and got[k]["rate"] == pytest.approx(b.sum() / n.sum())
        assert got[k]["ci_low"] == pytest.approx(np.quantile(draws, 0.025), abs=0.012) and got[k]["ci_high"] == pytest.approx(np.quantile(draws, 0.975), abs=0.012)
    assert inference.cluster_bootstrap(spark.createDataFrame([], "c int, k string, h int"), "c", "k", "h").count() == 0


def test_logit_as_by_rows(spark):
    rng = np.random.default_rng(2)
    n = 800
    a, b, c = rng.integers(0, 3, n), rng.integers(0, 2, n), rng.integers(0, 60, n)
    y = (rng.random(n) < 1 / (1 + np.exp(0.5 - 0.8 * (a == 1) + 0.4 * b))).astype(int)
    df = spark.createDataFrame([(int(p), f"a{q}", f"b{r}", int(s)) for p, q, r, s in zip(y, a, b, c, strict=True)] + [(None, "a0", "b0", 1), (1, None, "b0", 1)], "y int, a string, b string, c int")
    found, predicted = inference.logit(df, "y", {"a": "a0", "b": "b0"}, "c")
    x = np.column_stack([np.ones(n), a == 1, a == 2, b == 1]).astype(float)
    beta = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x.T * (p * (1 - p))) @ x, x.T @ (y - p))
    p = 1 / (1 + np.exp(-x @ beta))
    bread, scores = np.linalg.inv((x.T * (p * (1 - p))) @ x), np.array([(x * (y - p)[:, None])[c == g].sum(0) for g in np.unique(c)])
    g = len(scores)
    errors = np.sqrt(np.diag(bread @ scores.T @ scores @ bread) * g / (g - 1) * (n - 1) / (n - 4))
    rows = found.collect()
    assert [r["term"] for r in rows] == ["intercept", "a=a1", "a=a2", "b=b1"]
    assert [r["coef"] for r in rows] == pytest.approx(beta.tolist(), abs=1e-8) and [r["std_err"] for r in rows] == pytest.approx(errors.tolist(), abs=1e-8)
    at = {(r["a"], r["b"]): r["probability"] for r in predicted.collect()}
    assert len(at) == 6 and at["a1", "b1"] == pytest.approx(1 / (1 + np.exp(-(beta[0] + beta[1] + beta[3]))))
    assert inference.logit(df.where("y > 1"), "y", {"a": "a0"}, "c")[0].count() == 0


def test_tree_by_hand(spark):
    d = spark.createDataFrame([(1, 2, 0.1), (1, 3, 0.5), (2, 3, 0.7), (1, 4, 0.9), (2, 4, 0.9), (3, 4, 0.3)], "a long, b long, distance double")
    assert clustering.average_linkage(d) == [(1, 2, pytest.approx(0.1), 2), (3, 4, pytest.approx(0.3), 2), (1, 3, pytest.approx(0.75), 4)]
    assert clustering.average_linkage(d.where("a > 9")) == []


def test_clusters_and_sweep(spark, tmp_path):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 12)) * 5
    rows = [(i, (centre[i % 4] + rng.normal(size=12) * 0.1).tolist()) for i in range(240)] + [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [])]
    found = clustering.clustered(spark.createDataFrame(rows, "doc_id long, v array<double>"), "doc_id", "v", least=20, dims=3).select("doc_id", "topic").collect()
    assert len(found) == 244 and {r["topic"] for r in found} == {-1, 0, 1, 2, 3} and sum(r["topic"] == -1 for r in found) <= 30
    assert len({(r["doc_id"] % 4, r["topic"]) for r in found if r["topic"] >= 0}) == 4 and all(r["topic"] == -1 for r in found if r["doc_id"] >= 900)
    runs = []

    def fit(df, k):
        runs.append(k)
        return df.where(f"topic < {k}")

    base = spark.createDataFrame([(1, None), (5, "a")], "topic int, s string")
    for df in (base, base.orderBy("topic", ascending=False).repartition(3)):
        out = clustering.swept(df, {"x": {"k": 3}, "y": {"k": 9}, "again": {"k": 3}}, fit, str(tmp_path))
    assert runs == [3, 9] and out["y"].count() == 2 and out["again"].count() == 1
    for changed in (base.union(base.limit(1)), base.withColumn("s", F.lit("a")), base.withColumnRenamed("s", "t")):
        clustering.swept(changed, {"x": {"k": 3}}, fit, str(tmp_path))
    assert runs == [3, 9, 3, 3, 3]
    out = {n: d.select("topic") for n, d in out.items() if n != "again"}
    assert [tuple(r) for r in clustering.combined_report(out, {"x": "X"}).orderBy("corpus", "topic").collect()] == [("x", "X", 1), ("y", "y", 1), ("y", "y", 5)]


def test_evidence_and_summary(spark):
    keyed = spark.createDataFrame([("a", 1, 5, 1, 3.0), ("b c", 2, 4, 1, 9.0), ("d", 1, 2, 2, -1.0)], "term string, n int, dp int, dn int, z double")
    pairs = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("a", "w", 2.0), ("d", "q", 1.0)], "keyword string, collocate string, log_dice double")
    assert [(r["term"], r["collocates"], r["note"]) for r in text.evidence_table(keyed, pairs, 2, 2).orderBy(F.desc("z")).collect()] == [("b c", "", ""), ("a", "w; y", "")]
    t = spark.createDataFrame([(1, 0, 1, 1), (2, 0, 1, 2), (3, 1, 2, 2), (4, -1, 3, 3)], "doc_id long, topic long, post long, subreddit long")
    words = spark.createDataFrame([(0, "p", 1), (0, "q", 2)], "topic long, term string, rank int")
    got = {r["topic"]: r for r in topics.topic_summary(t, words, spark.createDataFrame([(1, 3, 1)], "topic long, doc_id long, rank int")).collect()}
    assert got[0]["terms"] == "p; q" and got[0]["share"] == 0.5 and got[1]["examples"] == "3" and got[-1]["share_inside"] is None and got[-1]["terms"] == ""


def test_readers(spark, tmp_path):
    k = assembly.keyword_rows(spark.createDataFrame([("a", "Q")], "keyword string, query string")).first()
    assert (k["query"], k["occupation_keyword"]) == ("Q", "a")
    for bad in (spark.createDataFrame([("a",)], "query string"), spark.createDataFrame([], "keyword string")):
        with pytest.raises(ValueError):
            assembly.keyword_rows(bad)
    path = str(tmp_path / "runs.jsonl")
    with open(path, "w") as f:
        f.write('{"id": 1, "completion_status": "completed", "labels": {"a": "x"}}\n{"id": 2, "completion_status": "failed", "labels": {"a": "y"}}\nbroken\n')
    schema = T.StructType.fromDDL("id long, completion_status string, labels struct<a: string>")
    assert [tuple(r) for r in tables.completed(spark, path, schema, "labels").collect()] == [(1, "completed", "x")]
    sheet = spark.createDataFrame([(1, "x")], "`Topic No.` int, `Manual  LABEL` string")
    assert tables.by_header(sheet, {"topic": ["topic no"], "label": ["manual label"]}).columns == ["topic", "label"]
    with pytest.raises(ValueError):
        tables.by_header(sheet, {"absent": []})
    tables.write_sheets({"one": sheet, "two": sheet}, str(tmp_path / "book"))
    assert spark.read.csv(str(tmp_path / "book" / "two"), header=True).count() == 1
    assert tables.vectors(spark, "/root/testdata/sf0.001/embeddings.parquet", "vec_id", "embedding").dtypes == [("vec_id", "bigint"), ("embedding", "array<float>")]
    assert [tuple(r) for r in tables.metric_rows(spark.createDataFrame([(1, None)], "a int, b string")).collect()] == [(0, "a", "1"), (1, "b", "")]


def test_runs_and_sets(spark):
    run = lambda *rows: spark.createDataFrame(list(rows), "id int, label string")
    wanted, book = spark.createDataFrame([(1,), (2,)], "id int"), {"label": ["a", "b"]}
    ok = assembly.combined_runs([run((1, "a"), (9, "zz")), run((1, "a"), (2, "b"))], "id", ["label"], wanted, book, "m")
    assert sorted(tuple(r) for r in ok.collect()) == [(1, "a"), (2, "b")] and ok.columns == ["id", "m_label"]
    for runs in ([run((1, "a")), run((1, "b"), (2, "b"))], [run((1, "a"))], [run((1, "a"), (2, ""))]):
        with pytest.raises(ValueError):
            assembly.combined_runs(runs, "id", ["label"], wanted, book, "m")
    assert assembly.checked_sizes(run((1, "a"), (2, "b")), "id", "label", 2, {"a": 1, "b": 1}).count() == 2
    with pytest.raises(ValueError):
        assembly.checked_sizes(run((1, "a"), (2, "c")), "id", "label", 2, {"a": 1, "b": 1})
