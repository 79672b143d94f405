"""The multinomial model against a plain fit of its rows."""

import numpy as np
import pytest

from textloom.operators import multinomial


def plain(x, y, k, cluster):
    """Newton on rows, scores by cluster."""
    n, w = x.shape
    beta = np.zeros(k * w)
    for _ in range(60):
        f = np.column_stack([np.zeros(n), x @ beta.reshape(k, w).T])
        p = np.exp(f - f.max(1)[:, None])
        p = (p / p.sum(1)[:, None])[:, 1:]
        rows = [np.kron((np.arange(1, k + 1) == y[i]) - p[i], x[i]) for i in range(n)]
        h = sum(np.kron(np.diag(p[i]) - np.outer(p[i], p[i]), np.outer(x[i], x[i])) for i in range(n))
        step = np.linalg.solve(h, np.sum(rows, 0))
        beta = beta + step
        if np.abs(step).max() < 1e-11:
            break
    scores = np.array([np.sum([r for r, c in zip(rows, cluster) if c == g], 0) for g in sorted(set(cluster))])
    g, bread = len(scores), np.linalg.inv(h)
    return beta, np.sqrt(np.diag(bread @ scores.T @ scores @ bread) * g / (g - 1) * (n - 1) / (n - len(beta)))


def test_several_factors(spark):
    r = np.random.default_rng(2)
    n = 500
    a, b, c = r.integers(0, 3, n), r.integers(0, 2, n), r.integers(0, 40, n)
    f = np.column_stack([np.zeros(n), 0.4 * (a == 1) - 0.5 * b, -0.3 + 0.8 * (a == 2) + 0.3 * b])
    p = np.exp(f) / np.exp(f).sum(1)[:, None]
    y = np.array([r.choice(3, p=q) for q in p])
    rows = [(f"a{i}", f"b{j}", "xyz"[k], int(g)) for i, j, k, g in zip(a, b, y, c)]
    odd = [(None, "b0", "x", 1), ("a0", None, "y", 1), ("a0", "b0", None, 1), ("a0", "b0", "x", None)]
    df = spark.createDataFrame(rows + odd, "a string, b string, o string, g int").withColumnRenamed("g", "n").repartition(5)
    got = multinomial.multinomial(df, "o", {"a": "a0", "b": "b1"}, "x", "n").collect()
    x = np.column_stack([np.ones(n), a == 1, a == 2, b == 0]).astype(float)
    beta, errors = plain(x, y, 2, c.tolist())
    assert [(v.outcome, v.term) for v in got] == [(o, t) for o in "yz" for t in ("intercept", "a=a1", "a=a2", "b=b0")]
    assert [v.coef for v in got] == pytest.approx(beta.tolist(), abs=1e-7)
    assert [v.std_err for v in got] == pytest.approx(errors.tolist(), abs=1e-7)
    alone = multinomial.multinomial(df.dropna(), "o", {"a": "a0"}, "x").collect()
    count = lambda i, k: sum(v == f"a{i}" and o == k for v, _, o, _ in rows)
    assert {(v.outcome, v.term): v.coef for v in alone}["y", "a=a2"] == pytest.approx(np.log(count(2, "y") * count(0, "x") / count(2, "x") / count(0, "y")), abs=1e-8)
    assert all(v.std_err is None for v in alone)


def test_odd_tables(spark):
    df = spark.createDataFrame([("u", "x"), ("v", "x")], "f string, o string")
    assert multinomial.multinomial(df, "o", {"f": "u"}, "x").count() == 0 and multinomial.multinomial(df.where("false"), "o", {"f": "u"}, "x").count() == 0
    with pytest.raises(ValueError):
        multinomial.multinomial(df.union(spark.createDataFrame([("v", "y")], df.schema)), "o", {"f": "absent"}, "x")
