"""Adjusted mutual information, words of topics and the activity roll-up against plain versions."""

import random
from collections import Counter
from math import exp, lgamma, log

import numpy as np
import pytest

from textloom.operators import corpus, mutual, robustness, wording


def ami_by_hand(pairs):
    n, cells, a, b = len(pairs), Counter(pairs), Counter(x for x, _ in pairs), Counter(y for _, y in pairs)
    entropy = lambda sizes: -sum(k / n * log(k / n) for k in sizes.values())
    found = sum(k / n * log(n * k / (a[x] * b[y])) for (x, y), k in cells.items())
    expected = 0.0
    for p in a.values():
        for q in b.values():
            for k in range(max(1, p + q - n), min(p, q) + 1):
                ways = lgamma(p + 1) + lgamma(q + 1) + lgamma(n - p + 1) + lgamma(n - q + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(p - k + 1) - lgamma(q - k + 1) - lgamma(n - p - q + k + 1)
                expected += k / n * log(n * k / (p * q)) * exp(ways)
    mean = (entropy(a) + entropy(b)) / 2
    return found, expected, 1.0 if abs(mean - expected) < 1e-12 else (found - expected) / (mean - expected)


@pytest.mark.parametrize("step", [1 << 16, 3])  # the second one cuts each pair into many ranges
def test_ami(spark, monkeypatch, step):
    monkeypatch.setattr(mutual, "RANGE", step)
    r = random.Random(2)
    tables = [[(r.randrange(5), r.randrange(4)) for _ in range(60)], [(i % 3, 7 - i % 3) for i in range(30)], [(1, i) for i in range(9)], [(0, 0)] * 5, [(r.randrange(30), r.randrange(2)) for _ in range(40)]]
    tables.append([(x, x if r.random() < 0.8 else None) for x in (r.randrange(6) for _ in range(100))])
    for pairs in tables:
        got = mutual.adjusted_mutual_information(robustness.contingency(spark.createDataFrame(pairs, "ref int, cand int"))).first()
        found, expected, ami = ami_by_hand(pairs)
        assert got.n == len(pairs) and (got.mutual, got.expected, got.ami) == pytest.approx((found, expected, ami), abs=1e-9)
    assert mutual.adjusted_mutual_information(spark.createDataFrame([], "ref int, cand int, n long")).first().n == 0


def test_ami_of_a_million_rows(spark):
    """Sizes at which sums of log-factorials lose digits: independent labels are at 0, and ranges don't matter."""
    c = spark.range(1_000_000).selectExpr("id % 40 AS ref", "(id div 40) % 25 AS cand").groupBy("ref", "cand").count().withColumnRenamed("count", "n")
    got = mutual.adjusted_mutual_information(c).first()
    assert got.n == 1_000_000 and abs(got.mutual) < 1e-9 and got.expected == pytest.approx(39 * 24 / 2e6, rel=1e-2) and abs(got.ami) < 1e-3


def test_topic_words(spark):
    r = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(25)]
    docs = [(["x", "y", None][int(r.integers(0, 3))], [vocabulary[int(i)] for i in r.integers(0, 25, 6)], r.normal(size=4).tolist()) for _ in range(80)] + [("x", ["w1"], None), ("y", [], [1.0] * 4)]
    got = {}
    for row in sorted(wording.topic_words(spark.createDataFrame([(*d, "clash") for d in docs], "topic string, words array<string>, v array<double>, term string").repartition(3), "topic", "words", "v", 5, 12, 0.4).collect(), key=lambda x: (x.topic, x.rank)):
        got.setdefault(row.topic, []).append(row.term)
    n, total = {t: Counter() for t in "xy"}, Counter()
    for t, words, _ in docs:
        if t:
            n[t].update(words)
            total.update(words)
    size = {t: sum(n[t].values()) for t in "xy"}
    cos = lambda a, b: round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 12)
    mean = lambda rows: np.mean([v for _, _, v in rows], 0)
    for t in "xy":
        score = {w: k / size[t] * log(1 + sum(size.values()) / 2 / total[w]) for w, k in n[t].items()}
        left = sorted(sorted(score, key=lambda w: (-score[w], w))[:12])
        vector = {w: mean([d for d in docs if d[0] and d[2] and w in d[1]]) for w in left}
        centre, chosen = mean([d for d in docs if d[0] == t and d[2]]), []
        while len(chosen) < 5:
            best = max(left, key=lambda w: 0.6 * cos(vector[w], centre) - 0.4 * max((cos(vector[w], vector[c]) for c in chosen), default=0.0))
            chosen.append(best)
            left.remove(best)
        assert got[t] == chosen
    assert wording.topic_words(spark.createDataFrame([], "topic string, words array<string>, v array<double>"), "topic", "words", "v").count() == 0


def test_activity_labels(spark):
    rows = [("A", "2023-01", 3, 10), ("A", "2023-02", 3, 10), ("b", "2023-01", 5, 2), ("c", "2023-01", 0, 0), ("D", "2023-01", 9, 1), ("D", "2023-02", 0, 20), (" ", "2023-01", 1, 1), (None, "2023-01", 1, 1), ("e", "2023-01", None, 4)]
    failed = [("a", "2023-01", "q"), ("A", "2023-01", "q"), ("a", "2023-02", "q"), ("B", "2023-01", "q")]
    got = {r.s: r for r in corpus.activity(spark.createDataFrame(rows, "s string, m string, k long, n long"), "s", "m", "k", "n", failures=spark.createDataFrame(failed, "s string, m string, term string")).collect()}
    assert set(got) == {"A", "b", "c", "D", "e"}
    assert (got["A"].quality, got["A"].failures, got["A"].per_1000, got["A"].peak) == ("partial_counts", 3, 300.0, "2023-01")
    assert (got["b"].quality, got["b"].total, got["b"].per_1000) == ("partial_counts_no_total", None, None)
    assert (got["c"].quality, got["c"].peak, got["c"].active) == ("complete_counts_no_total", None, 0)
    assert (got["D"].quality, got["D"].total, got["D"].failures) == ("complete", 21, 0) and got["e"].hits == 0  # the sums decide, not a month
