"""Ranks and quantiles that no task computes alone, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import quantiles, ranking


def rows(n=3000):
    r = random.Random(3)
    out = [(i, r.choice(["hot", "hot", "hot", "a", None]), r.choice([None, r.gauss(0, 1), r.expovariate(1e-3), 7.0])) for i in range(n)]
    return out + [(-1, "nulls", None), (-2, "one", 4.5), (-3, "two", 1.0), (-4, "two", 2.0)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), "id long, g string, x double").repartition(7)


def test_global_rank(table):
    got = ranking.ranked(table, [F.desc("x"), "id"], "r").collect()
    want = sorted(rows(), key=lambda t: (t[2] is None, -(t[2] or 0), t[0]))
    assert {t.id: t.r for t in got} == {t[0]: i + 1 for i, t in enumerate(want)}
    assert ranking.ranked(table.where("false"), ["id"]).count() == 0


@pytest.mark.parametrize("by", [["g"], ["g", "x"]])
def test_rank_in_groups(table, by):
    got = ranking.ranked(table, [F.desc("id")], "r", by).collect()
    groups = {}
    for t in rows():
        groups.setdefault(tuple({"g": t[1], "x": t[2]}[c] for c in by), []).append(t[0])
    want = {i: n for own in groups.values() for n, i in enumerate(sorted(own, reverse=True), 1)}
    assert {t.id: t.r for t in got} == want


def test_quantiles(table, monkeypatch):
    at = {"low": 0.025, "mid": 0.5, "high": 0.975, "first": 0.0, "last": 1.0}
    own = {}
    for _, g, x in rows():
        own.setdefault(g, []).extend([] if x is None else [x])
    for bins, few in ((2048, 2048), (4, 3)):  # the second one refines again and again
        monkeypatch.setattr(quantiles, "BINS", bins)
        monkeypatch.setattr(quantiles, "FEW", few)
        got = quantiles.quantiles(table, "g", "x", at).collect()
        assert {r.g for r in got} == set(own) and len(got) == len(own)
        for r in got:
            for name, q in at.items():
                assert r[name] is None if not own[r.g] else r[name] == pytest.approx(np.quantile(own[r.g], q), rel=1e-12)
    assert quantiles.quantiles(table.where("false"), "g", "x", at).count() == 0
