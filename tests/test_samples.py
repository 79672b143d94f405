"""Shares, stratified samples and concordances against the loops that define them."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import allocation, concordance
from textloom.operators.sampling import sqrt_allocation


def test_shares_equal_the_loop(spark):
    r = random.Random(5)
    groups = {f"g{i}": {f"s{k:02d}": r.choice([0, 1, 2, 3, r.randint(1, 40), r.randint(1, 2000)]) for k in range(r.randint(1, 30))} for i in range(40)}
    for factor in (0.05, 0.4, 0.95, 3):
        target = {g: max(1, int(sum(s.values()) * factor)) for g, s in groups.items()}
        rows = [(g, s, n, target[g]) for g, own in groups.items() for s, n in own.items()]
        sizes = spark.createDataFrame(rows, "g string, s string, n long, t long").repartition(3)
        got = {}
        for x in allocation.sqrt_allocation(sizes, "g", "s", "n", F.col("t")).collect():
            got.setdefault(x.g, {})[x.s] = x.share
        for g, own in groups.items():
            own = {k: v for k, v in sorted(own.items()) if v}
            assert got.get(g, {}) == (sqrt_allocation(own, min(target[g], sum(own.values()))) if own else {}), (g, factor)


def md5(*parts):
    return hashlib.md5("#".join(map(str, parts)).encode()).hexdigest()


def drawn(rows, n, cap):
    """Rows (id, post) in md5 order, at most cap of a post, then whatever is left."""
    order, seen, first, rest = sorted(rows, key=lambda x: (md5("s", x[0]), x[0])), Counter(), [], []
    for row in order:
        (first if seen[row[1]] < cap else rest).append(row)
        seen[row[1]] += 1
    return [x[0] for x in (first + rest)[:n]]


def test_stratified_sample(spark):
    r = random.Random(6)
    rows = [(i, r.choice("ab"), r.choice(["x", "y", "z", None]), r.choice(["p", "q", f"r{i}"]), "clash") for i in range(400)] + [(None, "a", "x", "p", "")]
    df = spark.createDataFrame(rows, "id long, g string, s string, p string, n string").repartition(4)
    got = allocation.stratified_sample(df, "g", "s", "p", "id", 50, 3, "s").collect()
    for g in "ab":
        own = {}
        for i, h, s, p, _ in rows:
            if h == g and i is not None:
                own.setdefault(s or "", []).append((i, p))
        shares = sqrt_allocation({s: len(x) for s, x in sorted(own.items())}, 50)
        want = sorted(i for s, x in own.items() for i in drawn(x, shares[s], 3))
        assert sorted(x.id for x in got if x.g == g) == want and len(want) == 50
    # Shares that draw too few: the rest of the group fills up. Shares that draw too many: the first by name count.
    shares = spark.createDataFrame([("a", "x", 4), ("a", "y", 6), ("b", "x", 40), ("b", "y", 40)], "g string, s string, share long")
    few = allocation.stratified_sample(df, "g", "s", "p", "id", 20, 3, "s", shares).collect()
    assert Counter(x.g for x in few) == {"a": 20, "b": 20} and {x.s for x in few if x.g == "b"} == {"x"}
    first = [i for s, n in (("x", 4), ("y", 6)) for i in drawn([(i, p) for i, h, t, p, _ in rows if h == "a" and t == s and i is not None], n, 3)]
    others = [(i, p) for i, h, _, p, _ in rows if h == "a" and i is not None and i not in first]
    assert sorted(x.id for x in few if x.g == "a") == sorted(first + drawn(others, 10, 3))
    assert allocation.stratified_sample(df.where("false"), "g", "s", "p", "id", 5, 1, "s").count() == 0
    assert allocation.stratified_sample(df, "g", "s", "p", "id", 1000, 1, "s").count() == 400


def test_concordances(spark):
    r = random.Random(7)
    terms = ["the", "not the", "don't", "a b a", "été", "x_1", "absent", "b", "B"]
    words = ["the", "The", "THE", "not", "don't", "don", "a", "b", "été", "étés", "x_1", "x", "the-b", "b's", "(a", "b)", "a."]
    rows = [(None, "the"), (1, None), (2, ""), (3, "nothe then the"), (3, "the the")] + [(i, "".join(r.choice(words) + r.choice([" ", " ", "\n ", "  "]) for _ in range(r.randint(1, 80)))) for i in range(10, 130)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "id long, t string, `left` string").repartition(5)
    got = {}
    for x in concordance.concordances(df, "id", "t", terms, 7, 9, "s").collect():
        got.setdefault(x.term, []).append((x["rank"], x.id, x.left, x.hit, x.right))
    clean = lambda t: (t or "").lower().replace("n't", " not")
    for term in {t.lower() for t in terms}:
        hits, pattern = [], re.compile(r"\b" + r"\s+".join(map(re.escape, term.split(" "))) + r"\b", re.I)
        for i, t in rows:
            c = clean(t)
            m = pattern.search(c)
            if m and i is not None:
                hits.append((md5("s", term, i), i, c[max(0, m.start() - 9) : m.start()], m[0], c[m.end() : m.end() + 9]))
        want = [(n, *h[1:]) for n, h in enumerate(sorted(hits)[:7], 1)]
        assert sorted(got.get(term, [])) == want, term
    assert "absent" not in got and concordance.concordances(df.where("false"), "id", "t", terms).count() == 0
    with pytest.raises(ValueError):
        concordance.Finder(["(the"])
