"""Operators 11 to 13 against brute force: nulls, ties, repeats, long and empty texts, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import periodic_runs, quality, queries, spelling

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def runs_by_hand(words):
    """Every period tried at every place."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1 if j == i else j
    return sorted((i, q, n) for (i, n), q in found.items())


def test_runs_of_random_words():
    r = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(r.randint(1, 5)):
            n, k = r.randint(0, 60), r.choice([1, 2, 2, 3, 5])
            w = [r.randrange(k) for _ in range(n)]
            a, p = r.randrange(n + 1), r.randint(1, 8)
            texts.append((w[:a] + [w[a + i % min(p, n - a)] for i in range(n - a)]) * r.choice([1, 1, 2]))
        start, length, period = periodic_runs.runs_of(np.array([x for w in texts for x in w], np.int64), np.repeat(np.arange(len(texts)), [len(w) for w in texts]))
        edges = np.cumsum([0, *map(len, texts)])
        want = [(e + i, q, n) for e, w in zip(edges, texts) for i, q, n in runs_by_hand(w)]
        assert list(zip(start, period, length)) == want


def run_texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abé\x1f ") for _ in range(r.randint(1, 2)))
    out = [None, "", " \n\t", "a", "a " * 6, "a " * 5, "x " + "a b " * 4 + "y", "p q r " * 9 + "p q " + "z " * 7, "u\x0bu\x0cu u\ru\nu"]
    out += [" ".join(word() for _ in range(n)) for n in (3, 40, 200, 900)]
    out += ["a b a b a b a b c " * 5, "longer " * 3000, out[7], out[7]]
    return out


@pytest.fixture(scope="module")
def run_docs(spark):
    rows = [(i, t, "clash", [1]) for i, t in enumerate(run_texts())] + [(None, "k l " * 5, "clash", None), (3, "a", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, runs array<int>")


def test_find_runs(run_docs):
    got = periodic_runs.find_runs(run_docs).collect()
    assert len(got) == run_docs.count()
    for row, (_, text, *_) in zip(got, run_docs.collect()):
        words = WORDS.findall(text or "")
        want = runs_by_hand(words)
        assert [(x.start, x.period, x.length) for x in row.runs] == want and row.n_words == len(words)
        gone = {i for s, q, n in want for i in range(s + q, s + n)}
        assert row.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert periodic_runs.find_runs(run_docs.where("false")).count() == 0


def op13_by_hand(doc_id, text):
    words = WORDS.findall(text or "")
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = [(s, m, q) for s, q, m in runs_by_hand(words)]
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(kept))


def write(df, folder, name="documents"):
    df.write.parquet(f"{folder}/{name}.parquet")


def test_op13_query(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.choice([0, 1, 5, 30, 120])))) for i in range(300)] + [(None, "a b c d"), (7, None), (7, "a " * 9)]
    write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tmp_path)
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    order = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got.collect()), key=order) == sorted((op13_by_hand(*x) for x in rows), key=order)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(rows):
    n = Counter()
    for doc_id, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 2}
    others = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, close in others.items():
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(others[w]), n.get(form[w])))
    return sorted(out, key=lambda r: r[0].encode())


def spelling_rows():
    r = random.Random(4)
    stems = ["".join(r.choice("abÀÿé÷") for _ in range(r.randint(6, 9))) for _ in range(40)]
    rows = [(None, None), (None, "Einzelne Wörter WÖRTER"), (1, ""), (2, "x" * 3000 + " " + "x" * 3000 + " " + "x" * 2999 + "y " + "x" * 2999 + "y"), (3, "aabbaab aabbaab aabaab7 aabbaa aabbaabb aabbaabb")]
    for i in range(400):
        w = r.choice(stems)
        k = r.randrange(len(w))
        w = r.choice([w, w, w, w[:k] + w[k + 1 :], w[:k] + r.choice("abcé") + w[k + 1 :], w[:k] + w[k] + w[k:]])
        rows.append((10 + i % 50, " ".join([w, w.upper() if w.isascii() else w, r.choice(stems)]) * r.choice([1, 2])))
    # Forms of forms: 2, 20 and 200 times; a tie for the form, which the smaller one wins.
    rows += [(500, "chainabc " * 2 + "chainabd " * 20 + "chainaed " * 200 + "tiewords " * 30 + "tiewordz " * 30 + "tiewordx " * 3)]
    return rows + [rows[9], rows[9]]


def test_spelling(spark):
    rows = spelling_rows()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    got = spelling.variants(docs).orderBy("word").collect()
    want = variants_by_hand(rows)
    assert [tuple(r) for r in got] == want
    assert any(r[2] not in (r[0], r[1]) for r in want)
    assert spelling.variants(docs.where("false")).count() == 0


def test_near_pairs_of_any_length(spark):
    r = random.Random(2)
    words = sorted({"".join(r.choice("abé") for _ in range(r.randint(1, 9))) for _ in range(300)})
    got = spelling.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long"))
    want = [(a, b) if (len(a), a) < (len(b), b) else (b, a) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)]
    assert sorted((x.short, x.long) for x in got.collect()) == sorted(want)


@pytest.mark.parametrize("name", ["op12_spelling_variants", "op13_periodic_runs"])
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cur = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in cur.description]
    got = queries.QUERIES[name](spark, sf).select(cols).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, cur.fetchall()))


def quality_rows():
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 8)))
    good = lambda: ". ".join(" ".join(word() for _ in range(r.randint(4, 12))).capitalize() for _ in range(r.randint(3, 30)))
    bad = [lambda: " ".join(word().upper() + "!!" for _ in range(60)), lambda: " | ".join(word() for _ in range(50)), lambda: (word() + " ") * 40]
    docs, labels = [], []
    for i in range(600):
        mark = int(r.random() > 0.2)
        docs.append((i, good() if mark else r.choice(bad)()))
        if i % 2:
            labels.append((i, mark))
    return docs, labels


def test_quality(spark):
    docs, labels = quality_rows()
    odd = [(None, None), (None, "a"), (1000, ""), (1001, "word " * 100_000), (docs[1][0], docs[1][1])]
    table = spark.createDataFrame([(i, t, 0.5, "clash") for i, t in docs + odd], "doc_id long, text string, score double, x string")
    marks = spark.createDataFrame([(i, m, 1) for i, m in labels] + [(2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(table, marks).collect()
    truth = {i: m for i, m in labels}
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert len({r.score for r in got if r.doc_id == docs[1][0]}) == 1
    # Labels of held-out rows don't matter, nor does a corpus without positives or rows.
    other = quality.quality_scores(table, marks.withColumn("quality", F.when(quality.fold_of(F.col("doc_id")) == 2, 0).otherwise(F.col("quality")))).collect()
    assert sorted(map(str, other)) == sorted(map(str, got))
    assert {r.score for r in quality.quality_scores(table, marks.where("quality = 0")).collect()} == {0.0}
    assert quality.quality_scores(table.where("false"), marks).count() == 0


def test_risk(spark):
    """Sums over tasks give the risk of the definition; gradient and curvature are its derivatives."""
    r = np.random.default_rng(3)
    x = r.uniform(0, 1, (200, len(quality.STATISTICS))).astype(np.float32)
    positive, w, prior = r.random(200) < 0.3, r.normal(0, 0.3, quality.WIDTH), 0.6
    table = spark.createDataFrame([(v.tolist(), bool(p)) for v, p in zip(x, positive)], "x array<float>, positive boolean").repartition(3)
    size = 5 + 2 * quality.WIDTH + quality.WIDTH**2
    total = quality._total(table, lambda b: quality.sums(quality._rows(b), b.column("positive").to_numpy(zero_copy_only=False), w), size)
    rows = quality.ramps(x.astype(np.float64))

    def value(w):
        f = rows @ w
        up, down = np.log1p(np.exp(-f)), np.log1p(np.exp(f))
        negatives = down.mean() - prior * down[positive].mean()
        return negatives, prior * up[positive].mean() + negatives + 0.5e-3 * (w[:-1] ** 2).sum()

    got = quality.risk(total, prior, w, 1e-3)
    assert np.isclose(got.negatives, value(w)[0]) and np.isclose(got.whole, value(w)[1] + max(0, -value(w)[0]))
    for k in (0, 17, quality.WIDTH - 1):
        e = np.zeros(quality.WIDTH)
        e[k] = 1e-5
        assert np.isclose((value(w + e)[1] - value(w - e)[1]) / 2e-5, got.gradient[k], atol=1e-6)
        ahead = quality.risk(quality.sums(rows, positive, w + e), prior, w + e, 1e-3).gradient
        assert np.allclose((ahead - got.gradient) / 1e-5, got.curvature[:, k], atol=1e-4)
