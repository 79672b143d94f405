"""Operators against brute force on small fixtures with nulls, ties, repeats, long texts and empty tables."""

import hashlib
import math
import random
from collections import Counter
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import best_fit_packing, bpe, exact_dedup, license_scan, line_dedup, secret_scan, simhash, substring_dedup, tokens, vector_search

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    base = [" ".join(word() for _ in range(n)) for n in (0, 1, 2, 60, 120, 200, 400)]
    shared = " ".join(word() for _ in range(55))
    out = [None, "", *base, base[4], base[4].replace(" ", "\n"), base[5] + " x", shared + " a b", "c " + shared, base[3].upper()]
    return [(i, t, "extra") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), "doc_id long, text string, digest string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def test_exact(docs, empty):
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t, _ in texts()}
    size = {i: len(t or "") for i, t, _ in texts()}
    for r in exact_dedup.exact_duplicates(docs).collect():
        group = [i for i in norm if norm[i] == norm[r.doc_id]]
        assert (r.keep_id, r.group_size) == (min(group, key=lambda i: (-size[i], i)), len(group))
        assert r.kept == (r.doc_id == r.keep_id) and r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_simhash(docs, empty):
    prints = {i: simhash.fingerprint(t) for i, t, _ in texts()}
    least = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    least[a] = least[b] = min(least[a], least[b])
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {i: (prints[i], least[i]) for i in prints}
    assert simhash.near_duplicates(empty).count() == 0


def test_substring(docs, empty, monkeypatch):
    words = {i: WORDS.findall(t or "") for i, t, _ in texts()}
    first: dict = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    merges, compact = [], substring_dedup.FingerprintLog.compact
    monkeypatch.setattr(substring_dedup.FingerprintLog, "compact", lambda log: merges.append(len(log.runs)) or compact(log))
    for parts, fanout in ((2, 4), (3, 2)):  # the third batch meets a compacted run
        found = substring_dedup.remove_repeats(docs, parts=parts, fanout=fanout).collect()
        assert len(found) == docs.count()
        for r in found:
            w = words[r.doc_id]
            gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < r.doc_id for p in range(k, k + 50)}
            assert (r.n_words, r.n_removed) == (len(w), len(gone))
            assert r.kept_text == " ".join(x for p, x in enumerate(w) if p not in gone)
    assert merges == [2, 2]
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_packing(docs):
    packed = best_fit_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=64).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text, _ in texts():
        ids = [x for r in sorted((r for r in packed if r.doc_id == i), key=lambda r: r.piece) for x in np.frombuffer(r.ids, "<u4").tolist()]
        assert ids == [*t.encode(text or "", add_special_tokens=False).ids, 0]
    by: dict = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def test_plan_reaches_every_rank():
    histogram = {n: 7 + n % 5 for n in range(1, 200)}
    plan = best_fit_packing.plan_slots(histogram, 200)
    for n, count in histogram.items():
        assert sorted(r for row in plan if row[0] == n for r in range(row[1], row[1] + row[2])) == list(range(count))


def test_bpe():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.encoder(path)[0]
    want = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.load_ranks(path), special_tokens={})
    for text in ["", "a" * 3000, " \n\n x", "don't 日本語", *[t or "" for _, t, _ in texts()]]:
        ids = own.encode(text)
        assert ids == want.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_secrets(spark):
    key = "q7Rk2Zp9Xw4Lm8Tn3Vb6Yc1J"
    rows = [(1, f"é token = '{key}' x"), (2, None), (3, "AKIA" + "A1" * 8), (4, "password: short"), (5, "f" * 31 + "g" + "0a" * 16)]
    got = {r.doc_id: r for r in secret_scan.secrets_found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].spans == f"assign:2:{11 + len(key)},entropy:11:{11 + len(key)}"
    assert [got[i].spans for i in (2, 4)] == ["", ""] and got[3].n_access == 1 and got[5].spans.startswith("hex:32:64")


def spans_by_hand(text):
    """All spans of a text, by plain loops."""
    found = []
    for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[1]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    entropy = set()
    for pattern, width, threshold in (("[0-9a-fA-F]{32,}", 32, 3.0), ("[A-Za-z0-9+/_=-]{24,}", 24, 3.9)):
        for m in re.finditer(pattern, text):
            v = m[0]
            if not (re.search("[0-9]", v) and re.search("[A-Za-z]", v)) or any(re.search(p, v) for p in secret_scan.ALLOWED):
                continue
            filler = [False] * len(v)
            shown = v
            for p, n in secret_scan.FILLERS.items():
                for f in [*re.finditer(p, shown)]:
                    filler[f.start() : f.end()] = [True] * n
                shown = "".join(" " if x else c for c, x in zip(v, filler, strict=True))
            for at in range(len(v) - width + 1):
                if any(filler[at : at + width]):
                    continue
                total = sum(secret_scan.c_log_c(c) for c in Counter(v[at : at + width]).values())
                if total <= round((math.log2(width) - threshold) * width * secret_scan.SCALE):
                    entropy.add((m.start(), 3, m.end()))
                    break
    return sorted([*found, *entropy])


def test_secrets_equal_a_scan_by_hand(spark, empty):
    r = random.Random(11)
    run = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    base64, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", "0123456789abcdef"
    parts = ["é", "word", "\n", " ", "password", "API_KEY", "=", ": '", "token = ", "example", "AAAAAAAAA", "12345678", "a/b/c/d/e1", "src_12345", "🙂"]
    made = lambda: [r.choice(parts), run(base64, r.randrange(40)), run(hexa, r.choice([0, 8, 31, 32, 33, 50])), "AKIA" + run("AKI019", r.randrange(20)), run("ab1", r.randrange(60)), run("0123456789abcdefABCDEF", r.randrange(60))]
    rows = [(i, "".join(r.choice(made()) + r.choice(["", " ", "\n", "-"]) for _ in range(r.randrange(1, 25)))) for i in range(250)]
    rows += [(250, None), (251, ""), (None, "token=abcdefgh1"), (252, "AKIA " * 600 + "password=0123456789 " * 700), (253, run(base64, 3000)), (254, "A" * 9 + run(base64, 40)), (255, run("ab", 30) + "example" + run(base64, 24)), (255, "secret: zzzzzzzz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("assign", "hex", "spans")})
    names = ("assign", "access", "hex", "entropy")
    want = []
    for i, text in rows:
        spans = [(names[k], s, e) for s, k, e in spans_by_hand(text or "")]
        line = lambda some: ",".join(f"{k}:{s}:{e}" for k, s, e in some)
        base = [x for x in spans if x[0] != "entropy"]
        want.append((i, *[sum(x[0] == k for x in spans) for k in names], hashlib.sha256(line(base).encode()).hexdigest(), line(spans)))
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    got = sorted((tuple(x) for x in secret_scan.secrets_found(df).collect()), key=key)
    assert got == sorted(want, key=key)
    assert sum(x[4] for x in got) > 50 and secret_scan.secrets_found(empty).count() == 0


def test_lines(spark):
    r = random.Random(5)
    base = [[f"w{r.randrange(60)}" for _ in range(n)] for n in (3, 4, 5, 8, 10, 12, 12, 20, 40, 90)]
    lines = [" ".join(b) for b in base] + [" ".join([*b[:-1], "z"]) for b in base] + [" ".join(b) for b in base[:3]] + ["", "\t"]
    # Many sets that share rare words, on both sides of the threshold.
    for _ in range(300):
        b = list(r.choice(base))
        for _ in range(r.randrange(4)):
            b[r.randrange(len(b))] = f"w{r.randrange(70)}"
        lines.append(" ".join(b))
    rows = [(None, "w1 w2 w3 w4 w5"), (0, None), (1, "\n".join(lines[:90])), (2, "\n".join(lines[90:])), (3, "w1 w2 w3 w5 w4\nw1")]
    found = line_dedup.line_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(x.doc_id, x.line): x.matched for x in found}
    seen: list = []
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            s = set(line.split())
            assert got[i, k] == any(len(s & o) >= 0.8 * len(s | o) for o in seen if s), (i, k, line)
            seen.append(s)
    assert len(found) == len(seen) and 50 < sum(got.values()) < 300
    kept = line_dedup.without_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.text for x in kept}[3] == "w1"


@pytest.mark.parametrize("t", [0.5, 0.6, 0.9])
def test_lines_at_other_thresholds(spark, t):
    """Small sets, repeated rows and rows that share an id, too."""
    r = random.Random(int(t * 10))
    line = lambda: " ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randrange(7)))
    rows = [(i, "\n".join(line() for _ in range(8))) for i in range(25)] + [(30, "a b c\na b d\na b"), (31, "zz\nyy zz"), (31, "vv ww"), (40, "q w e r\nq w e"), (40, "q w e r\nq w e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("line", "d1", "digest", "word", "size")})
    got = Counter((x.doc_id, x.line, x.matched) for x in line_dedup.line_matches(df, t).collect())
    lines = [(i, k, set(one.split())) for i, text in rows for k, one in enumerate(text.split("\n"))]
    # The lines (31, 0) of two rows have one place: the one of the smaller hash goes first, and they share no word.
    want = Counter((i, k, any(bool(s) and (j, m) < (i, k) and len(s & o) >= t * len(s | o) - 1e-9 for j, m, o in lines)) for i, k, s in lines)
    assert got == want


def test_lines_empty(empty):
    assert line_dedup.line_duplicates(empty).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (1000, [0.0] * 16), (1100, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    got = vector_search.search(df, F.col("vec_id") % 100 == 0).collect()
    hits = 0
    for q in (0, 100, 200):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        own = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        hits += len(set(own) & set(np.argsort(d)[:10].tolist()))
    assert {r.query_id for r in got} == {0, 100, 200} and hits >= 27


def test_vectors_with_repeats_equal_brute_force(spark):
    """All lists probed: exact. Ids and vectors repeat, and vectors tie."""
    rng = np.random.default_rng(8)
    v = rng.integers(-2, 3, size=(120, 6)).astype(float)
    rows = [(int(i), x.tolist()) for i, x in enumerate(v) if x.any()]
    rows += [(100, v[7].tolist())] * 3 + [rows[0]] * 4 + [(5, v[5].tolist())] * 3 + [(None, v[1].tolist()), (200, None), (300, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (400, [float("inf")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("list", "block", "part", "v")})
    got: dict = {}
    for r in vector_search.search(df, F.col("vec_id") % 100 == 0, probes=10**6).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    distinct = {(i, tuple(x)) for i, x in rows if i is not None and x and None not in x and np.isfinite(x).all() and any(x)}
    want: dict = {}
    for q, x in distinct:
        if q % 100 == 0:
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))), i) for i, y in distinct if i != q)[:10]
            want.setdefault(q, []).extend((k + 1, i, s) for k, (s, i) in enumerate(near))
    assert {q: sorted(x) for q, x in got.items()} == {q: [(a, b, pytest.approx(s)) for a, b, s in sorted(x)] for q, x in want.items()}
    assert vector_search.search(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_packing_counts_added_tokens_and_uses_few_sequences(spark, empty):
    r = random.Random(1)
    bits = ["<|endoftext|>", " ", "a", "<|", "|>", "é", "\n", "hello world", "<|endoftext|", "123", "'s", "🙂"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(12)))) for i in range(300)] + [(7, "<|endoftext|>"), (None, "x"), (None, None)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("length", "bucket", "rank")})
    packed = best_fit_packing.pack(df, path, capacity=64).collect()
    t = Tokenizer.from_file(path)
    want = Counter((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 0])) for i, x in rows)
    assert all(p.piece == 0 for p in packed) and Counter((p.doc_id, tuple(np.frombuffer(p.ids, "<u4").tolist())) for p in packed) == want
    total = sum(p.length for p in packed)
    assert -(-total // 64) <= len({p.sequence_id for p in packed}) <= -(-total // 64) + 1
    assert best_fit_packing.pack(empty, path).count() == 0


def simhash_by_hand(text):
    """Bit by bit, from the definition."""
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_the_definition():
    made = [t for _, t, _ in texts()] + ["A b", "É É é", "one", " \t\n", "x " * 500, "a\x0bb\x0cc d\u00a0e f"]
    assert [simhash.fingerprint(t) for t in made] == [simhash_by_hand(t) for t in made]


def test_licences(spark, empty):
    notices = [*license_scan.TEMPLATES.items()]
    text_of = {name: notice for name, notice in notices}
    rows = [
        (1, "a/LICENSE", text_of["MIT"]), (2, "a/b/x.txt", "no notice here"), (3, "a/b/y.txt", f"x\n# {text_of['Apache-2.0']}"), (4, "c/z.txt", None),
        (5, "LICENSE", text_of["GPL-3.0"]), (6, None, text_of["MIT"]), (7, None, ""), (8, "a/w.txt", "Licensed to warranty nobody, copyright 2020 all"),
        (4, "c/z.txt", None), (None, "c/q.txt", text_of["MPL-2.0"]), (9, "a/b/NOTICE.md", f"{text_of['BSD-3-Clause']}\n{text_of['BSD-3-Clause']}"), (10, "a/b/c/d.txt", "plain " * 5000),
    ]
    terms = lambda x: Counter(re.findall(license_scan.TERM, x.lower()))
    lines = {x for _, _, t in rows for x in (t or "").split("\n") if re.search(license_scan.CUE, x)}
    df = Counter(w for x in [*lines, *text_of.values()] for w in terms(x))
    total = len(lines) + len(notices)
    vector = lambda x: {w: c * (math.log((1 + total) / (1 + df[w])) + 1) for w, c in terms(x).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))

    def own(text):
        best = []
        for x in (text or "").split("\n"):
            if x in lines:
                for name, notice in notices:
                    a, b = vector(x), vector(notice)
                    score = round(sum(a[w] * b.get(w, 0) for w in a) / (norm(a) * norm(b)), 6)
                    best += [(-score, name)] * (score >= license_scan.THRESHOLD)
        return min(best, default=None)

    roots: dict = {}
    for _, path, text in rows:
        if path and re.search(license_scan.LICENCE_FILE, path.rpartition("/")[2]) and own(text):
            roots[path.rpartition("/")[0]] = min(own(text), roots.get(path.rpartition("/")[0], (1, "")))

    def want(path, text):
        if own(text):
            return own(text)[1], "own"
        while path:
            path = path.rpartition("/")[0]
            if path in roots:
                return roots[path][1], "inherited"
        return "", "none"

    got = license_scan.licences(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert sorted((str(r.doc_id), r.licence, r.origin) for r in got) == sorted((str(i), *want(p, t)) for i, p, t in rows)
    assert {r.origin for r in got} == {"own", "inherited", "none"}
    assert license_scan.licences(empty.withColumnRenamed("digest", "path")).count() == 0


def test_licences_in_headers_files_and_identifiers(spark):
    full = license_scan.licence_forms.full_text
    header = "\n".join(f"# {x}" for x in full("MIT").split("\n"))
    made = {
        "All rights reserved.": "All-Rights-Reserved", "(c) 2020 Foo. All rights reserved.": "All-Rights-Reserved", "MIT License": "MIT", "Licensed under the MIT license.": "MIT",
        "This document is released under the MIT License.": "MIT", "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */": "GPL-2.0",
        "SPDX-License-Identifier: Foo-1.0": "", "Licensed under the Foo License.": "", "Wir reisen mit dem Zug.": "", f"{header}\n\nimport os": "MIT", f"All rights reserved.\n\n{full('BSD-3-Clause')}": "BSD-3-Clause",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0", **{full(x): x for x in license_scan.licence_forms.FULL_TEXTS},
    }
    rows = [(i, None, text) for i, text in enumerate(made)]
    got = {r.doc_id: r.licence for r in license_scan.licences(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert {text[:60]: got[i] for i, _, text in rows} == {text[:60]: licence for text, licence in made.items()}
    terms = lambda x: set(re.findall(license_scan.TERM, x.lower().replace("licence", "license")))
    assert all(keys and set(keys) <= terms(text) and re.search(license_scan.CUE, text) for _, text, keys in license_scan.licence_forms.forms())
