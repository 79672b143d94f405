"""Each stage of the pipeline against brute force, on rows with nulls, empty texts, copies and columns of clashing names."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from textloom.llm import secret_scan, simhash, toxicity

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    first = real.orderBy("doc_id").first().text
    made = [None, "", first, first.replace(" ", "  "), first + " password: abcdefgh1 é AKIAABCDEFGHIJKL01 end"]
    rows = [(10_000_000 + i, t, "en", "made", len(t or "")) for i, t in enumerate(made)]
    own = spark.createDataFrame(rows, real.schema)
    return real.unionByName(own).withColumns({c: F.lit(c) for c in ("hex", "fp", "digest", "row", "__text")})


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def rows_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_toxicity_stage_drops_what_the_classifier_rejects(spark, docs):
    kept = corpus_pipeline.drop_toxic(spark, docs, SF_DIR)
    model = toxicity.fit(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    texts = rows_of(docs)
    margin = dict(zip(texts, model.margins([*texts.values()]), strict=True)) if model else dict.fromkeys(texts, -1)
    assert kept.columns == docs.columns and ids(kept) == sorted(i for i, m in margin.items() if m < 0)


def test_exact_stage_keeps_the_longest_of_equal_texts(spark, docs):
    groups = defaultdict(list)
    for i, t in rows_of(docs).items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    kept = corpus_pipeline.drop_copies(spark, docs, SF_DIR)
    assert kept.columns == docs.columns and ids(kept) == sorted(min(g)[1] for g in groups.values())


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) > 0


def test_near_stage_keeps_one_document_of_each_class(spark, docs):
    """The rows that stay are those that brute force over all pairs of sets keeps."""
    sets = {i: shingles(t) for i, t in rows_of(docs).items()}
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if least[b] < least[a] and alike(sets[a], sets[b]):
                    least[a], changed = least[b], True
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF_DIR)
    got = set(ids(kept))
    assert kept.columns == docs.columns and got == set(least.values())
    assert len(got) < len(set(sets.values()))


def test_near_stage_finds_pairs_at_the_threshold(spark):
    """Sets of every size at and just below a similarity of 0.8, which fingerprints alone often miss, among texts that share passages."""
    words = lambda r, n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    r, rows = random.Random(8), []
    passage = words(r, 60)
    for k in range(120):
        n = r.randint(12, 160)
        base = words(r, n) + (passage if k % 3 == 0 else [])
        changed = list(base)
        for at in r.sample(range(len(base)), max(1, len(base) // r.choice([40, 50, 60]))):
            changed[at] = f"x{k}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(changed))]
    rows += [(1000 + i, " ".join(passage + words(r, 3))) for i in range(40)]
    sets = {i: shingles(t) for i, t in rows}
    least = {i: i for i in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                if a < b and alike(sets[a], sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    kept = simhash.without_near_copies(spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, node string").repartition(5))
    close = sum(0.8 <= len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) < 0.87 for k in range(120))
    assert close >= 10 and set(ids(kept)) == set(least.values())


def test_prefixes_of_alike_sets_meet():
    r = np.random.default_rng(5)
    levels = r.integers(0, 9, simhash.GRAM_BUCKETS).astype(np.uint8)
    for n in [1, 2, 4, 5, 9, 10, *r.integers(11, 400, 60).tolist()]:
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        gone = int(len(a) * 0.2)
        b = np.unique(np.concatenate([r.permutation(a)[gone:], r.integers(0, 2**63, max(0, int(len(a) * 0.25) - gone)).astype(np.uint64)]))
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            assert len(np.intersect1d(simhash.prefix(a, levels, 0.8), simhash.prefix(b, levels, 0.8)))
            of_a, of_b = (np.frombuffer(simhash.sketch(x), "<u2")[None] for x in (a, b))
            assert simhash.can_be_alike(of_a, of_b, 0.8).all()
    many = np.unique(r.integers(0, 2**63, 3000).astype(np.uint64))
    of_half = [np.frombuffer(simhash.sketch(x), "<u2")[None] for x in (many[:2000], many[1000:])]
    assert not simhash.can_be_alike(*of_half, 0.8).any()


def test_near_candidates_are_complete_within_the_bound():
    """Whatever differs by at most two bits times the segments, less one, shares a variant."""
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.random((simhash.SEGMENTS, simhash.SEGMENT_BITS)) < 0.5
        b = a.copy().ravel()
        b[rng.choice(b.size, 2 * simhash.SEGMENTS - 1, replace=False)] ^= True
        assert min((a != b.reshape(a.shape)).sum(axis=1)) <= 1


@pytest.mark.parametrize("lead", [2, 256])
def test_nearest_earlier_equals_a_loop(monkeypatch, lead):
    """With few members all lead; with many, each one still gets a candidate wherever a leader is near."""
    monkeypatch.setattr(simhash, "ALL_LEAD", lead)
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, (6, 3)).astype(np.uint64)
    prints = centres[rng.integers(0, 6, 300)] ^ (np.uint64(1) << rng.integers(0, 63, (300, 3)).astype(np.uint64))
    group = np.sort(rng.integers(0, 9, 300))
    at, of, far = simhash._nearest_earlier(group, prints)
    apart = lambda i, j: int(np.bitwise_count(prints[i] ^ prints[j]).sum())
    got = {}
    for i, j, f in zip(at.tolist(), of.tolist(), far.tolist(), strict=True):
        assert j < i and group[i] == group[j] and f == apart(i, j) <= simhash.FAR_BITS
        got[i] = f
    want = {i: min((apart(i, j) for j in range(i) if group[i] == group[j]), default=99) for i in range(300)}
    want = {i: f for i, f in want.items() if f <= simhash.FAR_BITS}
    assert (got == want) if lead == 256 else got.keys() == want.keys()


def test_stages_judge_rows_not_ids(spark, docs):
    rows = [(3, "T"), (5, "T"), (5, "unique text"), (None, "T "), (None, "q"), (7, "x y"), (7, "x y"), (7, "xy"), (1, None), (2, ""), (2, " ")]
    made = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], docs.sparkSession.read.parquet(f"{SF_DIR}/documents.parquet").schema)
    exact = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.drop_copies(spark, made, SF_DIR).collect())
    assert exact == sorted([("None", "T "), ("5", "unique text"), ("None", "q"), ("7", "x y"), ("2", " ")])
    near = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.drop_near_copies(spark, made, SF_DIR).collect())
    assert near == sorted([("3", "T"), ("5", "unique text"), ("None", "q"), ("7", "x y"), ("7", "xy"), ("1", None)], key=lambda x: (x[0], x[1] or ""))


def test_stages_give_empty_tables_for_empty_tables(spark, docs):
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, SF_DIR)
        assert out.count() == 0
        none = out if "text" in out.columns else none


def test_secret_stage_masks_every_span_and_nothing_else(spark, docs):
    spans = {r.doc_id: r.spans for r in secret_scan.secrets_found(docs).collect()}
    masked = corpus_pipeline.mask_secrets(spark, docs, SF_DIR)
    want = {}
    for i, text in rows_of(docs).items():
        pieces, at = [], 0
        for s, e in sorted(tuple(map(int, x.split(":")[1:])) for x in spans[i].split(",") if x):
            if s >= at:
                pieces += [text[at:s], "[SECRET]"]
            at = max(at, e)
        want[i] = "".join([*pieces, text[at:]]) if pieces else text
    assert masked.columns == docs.columns and rows_of(masked) == want
    assert want[10_000_004].endswith(" [SECRET] é [SECRET] end")


def test_packing_stage_places_every_token(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows_of(docs).items()}
    got, at = defaultdict(int), defaultdict(list)
    for r in corpus_pipeline.pack(spark, docs, SF_DIR).collect():
        got[r.doc_id] += r.length
        at[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for pieces in at.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048


def test_run_gives_the_packed_pieces(spark):
    packed = corpus_pipeline.run(spark, SF_DIR)
    known = set(ids(spark.read.parquet(f"{SF_DIR}/documents.parquet")))
    assert set(ids(packed)) <= known and packed.columns[:3] == ["doc_id", "piece", "start"]


def test_toxicity_learns_words_of_the_positives(spark):
    clean = [(i, f"the river runs past field {i % 7} and mill {i % 5}", 0) for i in range(400)]
    toxic = [(1000 + i, f"the river is vileword past field {i % 7}", 1) for i in range(80)]
    made = spark.createDataFrame([*clean, *toxic, (2000, None, None), (2001, "", None)], "doc_id long, text string, toxic int")
    rows = toxicity.toxic_scores(made.select("doc_id", "text"), made.select("doc_id", "toxic")).collect()
    assert len(rows) == 482 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.predicted == (1000 <= r.doc_id < 2000) for r in rows)
    nobody = toxicity.toxic_scores(made.select("doc_id", "text"), made.select("doc_id", F.lit(0).alias("toxic")))
    assert {r.score for r in nobody.collect()} == {0.0} and toxicity.toxic_scores(made.where("false"), made.where("false")).count() == 0


def test_toxicity_learns_a_late_bucket_of_long_texts(spark):
    letters = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    late = next(w for w in (f"vile{letters(i)}" for i in range(10_000)) if word_bucket(w) > toxicity.BUCKETS * 0.99)
    filler = lambda i: " ".join(f"w{letters(i % 40 * 37 + k)}" for k in range(3000))
    rows = [(i, filler(i) + (f" {late}" if i >= 200 else ""), int(i >= 200)) for i in range(280)]
    made = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scored = toxicity.toxic_scores(made.select("doc_id", "text"), made.select("doc_id", "toxic")).collect()
    assert {r.doc_id for r in scored if r.predicted} == set(range(200, 280))


def test_toxicity_counts_words_in_all_unlabelled_texts(spark):
    made = spark.createDataFrame([(i, int(i >= 400)) for i in range(480)], "doc_id long, toxic int")
    sampled = [r.doc_id for r in made.where(toxicity.fold_of(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(20).collect()]
    text = F.when(F.col("doc_id").isin([i for i in sampled if i < 400]), "river field").when(F.col("toxic") == 1, "river common vileword").otherwise("river common")
    model = toxicity.fit(made.withColumn("text", text), made, max_unlabelled=20)
    assert model.weights[word_bucket("common")] == 0 and model.weights[word_bucket("vileword")] != 0


def word_bucket(word):
    return int(toxicity._occurrences([word.encode()])[0][0][1][0])


def test_toxicity_features_equal_a_count_by_hand():
    texts = [None, "Vile vile; viler été 42 vi", "", "42 ...", "vile " * 50]
    words = [re.findall(r"[a-zé]+", (t or "").lower()) for t in texts]
    want = []
    for found in words:
        times = defaultdict(int)
        for w in found:
            times[word_bucket(w)] += 1
            for k in toxicity.STEMS:
                if len(w.encode()) >= k:
                    times[int(toxicity._occurrences([w.encode()])[0][1 + k - toxicity.STEMS[0]][1][0])] += 1
        value = {b: min(toxicity.MOST, toxicity.SHARE * n / (len(found) + toxicity.FEW)) for b, n in times.items()}
        want.append(value | {b: max(value[b], toxicity.LEAST) for b in map(word_bucket, found)})
    got = [{} for _ in texts]
    for first, of, at, x, n in toxicity.features(texts):
        assert n.tolist() == [len(w) for w in words][first : first + len(n)]
        for o, a, v in zip(of.tolist(), at.tolist(), x.tolist(), strict=True):
            got[first + o][a] = v
    assert got == [pytest.approx(w) for w in want] and set(got[1]) & set(got[4])
    weights = np.random.default_rng(1).normal(size=toxicity.BUCKETS).astype(np.float32)
    by_hand = [0.5 + sum(weights[b] * v for b, v in w.items()) for w in want]
    assert toxicity.Classifier(weights, 0.5).margins(texts) == pytest.approx(by_hand, abs=1e-4)


def test_toxicity_features_do_not_depend_on_chunks(monkeypatch):
    texts = ["alpha beta", None, "gamma " * 40, "", "delta alpha", "x" * 300]
    whole = toxicity.Classifier(np.random.default_rng(2).normal(size=toxicity.BUCKETS).astype(np.float32), 0.0).margins(texts)
    monkeypatch.setattr(toxicity, "_CHUNK", 8)
    small = toxicity.Classifier(np.random.default_rng(2).normal(size=toxicity.BUCKETS).astype(np.float32), 0.0).margins(texts)
    assert (whole == small).all()


@pytest.mark.parametrize("shift", [-3.0, 0.0, 2.0])
def test_the_risk_step_follows_the_corrected_risk(shift):
    """Its gradient by the margins equals that of the risk by finite differences, or its negative part where that goes below zero."""
    rng, prior = np.random.default_rng(5), 0.3
    fp, fu = rng.normal(1, 1, 7), rng.normal(shift, 1, 11)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    negative = lambda p, u: sigmoid(u).mean() - prior * sigmoid(p).mean()
    risk = (lambda p, u: prior * (1 - sigmoid(p)).mean() + negative(p, u)) if negative(fp, fu) >= 0 else (lambda p, u: -negative(p, u))
    gp, gu = toxicity.risk_gradient(sigmoid(fp), sigmoid(fu), prior)
    for i, e in enumerate(np.eye(7) * 1e-6):
        assert gp[i] == pytest.approx((risk(fp + e, fu) - risk(fp - e, fu)) / 2e-6, abs=1e-6)
    for i, e in enumerate(np.eye(11) * 1e-6):
        assert gu[i] == pytest.approx((risk(fp, fu + e) - risk(fp, fu - e)) / 2e-6, abs=1e-6)


def test_sums_of_texts_equal_sums_by_hand(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").limit(40).collect()] + [None, "", "7"]
    held, total = np.zeros(toxicity.BUCKETS), np.zeros(toxicity.BUCKETS)
    with_words = 0
    for t in texts:
        for _, _, at, x, n in toxicity.features([t]):
            held[at] += 1
            total[at] += x
            with_words += int(n[0] > 0)
    sums = toxicity._sums(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    assert sums.texts == with_words
    assert (sums.held == held).all() and np.allclose(sums.total, total, atol=1e-4)


def test_toxic_stems_are_caught_in_words_never_seen(spark):
    """Held-out toxic texts hold other words of the same stem."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("aeiourstnl"), 7))
    rows = [(i, " ".join([word() for _ in range(60)] + (["vile" + word() for _ in range(3)] if i % 8 == 0 else [])), int(i % 8 == 0)) for i in range(1200)]
    made = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scored = [r for r in toxicity.toxic_scores(made.select("doc_id", "text"), made.select("doc_id", "toxic")).collect() if r.held_out]
    caught = np.mean([r.predicted for r in scored if r.doc_id % 8 == 0])
    false = np.mean([r.predicted for r in scored if r.doc_id % 8])
    assert caught >= 0.9 and false <= 0.02
