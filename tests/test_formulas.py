"""Published figures and properties of the formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import scalars as S
from textloom.operators import evaluate, robustness, sampling, text
from textloom.plans import catalogue


def test_wilson_and_g2(spark):
    low, high = S.wilson(F.lit(861), F.lit(2000))
    g2 = S.g2(F.lit(14), F.lit(0), F.lit(861), F.lit(1139))
    r = spark.range(1).select(low.alias("low"), high.alias("high"), g2.alias("g2")).first()
    assert r.low == pytest.approx(0.4089529030603304) and r.high == pytest.approx(0.4523135762861409)
    assert r.g2 == pytest.approx(23.72929781251279)


def test_binary_gate(spark):
    r = evaluate.gate_metrics(spark.createDataFrame([(62, 88, 18, 32)], "tp long, tn long, fp long, fn long")).first()
    assert (r.accuracy, r.precision) == (0.75, 0.775)
    assert r.mcc == pytest.approx(0.49896185548224153) and r.balanced_accuracy == pytest.approx(0.7448815736651947)


def test_agreement_of_relabelled_copies(spark):
    rows = [(i % 3, 7 - i % 3) for i in range(30)]
    r = robustness.agreement(robustness.contingency(spark.createDataFrame(rows, "ref int, cand int"))).first()
    assert r.ari == pytest.approx(1) and r.nmi == pytest.approx(1)


@pytest.mark.parametrize("target", [1, 5, 50, 90, 500])
def test_sqrt_allocation(target):
    sizes = {"a": 1, "b": 9, "c": 80}
    got = sampling.sqrt_allocation(sizes, target)
    assert all(1 <= got[k] <= sizes[k] for k in sizes)
    assert sum(got.values()) == max(3, min(target, 90))


def test_ngrams_of_short_lists(spark):
    rows = [([],), (["a"],), (["a", "b"],)]
    got = [r[0] for r in spark.createDataFrame(rows, "w array<string>").select(S.ngrams(F.col("w"), 2)).collect()]
    assert got == [[], [], ["a b"]]


def test_stratified_bootstrap_as_by_rows(spark):
    """Intervals equal those of rows drawn one by one, within the spread of the draws; strata keep their sizes."""
    r = np.random.default_rng(3)
    rows = [(["yes", "no"][int(r.random() < 0.4 + 0.2 * k)], ["yes", "no"][int(r.random() < 0.5)], f"s{k}") for k in range(3) for _ in range(40 + 30 * k)]
    df = spark.createDataFrame([*rows, ("", "yes", "s0"), ("yes", None, "s1"), ("yes", "yes", None)], "t string, p string, s string").repartition(3)
    got = {x.metric: x for x in evaluate.stratified_bootstrap(df, "t", "p", "s", 2001).collect()}
    assert set(got) == set(evaluate.GATE_METRICS) and all(x.draws == 2001 for x in got.values())
    assert got == {x.metric: x for x in evaluate.stratified_bootstrap(df.repartition(5), "t", "p", "s", 2001).collect()}
    strata = [np.array([(t == "yes", p == "yes") for t, p, s in [*rows, ("yes", "yes", "")] if s == k]) for k in ("s0", "s1", "s2", "")]
    want = {"precision": [], "recall": []}
    for _ in range(2001):
        x = np.concatenate([s[r.integers(0, len(s), len(s))] for s in strata])
        tp = (x[:, 0] & x[:, 1]).sum()
        want["precision"].append(tp / x[:, 1].sum())
        want["recall"].append(tp / x[:, 0].sum())
    for m, v in want.items():
        assert (got[m].mean, got[m].ci_low, got[m].ci_high) == pytest.approx((np.mean(v), *np.quantile(v, [0.025, 0.975])), abs=0.012)
    assert evaluate.stratified_bootstrap(df.where("false"), "t", "p", "s").count() == 0


def test_full_stop_list_keeps_negations(spark):
    words = S.content_tokens(F.lit("But you have not liked people like them, never without things"), S.SF5_STOP_WORDS)
    assert spark.range(1).select(words.alias("w")).first().w == ["not", "liked", "never", "without"]


def test_keyword_candidates_add_frequent_terms_of_the_gate(spark):
    rows = [(i, ["common", f"only{i % 25:02d}"], "yes") for i in range(300)] + [(1000 + i, ["common", "other"], "no") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, words array<string>, gate string")
    got = [r.term for r in text.keyword_candidates(docs, "words", "gate").orderBy("pos").collect()]
    assert got == [f"only{i:02d}" for i in range(20)] + ["common"]


def test_collocations_query_reads_the_positive_gate(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r.keyword, r.collocate) for r in catalogue.QUERIES["q05_collocations"](spark, sf).collect()}
    w = catalogue.worded(catalogue.gated(spark, sf), S.SF5_STOP_WORDS)
    want = text.collocations(w.where("gate = 'yes'"), "words", text.keyword_candidates(w, "words", "gate")).collect()
    assert got == {(r.keyword, r.collocate) for r in want} and not {x for pair in got for x in pair} & set(S.SF5_STOP_WORDS)
