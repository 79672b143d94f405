"""Annotation quality: confusion tables, multi-class and binary metrics, paired raters, agreement, bootstrap."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import scalars as S


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(truth, pred, n), dense over all labels of either side; rows with a blank label don't count."""
    rows = df.select(S.label(F.col(truth)).alias("truth"), S.label(F.col(pred)).alias("pred")).where("truth <> '' AND pred <> ''")
    c = rows.groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    labels = c.select("truth").union(c.select("pred")).distinct()
    grid = labels.select(F.col("truth")).crossJoin(F.broadcast(labels.select(F.col("truth").alias("pred"))))
    return grid.join(c, ["truth", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def per_class(c: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each label; 0 where nothing can be divided by."""
    hit = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0))
    t = c.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), hit.alias("hits"))
    p = c.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    out = t.join(p, "label").withColumns({"precision": S.ratio(F.col("hits"), F.col("predicted")), "recall": S.ratio(F.col("hits"), F.col("support"))})
    f1 = S.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", f1)


def multiclass(c: DataFrame) -> DataFrame:
    """One row: accuracy, macro and weighted averages, labels of low support."""
    k = per_class(c)
    weight = F.col("support") / F.sum("support").over(Window.partitionBy())
    k = k.withColumn("w", weight)
    avg = [F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")] + [F.sum(F.col(m) * F.col("w")).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")]
    return k.agg(F.sum("support").alias("n"), F.sum("hits").alias("exact"), S.ratio(F.sum("hits"), F.sum("support")).alias("accuracy"), *avg, F.sum((F.col("support") < 5).cast("long")).alias("low_support"))


def kappa(c: DataFrame) -> DataFrame:
    k = per_class(c)
    n = F.sum("support").cast("double")
    seen, chance = F.sum("hits") / n, F.sum(F.col("support") * F.col("predicted")) / (n * n)
    return k.agg(seen.alias("agreement"), chance.alias("chance")).withColumn("kappa", S.ratio(F.col("agreement") - F.col("chance"), 1 - F.col("chance")))


def gate_counts(df: DataFrame, truth: str, pred: str, *by: str) -> DataFrame:
    t, p = S.yes_no(F.col(truth)), S.yes_no(F.col(pred))
    cell = lambda a, b: F.sum(((t == a) & (p == b)).cast("long"))
    return df.where((t != "") & (p != "")).groupBy(*by).agg(cell("yes", "yes").alias("tp"), cell("no", "no").alias("tn"), cell("no", "yes").alias("fp"), cell("yes", "no").alias("fn"))


def gate_metrics(c: DataFrame) -> DataFrame:
    """From tp, tn, fp, fn: the metrics of a yes/no gate, 0 where nothing can be divided by."""
    tp, tn, fp, fn = (F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn"))
    precision, recall, specificity = S.ratio(tp, tp + fp), S.ratio(tp, tp + fn), S.ratio(tn, tn + fp)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    pattern = F.when((fp == 0) & (fn == 0), "none").when(fn > fp, "mainly_fn").when(fp > fn, "mainly_fp").otherwise("balanced")
    return c.withColumns(
        {
            "accuracy": S.ratio(tp + tn, tp + tn + fp + fn),
            "precision": precision,
            "recall": recall,
            "specificity": specificity,
            "balanced_accuracy": (recall + specificity) / 2,
            "npv": S.ratio(tn, tn + fn),
            "f1": S.ratio(2 * tp, 2 * tp + fp + fn),
            "mcc": S.ratio(tp * tn - fp * fn, root),
            "error_pattern": pattern,
        }
    )


def paired(df: DataFrame, truth: str, raters: list[str]) -> DataFrame:
    """For every pair of raters: both right, one of them, neither, and how often they say the same."""
    t, sums, rows = F.col(truth), [], []
    cell = lambda c: F.sum(c.cast("long"))
    for i, (a, b) in enumerate(combinations(raters, 2)):
        x, y = F.col(a), F.col(b)
        own = {"both": cell((x == t) & (y == t)), "only_a": cell((x == t) & (y != t)), "only_b": cell((x != t) & (y == t)), "neither": cell((x != t) & (y != t)), "agreement": F.avg((x == y).cast("double"))}
        sums += [v.alias(f"{k}_{i}") for k, v in own.items()]
        rows.append(F.struct(F.lit(a).alias("rater_a"), F.lit(b).alias("rater_b"), *[F.col(f"{k}_{i}").alias(k) for k in own]))
    return df.agg(*sums).select(F.inline(F.array(*rows)))  # one pass for all pairs


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    rows = df.select(*[F.col(f).cast("string").alias(f) for f in fields]).unpivot([], fields, "field", "value")
    blank = S.label(F.col("value")) == ""
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("rows"), F.sum(blank.cast("long")).alias("blank"), F.countDistinct(F.when(~blank, F.col("value"))).alias("values"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule."""
    sums = [F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name) for name, c in rules.items()]
    return df.agg(*sums).unpivot([], list(rules), "rule", "violations")


#: Draws that a task makes of a stratum at once.
_DRAWS = 250
GATE_METRICS = ("precision", "recall", "f1", "specificity", "balanced_accuracy", "mcc")


def stratified_bootstrap(df: DataFrame, truth: str, pred: str, stratum: str, draws: int = 5000, seed: int = 42) -> DataFrame:
    """(metric, draws, mean, ci_low, ci_high) of a yes/no gate over samples with replacement within each stratum; 2.5 and 97.5 percent quantiles, linear.

    A stratum's sample is one multinomial over its four cells, drawn on an executor with a seed of its own for each block of draws; a draw's cells
    are added up over the strata by a group-by. Rows with a blank label don't count; a null stratum counts as ''. Without rows there is no row.
    """
    cells = gate_counts(df.withColumn("_s", F.coalesce(F.col(stratum).cast("string"), F.lit(""))), truth, pred, "_s")
    blocks = df.sparkSession.range((draws + _DRAWS - 1) // _DRAWS).withColumnRenamed("id", "block")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block, *own in zip(*(batch.column(c).to_pylist() for c in ("_s", "block", "tp", "tn", "fp", "fn")), strict=True):
                first, n = block * _DRAWS, sum(own)
                size = min(_DRAWS, draws - first)
                drawn = np.random.default_rng([seed, zlib.crc32(name.encode()), block]).multinomial(n, np.asarray(own) / n, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + size)), *[pa.array(c) for c in drawn.T]], ["draw", "tp", "tn", "fp", "fn"])

    drawn = cells.crossJoin(F.broadcast(blocks)).mapInArrow(draw, "draw long, tp long, tn long, fp long, fn long")  # draws / _DRAWS numbers
    sums = drawn.groupBy("draw").agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")])
    values = gate_metrics(sums).unpivot([], list(GATE_METRICS), "metric", "value").groupBy("metric")
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))  # of `draws` values
    out = values.agg(F.count(F.lit(1)).alias("draws"), F.avg("value").alias("mean"), q.alias("q"))
    return out.select("metric", "draws", "mean", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))



def prediction_distribution(df: DataFrame, raters: list[str], codebook: list[str]) -> DataFrame:
    """(rater, label, n, percent) over the whole codebook, labels that nobody gave too. One pass for all raters."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rater"), F.col(r).alias("label")) for r in raters])).alias("x")).select("x.*")
    counts = long.groupBy("rater", "label").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    grid = df.sparkSession.createDataFrame([(r, c) for r in raters for c in codebook], "rater string, label string").join(F.broadcast(total), F.lit(True))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return grid.join(counts, ["rater", "label"], "left").select("rater", "label", n.alias("n"), (n * 100 / F.col("total")).alias("percent"))


def accuracy_by(df: DataFrame, by: str, fields: dict[str, str]) -> DataFrame:
    """(by, field, n, hits, accuracy) of each predicted field against its truth. One pass for all fields."""
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("field"), (F.col(p) == F.col(t)).alias("hit")) for p, t in fields.items()])).alias("x")
    return df.select(by, pairs).groupBy(by, F.col("x.field").alias("field")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x.hit")).alias("hits"), F.avg(F.col("x.hit").cast("double")).alias("accuracy"))


def disagreements(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """The rows whose labels differ, case and outer blanks aside."""
    same = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    return df.where(same(truth) != same(pred))


def baselines(c: DataFrame) -> DataFrame:
    """Accuracy and F1 of always saying yes and always saying no, from counts tp, fn, fp, tn."""
    p, n = F.col("tp") + F.col("fn"), F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")
    yes = F.struct(F.lit("always_yes").alias("baseline"), (p / n).alias("accuracy"), (2 * p / (n + p)).alias("f1"))
    no = F.struct(F.lit("always_no").alias("baseline"), ((n - p) / n).alias("accuracy"), F.lit(0.0).alias("f1"))
    return c.select(F.explode(F.array(yes, no)).alias("x")).select("x.*")
