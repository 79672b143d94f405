"""How far two partitions of the same documents agree, from their contingency table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import scalars as S


def contingency(df: DataFrame, ref: str = "ref", cand: str = "cand") -> DataFrame:
    return df.groupBy(ref, cand).agg(F.count(F.lit(1)).alias("n"))


def agreement(c: DataFrame, ref: str = "ref", cand: str = "cand") -> DataFrame:
    """One row: n, ARI, NMI (arithmetic mean, natural logarithm)."""
    pairs = lambda x: x * (x - 1) / 2
    n = F.col("n").cast("double")
    cells = c.agg(F.sum(pairs(n)).alias("s"), F.sum(n).alias("total"), F.sum(n * F.ln(n)).alias("h"))
    side = lambda by, p: c.groupBy(by).agg(F.sum("n").cast("double").alias("m")).agg(F.sum(pairs(F.col("m"))).alias(f"{p}s"), F.sum(F.col("m") * F.ln("m")).alias(f"{p}h"))
    t = cells.crossJoin(side(ref, "a")).crossJoin(side(cand, "b"))
    total = F.col("total")
    expected = F.try_divide(F.col("as") * F.col("bs"), pairs(total))
    ari = F.coalesce(F.try_divide(F.col("s") - expected, (F.col("as") + F.col("bs")) / 2 - expected), F.lit(1.0))
    entropy = lambda h: F.ln(total) - F.col(h) / total
    mutual = entropy("ah") + entropy("bh") - entropy("h")
    nmi = F.coalesce(F.try_divide(mutual, (entropy("ah") + entropy("bh")) / 2), F.lit(1.0))
    return t.select(total.cast("long").alias("n"), ari.alias("ari"), nmi.alias("nmi"))


def best_overlap(c: DataFrame) -> DataFrame:
    """For each reference topic the candidate with the highest Jaccard, then intersection, then smallest id; outliers (-1) match nothing."""
    sizes_r = c.where("ref <> -1").groupBy("ref").agg(F.sum("n").alias("ref_n"))
    sizes_c = c.where("cand <> -1").groupBy("cand").agg(F.sum("n").alias("cand_n"))
    both = c.where("ref <> -1 AND cand <> -1").join(sizes_c, "cand")
    joined = sizes_r.join(both, "ref", "left")
    jaccard = S.ratio(F.col("n"), F.col("ref_n") + F.col("cand_n") - F.col("n"))
    r = F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("jaccard"), F.desc("n"), "cand"))
    best = joined.withColumn("jaccard", jaccard).withColumn("r", r).where("r = 1")
    return best.select("ref", F.coalesce("cand", F.lit(-1)).alias("cand"), "ref_n", F.coalesce("n", F.lit(0)).alias("both"), "jaccard", S.ratio(F.col("n"), F.col("ref_n")).alias("recall"))
