"""Topic tables over assignments (doc_id, topic, industry, ...); topic -1 is the outlier topic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import scalars as S


def _count(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def domination(t: DataFrame, post: str, subreddit: str) -> DataFrame:
    """Documents, posts, largest post and three largest posts, largest subreddit with shares, and the flags they raise."""
    posts = _count(t, "topic", post).withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), post)))
    p = posts.groupBy("topic").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("posts"), F.max("n").alias("largest_post"), F.sum(F.when(F.col("r") <= 3, F.col("n"))).alias("top3"))
    s = _count(t, "topic", subreddit).groupBy("topic").agg(F.count(F.lit(1)).alias("subreddits"), F.max("n").alias("largest_subreddit"))
    share = lambda c: F.round(F.col(c) / F.col("n"), 4)
    out = p.join(s, "topic").withColumns({"post_share": share("largest_post"), "top3_share": share("top3"), "subreddit_share": share("largest_subreddit")})
    return out.withColumn("flagged", (F.col("post_share") >= 0.4) | (F.col("top3_share") >= 0.6) | (F.col("subreddit_share") >= 0.8))


def topic_by_group(t: DataFrame) -> DataFrame:
    """(topic, industry, n, share of the industry, share of its non-outliers)."""
    w = Window.partitionBy("industry")
    inside = F.sum(F.when(F.col("topic") != -1, F.col("n"))).over(w)
    shares = {"share_all": F.col("n") / F.sum("n").over(w), "share_inside": S.ratio(F.col("n"), inside)}
    return _count(t, "topic", "industry").withColumns(shares)


def topic_breadth(t: DataFrame, post: str, subreddit: str) -> DataFrame:
    """(topic, industry, n, posts, subreddits): how many distinct posts and subreddits each cell has, blanks ignored."""
    filled = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string")))
    return t.groupBy("topic", "industry").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(filled(post)).alias("posts"), F.count_distinct(filled(subreddit)).alias("subreddits"))


def spread_entropy(t: DataFrame, groups: int, least_n: int = 10, least_share: float = 0.005) -> DataFrame:
    """How evenly a topic spreads over groups, from prevalences; 1 is even. Outliers, too, are divided by the non-outliers."""
    m = topic_by_group(t)
    q = F.col("share_inside") / F.sum("share_inside").over(Window.partitionBy("topic"))
    g = m.withColumn("q", q).groupBy("topic")
    return g.agg((-F.sum(F.when(F.col("q") > 0, F.col("q") * F.ln("q")).otherwise(0.0)) / F.ln(F.lit(float(groups)))).alias("entropy"), F.sum((F.col("n") >= least_n).cast("long")).alias("groups_n"), F.sum((F.col("share_inside") >= least_share).cast("long")).alias("groups_share"))


def sharedness(t: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence in bits of a topic's groups from the groups of all documents; outliers count in the baseline only."""
    base = _count(t, "industry", name="all_n").withColumn("q", F.col("all_n") / F.sum("all_n").over(Window.partitionBy()))
    grid = t.where("topic <> -1").select("topic").distinct().crossJoin(F.broadcast(base))  # topics by groups: a small table
    cells = grid.join(_count(t, "topic", "industry"), ["topic", "industry"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    cells = cells.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("topic"))).withColumn("m", (F.col("p") + F.col("q")) / 2)
    kl = lambda a: F.sum(F.when(F.col(a) > 0, F.col(a) * F.log2(F.col(a) / F.col("m"))).otherwise(0.0))
    return cells.groupBy("topic").agg(F.sum("n").alias("n"), ((kl("p") + kl("q")) / 2).alias("jsd"), F.min_by("industry", F.struct(-F.col("p"), "industry")).alias("dominant"))


def enrichment(t: DataFrame, clip: float = 3.0) -> DataFrame:
    """log2 of a topic's share in a group over its share in all, null for zero, clipped; substantive topics only, dense."""
    c = _count(t.where("topic <> -1"), "topic", "industry")
    grid = c.select("topic").distinct().crossJoin(F.broadcast(c.select("industry").distinct()))
    d = grid.join(c, ["topic", "industry"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    of = lambda *by: F.sum("n").over(Window.partitionBy(*by))
    ratio = (F.col("n") / of("industry")) / (of("topic") / of())
    return d.select("topic", "industry", "n", F.least(F.greatest(S.log2_or_null(ratio), F.lit(-clip)), F.lit(clip)).alias("log2_enrichment")).withColumn("log2_enrichment", F.when(F.col("n") > 0, F.col("log2_enrichment")))


def composition(t: DataFrame, by: str, part: str) -> DataFrame:
    c = _count(t, by, part)
    return c.withColumn("percent", F.col("n") * 100 / F.sum("n").over(Window.partitionBy(by)))


def crosswalk(t: DataFrame, k: int = 3) -> DataFrame:
    """The k locked topics that overlap most with each (topic, industry); shares are of all its documents."""
    c = _count(t, "topic", "industry", "locked")
    w = Window.partitionBy("topic", "industry")
    ranked = c.withColumns({"share": F.col("n") / F.sum("n").over(w), "rank": F.row_number().over(w.orderBy(F.desc("n"), F.asc("locked")))})
    return ranked.where((F.col("rank") <= k) & F.col("locked").isNotNull())


def merged_topics(t: DataFrame, mapping: DataFrame) -> DataFrame:
    """mapping (topic, decision, target, label): topics to merge count under their target."""
    c = _count(t.where("topic <> -1"), "topic").join(F.broadcast(mapping), "topic", "left")
    c = c.withColumn("reported", F.when(F.col("decision") == "merge", F.col("target")).otherwise(F.col("topic")))
    g = c.groupBy("reported").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("topics"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


#: Words whose runs a task counts at once, but for a longer text.
_WORDS = 1 << 18


def _run_batches(by: str, words: str, n_max: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(by, term, n) of runs of up to n_max words, added up within each _WORDS words."""

    def counted(classes: pa.Array, lists: pa.Array) -> pa.Table:
        seen: dict[str, int] = {}
        code = np.array([seen.setdefault(repr(x), len(seen)) for x in classes.to_pylist()])
        row = np.repeat(np.arange(len(lists)), np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64))
        flat, out = lists.flatten(), []
        for n in range(1, min(n_max, len(flat)) + 1):
            runs = [flat.slice(k, len(flat) - n + 1) for k in range(n)]
            term = flat if n == 1 else pc.binary_join_element_wise(*runs, " ")
            out.append(pa.table({"code": code[row[: len(row) - n + 1]], "term": term}).filter(pa.array(row[: len(row) - n + 1] == row[n - 1 :])))
        if not out:
            return pa.table({by: classes.slice(0, 0), "term": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        found = pa.concat_tables(out).group_by(["code", "term"]).aggregate([([], "count_all")])
        first = np.unique(code, return_index=True)[1]
        return pa.table({by: classes.take(pa.array(first[found.column("code").to_numpy()])), "term": found.column("term"), "n": found.column("count_all")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(np.nan_to_num(pc.list_value_length(batch.column(words)).to_numpy(zero_copy_only=False)))
            at = 0
            while at < batch.num_rows:
                until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _WORDS, "right")))
                yield from counted(batch.column(by).slice(at, until - at), batch.column(words).slice(at, until - at)).combine_chunks().to_batches()
                at = until

    return run


def class_tfidf(docs: DataFrame, words: str, by: str, k: int, max_df: float = 0.8, min_df: int = 1, n_max: int = 1) -> DataFrame:
    """c-TF-IDF: a term's share of its class's terms times ln(1 + A / f), A being terms per class; the best k terms, runs of up to n_max words among them. Document frequency counts classes.

    Runs are counted within tasks and dealt by term, once; a class's total is summed in its own small table, so no task holds a class.
    """
    kind = docs.select(by).schema[0].dataType.simpleString()
    runs = docs.select(by, words).mapInArrow(_run_batches(by, words, n_max), f"`{by}` {kind}, term string, n long")
    c = runs.where("term IS NOT NULL").repartition("term").groupBy(by, "term").agg(F.sum("n").alias("n"))
    totals = c.groupBy(by).agg(F.sum("n").alias("total"))
    classes = totals.agg(F.avg("total").alias("a"), F.count(F.lit(1)).alias("classes"))
    term, cls = Window.partitionBy("term"), Window.partitionBy(by)
    c = c.withColumns({"f": F.sum("n").over(term), "df": F.count(F.lit(1)).over(term)})
    c = c.crossJoin(F.broadcast(classes)).where((F.col("df") >= min_df) & (F.col("df") <= F.greatest(F.col("classes") * max_df, F.lit(1.0))))
    own = totals.select(F.col(by).alias("_of"), "total")  # a row for each class
    c = c.join(F.broadcast(own), F.col(by).eqNullSafe(F.col("_of"))).withColumn("score", F.col("n") / F.col("total") * F.ln(1 + F.col("a") / F.col("f")))
    return c.withColumn("rank", F.row_number().over(cls.orderBy(F.desc("score"), "term"))).where(F.col("rank") <= k).select(by, "term", "score", "rank")


def topics_per_class(docs: DataFrame, words: str, topic: str, by: str, k: int = 10, max_df: float = 1.0) -> DataFrame:
    """The k best c-TF-IDF terms of each topic within each class: (topic, class, term, score, rank)."""
    own = docs.withColumn("_cell", F.struct(F.col(topic).alias("topic"), F.col(by).alias(by)))
    return class_tfidf(own, words, "_cell", k, max_df).select("_cell.topic", f"_cell.{by}", "term", "score", "rank")


def topic_summary(t: DataFrame, words: DataFrame, examples: DataFrame, k: int = 10) -> DataFrame:
    """One row a topic: n, share, share inside, its terms in order, the flags of domination, its nearest documents.

    words (topic, term, rank) and examples (topic, doc_id, rank) hold a few rows for each topic; a topic without any gets blanks.
    """
    listed = lambda df, c, out: df.where(F.col("rank") <= k).groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(c).cast("string").alias("x")))), lambda s: s["x"]), "; ").alias(out))
    inside = F.sum(F.when(F.col("topic") != -1, F.col("n"))).over(Window.partitionBy())
    counted = domination(t, "post", "subreddit").withColumns({"share": F.col("n") / F.sum("n").over(Window.partitionBy()), "share_inside": F.when(F.col("topic") != -1, F.col("n") / inside)})
    out = counted.join(listed(words, "term", "terms"), "topic", "left").join(listed(examples, "doc_id", "examples"), "topic", "left")
    return out.select("topic", "n", "share", "share_inside", "posts", "subreddits", "flagged", F.coalesce("terms", F.lit("")).alias("terms"), F.coalesce("examples", F.lit("")).alias("examples"))


def representatives(vectors: DataFrame, k: int = 10) -> DataFrame:
    """The k documents (doc_id, topic, v) nearest by cosine to their topic's mean."""
    rows = vectors.where("topic <> -1").select("doc_id", "topic", F.col("v").cast("array<double>").alias("v"))
    first = rows.select(F.size("v").alias("n")).first()
    mean = rows.groupBy("topic").agg(F.array(*[F.avg(F.col("v")[i]) for i in range(first["n"] if first else 1)]).alias("m"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    dots = rows.join(mean, "topic").select("topic", "doc_id", (dot("v", "m") / F.sqrt(dot("v", "v") * dot("m", "m"))).alias("cosine"))
    return dots.withColumn("cosine", F.round("cosine", 6)).withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("cosine"), "doc_id"))).where(F.col("rank") <= k)


def overview(t: DataFrame) -> DataFrame:
    c = _count(t, "topic")
    inside = F.when(F.col("topic") != -1, F.col("n"))
    return c.agg(F.count(inside).alias("topics"), F.sum("n").alias("documents"), F.coalesce(F.sum(F.when(F.col("topic") == -1, F.col("n"))), F.lit(0)).alias("outliers"), (F.max(inside) / F.sum("n")).alias("largest_share"), (F.max(inside) / F.sum(inside)).alias("largest_share_inside"))


def choose_model(rows: list[dict], preferred: int, least: int = 20, most: int = 60, share: float = 0.3) -> dict:
    """From overviews (size, topics, largest_share, flags, outlier_rate): the preferred size if it is workable or none is, else the workable one with fewest flags, then outliers."""
    ok = [r for r in rows if least <= r["topics"] <= most and r["largest_share"] <= share]
    first = next(r for r in rows if r["size"] == preferred)
    return first if first in ok or not ok else min(ok, key=lambda r: (r["flags"], r["outlier_rate"]))


def total_share(value: Column) -> Column:
    return value / F.sum(value).over(Window.partitionBy())
