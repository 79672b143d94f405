"""Corpus construction: activity, ranking, tiers, caps, exclusions, roll-ups and link extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import scalars as S
from textloom.operators import ranking


def quality_label(available: Column, failures: Column) -> Column:
    """Of four: whether the totals are available, and whether any request failed."""
    label = F.when((failures > 0) & ~available, "partial_counts_no_total").when(failures > 0, "partial_counts")
    return label.when(~available, "complete_counts_no_total").otherwise("complete")


def activity(monthly: DataFrame, by: str, bucket: str, hits: str, total: str, latest_peak: bool = False, failures: DataFrame | None = None) -> DataFrame:
    """Totals, active buckets, first and last active bucket, peak (earliest or latest on ties), rate per 1000, failures and a quality label.

    The summed total counts as available where it is positive and at least as large as the summed hits; elsewhere total and rate are null.
    failures holds a row for each failed request; distinct ones count, and names meet in any case. Null counts are 0; blank names are left out.
    """
    active = F.col("_hits") > 0
    rows = monthly.where(F.trim(F.coalesce(F.col(by).cast("string"), F.lit(""))) != "").withColumns({"_hits": F.coalesce(hits, F.lit(0)), "_total": F.coalesce(total, F.lit(0))})
    number = F.dense_rank().over(Window.partitionBy(by).orderBy(bucket))
    rows = rows.withColumn("_pos", number if latest_peak else -number)
    g = rows.groupBy(by).agg(
        F.sum("_hits").alias("hits"),
        F.sum("_total").alias("total"),
        F.sum(active.cast("long")).alias("active"),
        F.min(F.when(active, F.col(bucket))).alias("first_active"),
        F.max(F.when(active, F.col(bucket))).alias("last_active"),
        F.max_by(F.when(active, F.col(bucket)), F.struct(F.col("_hits"), F.col("_pos"))).alias("peak"),
    )
    key = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    if failures is None:
        g = g.withColumn("failures", F.lit(0).cast("long"))
    else:
        failed = failures.distinct().groupBy(key(by).alias("_key")).agg(F.count(F.lit(1)).alias("failures"))
        g = g.join(failed, key(by) == F.col("_key"), "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    available = (F.col("total") >= F.col("hits")) & (F.col("total") > 0)
    rate = F.when(available, S.ratio(F.col("hits"), F.col("total")) * 1000)
    return g.select(by, "hits", F.when(available, F.col("total")).alias("total"), "active", "first_active", "last_active", "peak", rate.alias("per_1000"), "failures", quality_label(available, F.col("failures")).alias("quality"))


def dense_activity(hits: DataFrame, by: str, bucket: str, item: str, first: str, last: str) -> DataFrame:
    """Items counted once a bucket over every day from first to last, days without any too."""
    days = hits.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("_d")).select(F.date_format("_d", "yyyy-MM-dd").alias(bucket))
    seen = hits.groupBy(by, bucket).agg(F.countDistinct(item).alias("n"))
    return hits.select(by).distinct().crossJoin(F.broadcast(days)).join(seen, [by, bucket], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def rank_by(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """A global rank, by a sort of ranges and the numbers of rows before each."""
    return ranking.ranked(df, order, rank)


def tier(rank: Column, large: int = 5) -> Column:
    return F.when(rank <= large, "large_top30").otherwise("rest_top10")


def top_posts(posts: DataFrame, by: str, k_large: int, k_rest: int, tier_col: str = "tier") -> DataFrame:
    """Posts by comments, score and newest date, as many as the community's tier allows."""
    order = [F.desc("num_comments"), F.desc("score"), F.desc("created"), F.asc("post")]
    most = F.when(F.col(tier_col) == "large_top30", k_large).otherwise(k_rest)
    return posts.withColumn("post_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("post_rank") <= most)


def comment_caps(comments: DataFrame, post: str, arrival: str, cap: Column) -> DataFrame:
    """The first comments of each post in order of arrival."""
    return comments.withColumn("nth", F.row_number().over(Window.partitionBy(post).orderBy(arrival))).where(F.col("nth") <= cap)


def harmonise(posts: DataFrame, comments: DataFrame, ranked: DataFrame, by: str, k: tuple[int, int] = (30, 10), caps: tuple[int, int] = (1000, 300)) -> DataFrame:
    """Communities' tiers decide how many posts stay, and how many comments of each; unranked communities go."""
    tiers = ranked.select(by, "rank", tier(F.col("rank")).alias("tier"))
    kept = top_posts(posts.join(tiers, by), by, *k).select(by, "post", "rank", "tier", "post_rank")
    cap = F.when(F.col("tier") == "large_top30", caps[0]).otherwise(caps[1])
    return comment_caps(comments.join(kept, "post"), "post", "arrival", cap)


def sampling_audit(sampled: DataFrame, by: str, k: tuple[int, int], caps: tuple[int, int]) -> DataFrame:
    per_post = sampled.groupBy(by, "post").agg(F.min("tier").alias("tier"), F.max("post_rank").alias("post_rank"), F.count(F.lit(1)).alias("n"))
    g = per_post.groupBy(by).agg(F.min("tier").alias("tier"), F.count(F.lit(1)).alias("posts"), F.max("post_rank").alias("max_rank"), F.max("n").alias("max_comments"))
    large = F.col("tier") == "large_top30"
    bad = (F.col("posts") > F.when(large, k[0]).otherwise(k[1])).cast("int") + (F.col("max_comments") > F.when(large, caps[0]).otherwise(caps[1])).cast("int")
    return g.withColumn("violations", bad)


def exclusion_log(rows: DataFrame, id_col: str, text_col: str, group_col: str, groups: list[str], order: str, min_chars: int = 1) -> DataFrame:
    """Adds reason: '' for kept rows, else the first that holds of missing_id, duplicate_id, empty_text, deleted, unexpected_group.

    Only a kept row makes a later one a duplicate.
    """
    text = S.clean_text(F.col(text_col))
    own = F.when(F.length(text) < min_chars, "empty_text").when(F.lower(text).isin("[deleted]", "[removed]"), "deleted").when(~F.col(group_col).isin(*groups), "unexpected_group").otherwise("")
    rows = rows.withColumn("_own", own)
    missing = F.trim(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) == ""
    # Rows without an id never make duplicates, so they needn't meet.
    before = Window.partitionBy(id_col, F.when(missing, F.xxhash64(order, text_col))).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    kept_before = F.coalesce(F.max((F.col("_own") == "").cast("int")).over(before), F.lit(0)) == 1
    return rows.withColumn("reason", F.when(missing, "missing_id").when(kept_before, "duplicate_id").otherwise(F.col("_own"))).drop("_own")


def ambiguous_term_filter(context: Column, body: Column, term: str, positive: str, negative: str) -> Column:
    """True for a row that holds the term, a cue of the wrong sense, and none of the right sense, in its context or its body."""
    wrong = lambda x: x.rlike(negative) & ~x.rlike(positive)
    return context.rlike(term) & (wrong(context) | wrong(body))


def candidate_rollup(found: DataFrame, name: str, rank: str, keyword: str, order: str) -> DataFrame:
    """Candidates under their lower-cased name: best rank, keywords in order, first spelling seen, times found."""
    g = found.groupBy(F.lower(name).alias("key"))
    return g.agg(F.min(rank).alias("best_rank"), F.array_join(F.array_sort(F.collect_set(keyword)), ";").alias("keywords"), F.min_by(name, F.struct(order, name)).alias("spelling"), F.count(F.lit(1)).alias("found"))


def html_links(pages: DataFrame, id_col: str, html: str, pattern: str) -> DataFrame:
    """(id, rank, link): links that the pattern's group finds, each once a page without regard to case, ranked by place."""
    found = pages.select(F.col(id_col), F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("pos", "link")).where("link <> ''")
    once = found.groupBy(id_col, F.lower("link").alias("_k")).agg(F.min("pos").alias("pos"), F.min_by("link", "pos").alias("link"))
    return once.select(id_col, F.row_number().over(Window.partitionBy(id_col).orderBy("pos")).alias("rank"), "link")


def rank_sensitivity(df: DataFrame, name: str, a: list[Column], b: list[Column], k: int) -> DataFrame:
    """The top k under two orders: whether the sets agree, and what only one of them holds."""
    top = lambda order: df.orderBy(*order).limit(k).agg(F.array_sort(F.collect_list(name)).alias("names"))
    x, y = top(a).withColumnRenamed("names", "x"), top(b).withColumnRenamed("names", "y")
    only = lambda p, q: F.array_join(F.transform(F.array_except(p, q), lambda v: v.cast("string")), ";")
    return x.crossJoin(y).select((F.col("x") == F.col("y")).alias("same_set"), only(F.col("x"), F.col("y")).alias("only_first"), only(F.col("y"), F.col("x")).alias("only_second"))


def source_summary(df: DataFrame, source: str, group: str, flag: Column) -> DataFrame:
    """Rows, flagged rows and distinct groups by source, and over all under TOTAL."""
    g = df.withColumn("_flag", flag.cast("long")).rollup(source).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("_flag"), F.lit(0)).alias("flagged"), F.countDistinct(group).alias("groups"), F.grouping(source).alias("_g"))
    return g.select(F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(source)).alias("source"), "rows", "flagged", "groups")
