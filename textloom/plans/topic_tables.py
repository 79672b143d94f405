"""Registered queries: terms of several words, and the breadth of topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.operators import topics
from textloom.plans.catalogue import _WORDS, COMMENTS, TOPICS, assignments, comments, query, worded


@query(
    "q34_ctfidf_ngrams",
    f"""WITH {COMMENTS}, d AS (SELECT industry, {_WORDS} AS w FROM comments),
    g AS (SELECT industry, unnest(list_concat(w,
      list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
      list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS term FROM d),
    c AS (SELECT industry, term, count(*) AS n FROM g GROUP BY ALL),
    a AS (SELECT avg(t) AS a FROM (SELECT sum(n) AS t FROM c GROUP BY industry)),
    f AS (SELECT *, sum(n) OVER (PARTITION BY term) AS f, count(*) OVER (PARTITION BY term) AS df, sum(n) OVER (PARTITION BY industry) AS total FROM c),
    s AS (SELECT industry, term, n / total::DOUBLE * ln(1 + a / f::DOUBLE) AS score FROM f, a WHERE df >= 2 AND df <= 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY score DESC, term) AS rank FROM s)
    SELECT industry, term, round(score, 6) AS score, rank FROM r WHERE rank <= 15""",
)
def _ngrams(spark: SparkSession, sf: str) -> DataFrame:
    return topics.class_tfidf(worded(comments(spark, sf)), "words", "industry", 15, 0.8, 2, 3)


@query("q26_topic_industry_breadth", f"WITH {TOPICS} SELECT topic, industry, count(*) AS n, count(DISTINCT post) AS posts, count(DISTINCT subreddit) AS subreddits FROM t GROUP BY ALL")
def _breadth(spark: SparkSession, sf: str) -> DataFrame:
    return topics.topic_breadth(assignments(spark, sf), "post", "subreddit")
