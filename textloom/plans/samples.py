"""Registered queries: stratified samples and concordances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import allocation, concordance
from textloom.plans.catalogue import _NORM, COMMENTS, comments, query

_TARGET, _CAP = 90, 2
#: The shares by the loops that define them: a row more or less at a time.
_SHARES = f"""
sizes AS (SELECT industry, subreddit, count(*) AS n FROM comments WHERE quality IS NOT NULL GROUP BY 1, 2),
listed AS (SELECT industry, list(subreddit ORDER BY subreddit) AS names, list(n ORDER BY subreddit) AS ns, sum(sqrt(n)) AS root, least({_TARGET}, sum(n))::BIGINT AS target FROM sizes GROUP BY 1),
step AS (
  SELECT industry, names, ns, target, list_transform(ns, lambda x: least(greatest(round_even(target * sqrt(x) / root, 0)::BIGINT, 1), x)) AS shares FROM listed
  UNION ALL
  SELECT industry, names, ns, target, CASE WHEN list_sum(shares) > target
    THEN list_transform(shares, lambda x, i: x - CASE WHEN i = list_position(shares, list_max(shares)) THEN 1 ELSE 0 END)
    ELSE list_transform(shares, lambda x, i: x + CASE WHEN i = list_position(list_transform(shares, lambda y, j: ns[j] - y), list_max(list_transform(shares, lambda y, j: ns[j] - y))) THEN 1 ELSE 0 END) END
  FROM step WHERE list_sum(shares) < target OR (list_sum(shares) > target AND list_max(shares) > 1)),
shares AS (
  SELECT industry, unnest(names) AS subreddit, unnest(ns) AS n, unnest(shares) AS share
  FROM step WHERE list_sum(shares) = target OR (list_sum(shares) > target AND list_max(shares) <= 1))"""


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return comments(spark, sf).where("quality IS NOT NULL").select("industry", "subreddit", F.col("post_id").cast("string").alias("post_id"), "doc_id")


@query("q51_sqrt_allocation", f"WITH RECURSIVE {COMMENTS}, {_SHARES} SELECT industry, subreddit, n, share FROM shares")
def _allocated(spark: SparkSession, sf: str) -> DataFrame:
    sizes = _rows(spark, sf).groupBy("industry", "subreddit").agg(F.count(F.lit(1)).alias("n"))
    return allocation.sqrt_allocation(sizes, "industry", "subreddit", "n", F.lit(_TARGET))


@query(
    "q51_stratified_sample",
    f"""WITH RECURSIVE {COMMENTS}, {_SHARES},
    o AS (SELECT c.industry, c.subreddit, c.post_id, c.doc_id, share, md5(concat('7#', doc_id)) AS h FROM comments c JOIN shares s ON s.industry = c.industry AND s.subreddit = c.subreddit WHERE quality IS NOT NULL),
    b AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY industry, subreddit, post_id ORDER BY h, doc_id) > {_CAP} THEN 1 ELSE 0 END AS beyond FROM o),
    r AS (SELECT *, row_number() OVER (PARTITION BY industry, subreddit ORDER BY beyond, h, doc_id) AS r FROM b)
    SELECT industry, subreddit, doc_id, beyond FROM r WHERE r <= share""",
)
def _sampled(spark: SparkSession, sf: str) -> DataFrame:
    return allocation.stratified_sample(_rows(spark, sf), "industry", "subreddit", "post_id", "doc_id", _TARGET, _CAP, "7").select("industry", "subreddit", "doc_id", "beyond")


_TERMS = ["the", "und", "la", "de la", "idiot", "licensed under", "license", "einen", "or the", "absent"]


def _hits_sql() -> str:
    """One scan for each term, by patterns; texts stand between two spaces, so that each term has a neighbour on both sides."""
    edge = r"[^\p{L}\p{N}_]"
    one = "SELECT '{t}' AS term, doc_id, substr(regexp_extract(c, '(?s)^(.*?{e}){p}{e}', 1), 2) AS before, regexp_extract(c, '{e}({p}){e}', 1) AS hit, c FROM texts WHERE regexp_matches(c, '{e}{p}{e}')"
    return " UNION ALL ".join(one.format(t=t, p=t.replace(" ", r"\s+"), e=edge) for t in _TERMS)


@query(
    "q07_concordances",
    f"""WITH {COMMENTS}, texts AS (SELECT doc_id, ' ' || {_NORM} || ' ' AS c FROM comments), hits AS ({_hits_sql()}),
    r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY md5(concat('3#', term, '#', doc_id))) AS rank FROM hits)
    SELECT term, rank, doc_id, right(before, 120) AS left, hit, substr(substr(c, 2, length(c) - 2), length(before) + length(hit) + 1, 120) AS right FROM r WHERE rank <= 20""",
)
def _concordances(spark: SparkSession, sf: str) -> DataFrame:
    return concordance.concordances(comments(spark, sf), "doc_id", "body", _TERMS, 20, 120, "3")
