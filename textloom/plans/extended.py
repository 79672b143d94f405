"""Further registered queries: join contracts, pivots, summaries, row rules, evaluation and reporting tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import scalars as S
from textloom.operators import contracts, corpus, evaluate, relational, robustness, rows, summaries, text, topics
from textloom.plans.catalogue import _WORDS, COMMENTS, GATED, ORACLES, STANCE, THREADS, TOPICS, WORDED, _keyed, _POSTS, _stats, assignments, comments, gated, query, ranked_threads, stance, thread_comments, threads, worded
from textloom.sources.tables import parquet

# Fixed values of the views below.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
THEMES = [(1, "people"), (2, "people"), (3, "work"), (4, "work"), (5, "work"), (6, "tools"), (7, "tools"), (8, "law")]
MERGES = [(t, "merge" if t in (3, 5) else "keep", {3: 2, 5: 4}.get(t)) for t in range(1, 10)]


def _themes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(THEMES, "topic int, theme string").withColumn("topic", F.col("topic").cast("long"))


_THEMES = "themes AS (SELECT * FROM (VALUES " + ", ".join(f"({t}, '{n}')" for t, n in THEMES) + ") v(topic, theme))"
_MERGES = "merges AS (SELECT * FROM (VALUES " + ", ".join(f"({t}, '{d}', {'NULL' if g is None else g})" for t, d, g in MERGES) + ") v(topic, decision, target))"


# Text.


@query(
    "q04_keyness_diagnostic",
    f"""WITH {WORDED}, {_keyed(1, 10, 5)}, top AS (SELECT term FROM k1 ORDER BY round(z, 9) DESC, term LIMIT 50), s AS ({_stats('industry, gate')}),
    c AS (SELECT term, industry, CAST(sum(CASE WHEN gate = 'yes' THEN df ELSE 0 END) AS BIGINT) AS dp, CAST(sum(CASE WHEN gate = 'no' THEN df ELSE 0 END) AS BIGINT) AS dn FROM s SEMI JOIN top USING (term) GROUP BY 1, 2),
    z AS (SELECT industry, sum(CASE WHEN gate = 'yes' THEN 1 ELSE 0 END)::DOUBLE AS np, sum(CASE WHEN gate = 'no' THEN 1 ELSE 0 END)::DOUBLE AS nn FROM gated GROUP BY 1),
    p AS (SELECT term, CAST(sum(CASE WHEN dp > 0 AND (CASE WHEN np = 0 THEN 0 ELSE dp / np END) >= (CASE WHEN nn = 0 THEN 0 ELSE dn / nn END) THEN 1 ELSE 0 END) AS BIGINT) AS directions, CAST(sum(dp) AS BIGINT) AS pos_df, max(dp) AS most FROM c JOIN z USING (industry) GROUP BY 1),
    q AS (SELECT *, CASE WHEN pos_df = 0 THEN 0 ELSE most / pos_df::DOUBLE END AS share FROM p)
    SELECT term, directions, pos_df, round(share, 6) AS dominant_share, CASE WHEN share >= 0.6 OR directions <= 1 THEN 'concentrated' WHEN directions = 2 THEN 'partial' ELSE 'broad' END AS verdict FROM q""",
)
def _diagnostic(spark: SparkSession, sf: str) -> DataFrame:
    w = worded(gated(spark, sf))
    keyed = text.keyness(w, "words", "gate", 1, 10, 5)
    return text.keyness_diagnostic(w, "words", "gate", "industry", keyed.orderBy(F.desc(F.round("z", 9)), "term").limit(50))


@query("q04_term_group_matrix", f"WITH {WORDED}, s AS ({_stats('industry')}), n AS (SELECT industry, count(*)::DOUBLE AS d FROM worded GROUP BY 1), k AS (SELECT term FROM s GROUP BY 1 HAVING sum(df) >= 20) SELECT term, " + ", ".join(f"round(coalesce(max(CASE WHEN industry = '{g}' THEN df / d END), 0), 6) AS in_{g}" for g in ("de", "en", "es", "fr")) + " FROM s JOIN n USING (industry) SEMI JOIN k USING (term) GROUP BY 1")
def _term_matrix(spark: SparkSession, sf: str) -> DataFrame:
    w = worded(gated(spark, sf))
    sizes = F.broadcast(w.groupBy("industry").agg(F.count(F.lit(1)).alias("d")))  # a row for each group
    cells = text.term_stats(w, "words", ["industry"]).join(sizes, "industry").withColumn("prevalence", F.col("df") / F.col("d"))
    frequent = cells.groupBy("term").agg(F.sum("df").alias("n")).where("n >= 20").select("term")
    return summaries.pivot(cells.join(frequent, "term", "left_semi"), "term", "industry", ["de", "en", "es", "fr"], F.max("prevalence"), "in_")


_CLEAN = r"trim(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\S+', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'))"


@query(
    "q09_exclusion_log",
    f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '' ELSE CAST(doc_id // 3 AS VARCHAR) END AS rid, lang, CASE WHEN length({_CLEAN}) < 200 THEN 'empty_text' WHEN lower({_CLEAN}) IN ('[deleted]', '[removed]') THEN 'deleted' WHEN lang NOT IN ('en', 'de', 'fr') THEN 'unexpected_group' ELSE '' END AS own FROM documents),
    k AS (SELECT *, coalesce(max(CASE WHEN own = '' THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
    SELECT doc_id, rid, CASE WHEN rid = '' THEN 'missing_id' WHEN before = 1 THEN 'duplicate_id' ELSE own END AS reason FROM k""",
)
def _exclusions(spark: SparkSession, sf: str) -> DataFrame:
    d = parquet(spark, sf, "documents").withColumn("rid", F.when(F.col("doc_id") % 17 == 0, "").otherwise(F.expr("doc_id div 3").cast("string")))
    return corpus.exclusion_log(d, "rid", "text", "lang", ["en", "de", "fr"], "doc_id", 200).select("doc_id", "rid", "reason")


@query("q11_ambiguous_term_filter", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)license') AND regexp_matches(text, '(?i)mit') AND NOT regexp_matches(text, '(?i)apache|version')")
def _ambiguous(spark: SparkSession, sf: str) -> DataFrame:
    keep = corpus.ambiguous_term_filter(F.col("text"), F.lit(""), "(?i)license", "(?i)apache|version", "(?i)mit")
    return parquet(spark, sf, "documents").where(keep).select("doc_id")


# Activity and corpus construction.


@query(
    "q14_search_activity",
    """WITH h AS (SELECT user_id AS subreddit, strftime(ts, '%Y-%m-%d') AS bucket, event_type FROM events WHERE user_id % 10 = 0), b AS (SELECT min(bucket) AS lo, max(bucket) AS hi FROM (SELECT strftime(ts, '%Y-%m-%d') AS bucket FROM events)),
    days AS (SELECT strftime(d, '%Y-%m-%d') AS bucket FROM b, unnest(generate_series(CAST(lo AS DATE), CAST(hi AS DATE), INTERVAL 1 DAY)) AS u(d)), n AS (SELECT subreddit, bucket, count(DISTINCT event_type) AS n FROM h GROUP BY ALL)
    SELECT s.subreddit, days.bucket, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT subreddit FROM h) s CROSS JOIN days LEFT JOIN n ON n.subreddit = s.subreddit AND n.bucket = days.bucket""",
)
def _search_activity(spark: SparkSession, sf: str) -> DataFrame:
    e = parquet(spark, sf, "events").withColumn("bucket", F.date_format("ts", "yyyy-MM-dd"))
    first, last = e.agg(F.min("bucket"), F.max("bucket")).first()
    return corpus.dense_activity(e.where("user_id % 10 = 0").withColumnRenamed("user_id", "subreddit"), "subreddit", "bucket", "event_type", first, last)


@query("q15_candidate_rollup", "WITH f AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS name, c_custkey % 41 AS rank, CAST(c_nationkey AS VARCHAR) AS keyword, c_custkey FROM customer) SELECT lower(name) AS key, min(rank) AS best_rank, string_agg(DISTINCT keyword, ';' ORDER BY keyword) AS keywords, arg_min(name, c_custkey) AS spelling, count(*) AS found FROM f GROUP BY 1")
def _rollup(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    found = parquet(spark, sf, "customer").select(name.alias("name"), (F.col("c_custkey") % 41).alias("rank"), F.col("c_nationkey").cast("string").alias("keyword"), "c_custkey")
    return corpus.candidate_rollup(found, "name", "rank", "keyword", "c_custkey")


@query("q19_comment_caps", f"WITH {THREADS}, c AS (SELECT l_orderkey AS post, l_linenumber AS arrival, rank, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nth FROM lineitem JOIN threads ON l_orderkey = post JOIN ranked USING (subreddit)) SELECT post, arrival, CAST(nth AS INT) AS nth FROM c WHERE nth <= CASE WHEN rank <= 5 THEN 3 ELSE 2 END")
def _caps(spark: SparkSession, sf: str) -> DataFrame:
    tiers = ranked_threads(spark, sf).select("subreddit", corpus.tier(F.col("rank")).alias("tier"))
    c = thread_comments(spark, sf).join(threads(spark, sf).select("post", "subreddit"), "post").join(tiers, "subreddit")
    cap = F.when(F.col("tier") == "large_top30", 3).otherwise(2)
    return corpus.comment_caps(c, "post", "arrival", cap).select("post", "arrival", "nth")


@query(
    "q22_rank_sensitivity",
    f"WITH {THREADS}, a AS (SELECT list_sort(list(subreddit)) AS x FROM (SELECT subreddit FROM ranked ORDER BY total DESC, subreddit LIMIT 10)), b AS (SELECT list_sort(list(subreddit)) AS y FROM (SELECT subreddit FROM ranked ORDER BY posts DESC, subreddit LIMIT 10)) SELECT x = y AS same_set, array_to_string(list_filter(x, lambda v: NOT list_contains(y, v)), ';') AS only_first, array_to_string(list_filter(y, lambda v: NOT list_contains(x, v)), ';') AS only_second FROM a, b",
)
def _sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    g = threads(spark, sf).groupBy("subreddit").agg(F.sum("num_comments").alias("total"), F.count(F.lit(1)).alias("posts"))
    return corpus.rank_sensitivity(g, "subreddit", [F.desc("total"), F.asc("subreddit")], [F.desc("posts"), F.asc("subreddit")], 10)


@query(
    "q23_merge_union_total",
    "WITH u AS (SELECT 'documents' AS origin, text, source AS part FROM documents UNION ALL BY NAME SELECT 'pages' AS origin, html AS text FROM pages UNION ALL BY NAME SELECT 'conversations' AS origin, text, role AS part FROM conversations) SELECT coalesce(origin, 'TOTAL') AS source, count(*) AS rows, CAST(sum(CASE WHEN length(text) > 1000 THEN 1 ELSE 0 END) AS BIGINT) AS flagged, count(DISTINCT part) AS groups FROM u GROUP BY ROLLUP (origin)",
)
def _merged(spark: SparkSession, sf: str) -> DataFrame:
    frames = {"documents": parquet(spark, sf, "documents").select("text", F.col("source").alias("part")), "pages": parquet(spark, sf, "pages").select(F.col("html").alias("text")), "conversations": parquet(spark, sf, "conversations").select("text", F.col("role").alias("part"))}
    return corpus.source_summary(relational.union_tagged(frames, "origin"), "origin", "part", F.char_length("text") > 1000)


# Topics.


@query("q25_topic_overview", f"WITH {TOPICS}, c AS (SELECT topic, count(*) AS n FROM t GROUP BY 1) SELECT count(CASE WHEN topic <> -1 THEN n END) AS topics, CAST(sum(n) AS BIGINT) AS documents, CAST(coalesce(sum(CASE WHEN topic = -1 THEN n END), 0) AS BIGINT) AS outliers, round(max(CASE WHEN topic <> -1 THEN n END) / sum(n)::DOUBLE, 6) AS largest_share, round(max(CASE WHEN topic <> -1 THEN n END) / sum(CASE WHEN topic <> -1 THEN n END)::DOUBLE, 6) AS largest_share_inside FROM c")
def _overview(spark: SparkSession, sf: str) -> DataFrame:
    return topics.overview(assignments(spark, sf))


@query("q32_reporting_merge", f"WITH {TOPICS}, {_MERGES}, c AS (SELECT topic, count(*) AS n FROM t WHERE topic <> -1 GROUP BY 1), g AS (SELECT CASE WHEN decision = 'merge' THEN target ELSE c.topic END AS reported, n FROM c LEFT JOIN merges ON c.topic = merges.topic) SELECT reported::BIGINT AS reported, CAST(sum(n) AS BIGINT) AS n, count(*) AS topics, round(sum(n) / sum(sum(n)) OVER ()::DOUBLE, 6) AS share FROM g GROUP BY 1")
def _reporting(spark: SparkSession, sf: str) -> DataFrame:
    mapping = spark.createDataFrame(MERGES, "topic long, decision string, target long")
    return topics.merged_topics(assignments(spark, sf), mapping).select(F.col("reported").cast("long").alias("reported"), "n", "topics", "share")


@query("q33_meta_theme", f"WITH {TOPICS}, {_THEMES}, c AS (SELECT industry, coalesce(theme, 'Unmapped') AS theme, count(*) AS n FROM t LEFT JOIN themes ON t.topic = themes.topic WHERE t.topic <> -1 GROUP BY 1, 2) SELECT industry, theme, n, round(n * 100 / sum(n) OVER (PARTITION BY industry)::DOUBLE, 6) AS percent, CAST(row_number() OVER (PARTITION BY industry ORDER BY n DESC, theme) AS INT) AS rank FROM c")
def _meta(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.meta_themes(assignments(spark, sf), _themes(spark), "industry")


@query("q33_meta_theme_pivot", f"WITH {TOPICS}, {_THEMES} SELECT coalesce(theme, 'Unmapped') AS theme, " + ", ".join(f"CAST(sum(CASE WHEN industry = {g} THEN 1 ELSE 0 END) AS BIGINT) AS g{g}" for g in range(4)) + " FROM t LEFT JOIN themes ON t.topic = themes.topic WHERE t.topic <> -1 GROUP BY 1")
def _meta_pivot(spark: SparkSession, sf: str) -> DataFrame:
    t = assignments(spark, sf).where("topic <> -1").join(F.broadcast(_themes(spark)), "topic", "left").withColumn("theme", F.coalesce("theme", F.lit("Unmapped")))
    return summaries.pivot(t, "theme", "industry", [0, 1, 2, 3], F.count(F.lit(1)), "g")


@query("q26_outlier_rate", f"WITH {TOPICS} SELECT industry, count(*) AS n, round(avg(CASE WHEN topic = -1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS outlier_rate FROM t GROUP BY 1")
def _outliers(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.outlier_rate(assignments(spark, sf), "industry")


_CELLS = f"{TOPICS}, c AS (SELECT topic AS ref, locked AS cand, count(*) AS n FROM t GROUP BY ALL)"


@query(
    "q47_robustness_summary",
    f"""WITH {_CELLS}, z AS (SELECT cand, sum(n) AS n FROM c GROUP BY 1), r AS (SELECT ref, sum(n) AS w FROM c GROUP BY 1),
    j AS (SELECT c.ref, max(c.n / (r.w + z.n - c.n)::DOUBLE) AS j FROM c JOIN r ON c.ref = r.ref JOIN z ON c.cand = z.cand WHERE c.ref <> -1 AND c.cand <> -1 GROUP BY 1), o AS (SELECT w, coalesce(j, 0) AS j FROM r LEFT JOIN j ON r.ref = j.ref WHERE r.ref <> -1)
    SELECT (SELECT count(*) FROM z WHERE cand <> -1) AS topics, round((SELECT max(CASE WHEN cand <> -1 THEN n END) / sum(n)::DOUBLE FROM z), 6) AS largest_share, round((SELECT sum(CASE WHEN cand = -1 THEN n ELSE 0 END) / sum(n)::DOUBLE FROM c), 6) AS outlier_rate, round((SELECT sum(CASE WHEN (ref = -1) = (cand = -1) THEN n ELSE 0 END) / sum(n)::DOUBLE FROM c), 6) AS status_agreement,
    round((SELECT sum(j * w) / sum(w)::DOUBLE FROM o), 6) AS weighted_jaccard, round((SELECT median(j) FROM o), 6) AS median_jaccard, (SELECT count(*) FROM o WHERE j >= 0.5) AS at_half, (SELECT count(*) FROM o WHERE j >= 0.33) AS at_third""",
)
def _robustness(spark: SparkSession, sf: str) -> DataFrame:
    t = assignments(spark, sf).select(F.col("topic").alias("ref"), F.col("locked").alias("cand"))
    return summaries.robustness_summary(robustness.contingency(t))


@query("q47_alignment", "SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 5 <> 0 AND vec_id % 3 = 0) AS only_a, (SELECT count(*) FROM embeddings WHERE vec_id % 5 = 0 AND vec_id % 3 <> 0) AS only_b, (SELECT count(*) FROM embeddings WHERE vec_id % 5 <> 0 AND vec_id % 3 <> 0) AS \"both\"")
def _alignment(spark: SparkSession, sf: str) -> DataFrame:
    e = parquet(spark, sf, "embeddings").select("vec_id")
    return contracts.alignment(e.where("vec_id % 5 <> 0"), e.where("vec_id % 3 <> 0"), "vec_id")


# Join contracts.


@query(
    "q53_composite_key",
    "WITH l AS (SELECT l_orderkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) AS nth FROM lineitem), k AS (SELECT concat_ws('||', CAST(l_orderkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS key, l_quantity AS quantity FROM l WHERE nth = 1), o AS (SELECT o_orderkey, concat_ws('||', CAST(o_orderkey AS VARCHAR), CAST(o_custkey % 10 + 1 AS VARCHAR)) AS key FROM orders) SELECT key, o_orderkey, round(quantity, 6) AS quantity FROM o LEFT JOIN k USING (key)",
)
def _composite(spark: SparkSession, sf: str) -> DataFrame:
    right = parquet(spark, sf, "lineitem").select(contracts.stable_key(F.col("l_orderkey"), F.col("l_suppkey")).alias("key"), F.col("l_quantity").alias("quantity"), "l_linenumber")
    left = parquet(spark, sf, "orders").select("o_orderkey", contracts.stable_key(F.col("o_orderkey"), F.col("o_custkey") % 10 + 1).alias("key"))
    return contracts.left_deduplicated(left, right, ["key"], [F.asc("l_linenumber")]).select("key", "o_orderkey", "quantity")


@query("q53_left_dimension", f"WITH {TOPICS}, {_THEMES} SELECT doc_id, t.topic, coalesce(theme, 'none') AS theme FROM t LEFT JOIN themes ON t.topic = themes.topic")
def _dimension(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.left_to_dimension(assignments(spark, sf).select("doc_id", F.col("topic").cast("long").alias("topic")), F.broadcast(_themes(spark)), "topic", {"theme": "none"}).select("doc_id", "topic", "theme")


@query("q53_many_to_one", "SELECT (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) AS repeated_right, (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_linenumber > 0)) AS unmapped_left")
def _many(spark: SparkSession, sf: str) -> DataFrame:
    left, right = parquet(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), parquet(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))
    return contracts.contract_of_many_to_one(left, right, ["k"])


@query("q53_one_to_one", "SELECT 0::BIGINT AS repeated_right, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unmapped_left, (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) AS repeated_left")
def _one(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.contract_of_one_to_one(parquet(spark, sf, "documents").select("doc_id"), parquet(spark, sf, "labels").select("doc_id").distinct(), ["doc_id"])


@query("q53_three_raters", f"WITH {STANCE} SELECT o_orderkey, rater_a, rater_b, rater_c FROM stance WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0")
def _three(spark: SparkSession, sf: str) -> DataFrame:
    s = stance(spark, sf)
    return contracts.inner_chain([s.select("o_orderkey", "rater_a").where("o_orderkey % 2 = 0"), s.select("o_orderkey", "rater_b"), s.select("o_orderkey", "rater_c").where("o_orderkey % 3 <> 0")], ["o_orderkey"])


@query("q53_suffixed", "SELECT n_nationkey, n_regionkey, n_name AS name, r_name AS name_region FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3")
def _suffix(spark: SparkSession, sf: str) -> DataFrame:
    n = parquet(spark, sf, "nation").select("n_nationkey", "n_regionkey", F.col("n_name").alias("name"))
    r = parquet(spark, sf, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("name"))
    return contracts.suffixed(n, r, ["n_regionkey"], "_region").select("n_nationkey", "n_regionkey", "name", "name_region")


@query("q53_two_steps", "SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 12")
def _two_steps(spark: SparkSession, sf: str) -> DataFrame:
    o, c = parquet(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), parquet(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    return o.join(c, "c_custkey", "left").join(parquet(spark, sf, "nation").where("n_nationkey < 12"), "n_nationkey", "left").select("o_orderkey", "c_mktsegment", "n_name")


@query("q53_full_outer", "WITH a AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, a.v AS old, b.v AS new, b.v - a.v AS change FROM a FULL JOIN b ON a.k = b.k")
def _full(spark: SparkSession, sf: str) -> DataFrame:
    half = lambda odd: parquet(spark, sf, "orders").where(f"o_orderkey % 2 = {odd}").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    return contracts.full_comparison(half(0), half(1), ["k"], "v")


@query("q53_members", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 0 END AS labelled FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _members(spark: SparkSession, sf: str) -> DataFrame:
    d, lab = parquet(spark, sf, "documents").select("doc_id"), parquet(spark, sf, "labels")
    return relational.flag_members(relational.pending(d, lab.where("toxic = 1"), ["doc_id"]), lab, "doc_id", "labelled").select("doc_id", "labelled")


@query("q53_exact_text", "WITH w AS (SELECT text, doc_id AS pos, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth FROM documents WHERE doc_id % 3 = 0), r AS (SELECT text, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth FROM documents WHERE doc_id % 3 <> 0) SELECT pos, r.doc_id FROM w LEFT JOIN r ON w.text = r.text AND w.nth = r.nth")
def _exact_text(spark: SparkSession, sf: str) -> DataFrame:
    d = parquet(spark, sf, "documents")
    return contracts.first_unused_match(d.where("doc_id % 3 = 0").select("text", F.col("doc_id").alias("pos")), d.where("doc_id % 3 <> 0"), "text", "doc_id").select("pos", "doc_id")


# Pivots and summaries.


@query("q60_pivot_count", f"WITH {STANCE} SELECT industry, " + ", ".join(f"CAST(sum(CASE WHEN attitude = '{p}' THEN 1 ELSE 0 END) AS BIGINT) AS \"n_{p}\"" for p in PRIORITIES) + " FROM stance GROUP BY 1")
def _pivot_count(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.pivot(stance(spark, sf), "industry", "attitude", PRIORITIES, F.count(F.lit(1)), "n_")


@query("q60_pivot_percent", f"WITH {STANCE} SELECT attitude, " + ", ".join(f"round(sum(CASE WHEN industry = '{s}' THEN 1 ELSE 0 END) * 100 / count(*)::DOUBLE, 6) AS {s}" for s in SEGMENTS) + " FROM stance GROUP BY 1")
def _pivot_percent(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.pivot_percent(stance(spark, sf), "attitude", "industry", SEGMENTS)


@query("q60_pivot_distinct", f"WITH {TOPICS} SELECT topic, " + ", ".join(f"count(DISTINCT CASE WHEN industry = {g} AND subreddit <> 0 THEN subreddit END) AS g{g}" for g in range(4)) + " FROM t GROUP BY 1")
def _pivot_distinct(spark: SparkSession, sf: str) -> DataFrame:
    t = assignments(spark, sf).withColumn("part", F.when(F.col("subreddit") == 0, " ").otherwise(F.col("subreddit").cast("string")))
    return summaries.pivot(t, "topic", "industry", [0, 1, 2, 3], F.countDistinct(summaries.filled(F.col("part"))), "g")


@query("q60_two_level", "SELECT o_custkey AS customer, count(*) AS items, CAST(sum(n) AS BIGINT) AS rows, max(n) AS most FROM (SELECT o_custkey, l_orderkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1")
def _two_level(spark: SparkSession, sf: str) -> DataFrame:
    li, o = parquet(spark, sf, "lineitem").select("l_orderkey"), parquet(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer"))
    return summaries.two_level(li.join(o, "l_orderkey"), "customer", "l_orderkey")


@query("q60_value_counts", "WITH v AS (SELECT trim(unnest(string_split(lang || '; ' || source, ';'))) AS value FROM documents) SELECT value, count(*) AS n FROM v WHERE value <> '' GROUP BY 1")
def _value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.value_counts(parquet(spark, sf, "documents"), F.concat_ws("; ", "lang", "source"))


@query("q60_top_values", f"WITH {STANCE}, c AS (SELECT industry, attitude, count(*) AS n, min(o_orderkey) AS first FROM stance GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY n DESC, first) AS rank FROM c) SELECT industry, string_agg(attitude || ': ' || n, '; ' ORDER BY rank) AS top FROM r WHERE rank <= 3 GROUP BY 1")
def _top_values(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.top_values_text(stance(spark, sf), "industry", "attitude", "o_orderkey", 3)


@query("q60_corpus_audit", "SELECT lang, count(*) AS total, CAST(sum(CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END) AS BIGINT) AS valid, CAST(sum(CASE WHEN n_chars >= 500 THEN 0 ELSE 1 END) AS BIGINT) AS excluded, count(DISTINCT doc_id // 5) AS posts, count(DISTINCT nullif(trim(source), '')) AS groups FROM documents GROUP BY 1")
def _corpus_audit(spark: SparkSession, sf: str) -> DataFrame:
    d = parquet(spark, sf, "documents").withColumn("post", F.expr("doc_id div 5"))
    return summaries.corpus_audit(d, "lang", F.col("n_chars") >= 500, "post", "source")


@query("q60_spread", "SELECT c_mktsegment AS segment, round(quantile_cont(c_acctbal, 0.5), 6) AS median, round(quantile_cont(c_acctbal, 0.025), 6) AS low, round(quantile_cont(c_acctbal, 0.975), 6) AS high FROM customer GROUP BY 1")
def _spread(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.spread(parquet(spark, sf, "customer").withColumnRenamed("c_mktsegment", "segment"), "segment", "c_acctbal")


@query("q60_weighted_average", "SELECT l_returnflag AS flag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS average FROM lineitem GROUP BY 1")
def _weighted(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.weighted_average(parquet(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "flag"), "flag", "l_discount", "l_quantity")


@query("q60_annotation_rollup", "SELECT lang, count(*) AS total, count(quality) AS annotated, CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positive, round(count(quality) / count(*)::DOUBLE, 4) AS annotated_rate, round(CASE WHEN count(quality) = 0 THEN 0 ELSE sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) / count(quality)::DOUBLE END, 4) AS positive_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def _annotation(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.annotation_rollup(comments(spark, sf).withColumnRenamed("industry", "lang"), "lang", F.col("quality").isNotNull(), F.coalesce(F.col("toxic") == 1, F.lit(False)))


# Row rules.

_ALIASES = {"cars": ["automobile", "machinery"], "home": ["furniture", "household"]}


@query("q61_row_rules", "SELECT c_custkey, lower(trim(c_mktsegment)) IN ('building', 'machinery') OR CAST(c_nationkey AS VARCHAR) IN ('7', 'building') AS member, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'cars' WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'home' ELSE '' END AS grp, c_nationkey = 1 AS flag, CASE WHEN c_acctbal > 5000 THEN 'included' WHEN c_acctbal < 0 THEN 'excluded' ELSE 'unmapped' END AS status, least(c_nationkey, c_custkey % 50) <= 10 AS near, CASE WHEN c_custkey % 4 = 0 THEN 'large_top30' WHEN c_nationkey <= 5 THEN 'large_top30' ELSE 'rest_top10' END AS tier FROM customer")
def _row_rules(spark: SparkSession, sf: str) -> DataFrame:
    c = parquet(spark, sf, "customer")
    ranks = F.concat_ws("; ", F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 50).cast("string"))
    policy = F.when(F.col("c_custkey") % 4 == 0, "large_top30").otherwise("?")
    return c.select(
        "c_custkey",
        rows.in_either(["building", "machinery", "7"], F.col("c_mktsegment"), F.col("c_nationkey")).alias("member"),
        rows.first_group(_ALIASES, F.lit(None), F.col("c_nationkey"), F.col("c_mktsegment")).alias("grp"),
        rows.numeric_flag(F.col("c_nationkey")).alias("flag"),
        rows.classified(F.col("c_acctbal") > 5000, F.col("c_acctbal") < 0).alias("status"),
        rows.best_rank_within(ranks, 10).alias("near"),
        rows.inferred_tier(policy, F.col("c_nationkey"), F.lit("")).alias("tier"),
    )


@query("q61_row_ids", "WITH r AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'row_' || doc_id ELSE CAST(doc_id // 2 AS VARCHAR) END AS i FROM documents) SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY i) > 1 THEN i || '__row_' || doc_id ELSE i END AS row_id FROM r")
def _row_ids(spark: SparkSession, sf: str) -> DataFrame:
    d = parquet(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 11 == 0, " ").otherwise(F.expr("doc_id div 2").cast("string")).alias("given"))
    return rows.row_ids(d, "given", "doc_id").select("doc_id", "row_id")


@query("q61_duplicate_marks", "SELECT doc_id, row_number() OVER w > 1 AS later, row_number() OVER w < count(*) OVER (PARTITION BY text) AS earlier, count(*) OVER (PARTITION BY text) > 1 AS member FROM documents WINDOW w AS (PARTITION BY text ORDER BY doc_id)")
def _marks(spark: SparkSession, sf: str) -> DataFrame:
    d = parquet(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return rows.duplicate_marks(d, ["key"], "doc_id").select("doc_id", "later", "earlier", "member")


@query("q61_numbered_slice", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 10")
def _slice(spark: SparkSession, sf: str) -> DataFrame:
    return rows.numbered_slice(parquet(spark, sf, "customer"), [F.desc("c_acctbal"), F.asc("c_custkey")], 11, 25).select("c_custkey")


@query("q62_json_fields", f"SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS label, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS input_tokens, '{{\"id\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}}' AS item FROM orders")
def _json(spark: SparkSession, sf: str) -> DataFrame:
    schema = T.StructType([T.StructField("label", T.StringType()), T.StructField("tokens", T.StructType([T.StructField("input", T.LongType())]))])
    o = parquet(spark, sf, "orders").withColumn("answer", F.expr("CASE WHEN o_orderkey % 9 = 0 THEN 'no json' ELSE concat('{\"label\": \"', o_orderpriority, '\", \"tokens\": {\"input\": ', o_custkey, '}}') END"))
    got = o.withColumn("got", rows.parsed(F.col("answer"), schema))
    return got.select("o_orderkey", F.col("got.label").alias("label"), F.col("got.tokens.input").alias("input_tokens"), rows.rendered(id=F.col("o_orderkey"), status=F.col("o_orderstatus")).alias("item"))


@query("q62_compact_context", r"SELECT doc_id, substr(text, 1, 120) AS text, substr(source, 1, 4) AS source, lang || ' ' || source AS joined, n_chars > 1000 AS long_text, printf('%.4f', n_chars / 7.0::DOUBLE) AS shown, regexp_matches(text, '(?i)\b(trash|idiot)\b') AS hit FROM documents")
def _compact(spark: SparkSession, sf: str) -> DataFrame:
    cut = rows.compact({"text": 120, "source": 4})
    return parquet(spark, sf, "documents").select("doc_id", *cut, rows.joined(F.col("lang"), F.col("source")).alias("joined"), (F.col("n_chars") > 1000).alias("long_text"), rows.fixed_places(F.col("n_chars") / 7.0).alias("shown"), F.col("text").rlike(r"(?i)\b(trash|idiot)\b").alias("hit"))


@query("q62_seeded_run", "WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS ok FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY NOT ok, CASE WHEN ok THEN l_linenumber ELSE -l_linenumber END) AS nth FROM r) SELECT l_orderkey, l_linenumber FROM k WHERE nth = 1")
def _seeded(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.seeded(parquet(spark, sf, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R", "l_linenumber").select("l_orderkey", "l_linenumber")


# Evaluation.


@query("q41_prediction_distribution", f"WITH {STANCE}, b AS (SELECT unnest([{', '.join(repr(p) for p in [*PRIORITIES, '6-NEVER'])}]) AS label), r AS (SELECT 'rater_a' AS rater, rater_a AS label FROM stance UNION ALL SELECT 'rater_b', rater_b FROM stance UNION ALL SELECT 'rater_c', rater_c FROM stance), c AS (SELECT rater, label, count(*) AS n FROM r GROUP BY 1, 2) SELECT x.rater, b.label, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100 / (SELECT count(*) FROM stance)::DOUBLE, 6) AS percent FROM (SELECT DISTINCT rater FROM r) x CROSS JOIN b LEFT JOIN c ON c.rater = x.rater AND c.label = b.label")
def _distribution(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.prediction_distribution(stance(spark, sf), ["rater_a", "rater_b", "rater_c"], [*PRIORITIES, "6-NEVER"])


@query("q41_field_accuracy", f"WITH {STANCE}, u AS (SELECT industry, 'rater_a' AS field, rater_a = attitude AS hit FROM stance UNION ALL SELECT industry, 'rater_b', rater_b = attitude FROM stance) SELECT industry, field, count(*) AS n, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM u GROUP BY 1, 2")
def _accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.accuracy_by(stance(spark, sf), "industry", {"rater_a": "attitude", "rater_b": "attitude"})


@query("q41_disagreements", f"WITH {STANCE} SELECT o_orderkey, attitude, rater_a FROM stance WHERE lower(trim(attitude)) <> lower(trim(rater_a))")
def _disagreements(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.disagreements(stance(spark, sf), "attitude", "rater_a").select("o_orderkey", "attitude", "rater_a")


@query("q39_baselines", f"WITH {GATED}, c AS (SELECT count(*) AS n, CAST(sum(CASE WHEN gate = 'yes' THEN 1 ELSE 0 END) AS BIGINT) AS p FROM gated) SELECT 'always_yes' AS baseline, round(p / n::DOUBLE, 6) AS accuracy, round(2 * p / (n + p)::DOUBLE, 6) AS f1 FROM c UNION ALL SELECT 'always_no', round((n - p) / n::DOUBLE, 6), 0.0 FROM c")
def _baselines(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.baselines(evaluate.gate_counts(gated(spark, sf), "gate", "pred"))


@query("q43_named_checks", f"WITH {STANCE}, c AS (SELECT count(*) > 0 AS has_rows, bool_and(attitude <> '') AS filled, count(DISTINCT o_orderkey) = count(*) AS unique_keys, bool_and(rater_a = attitude) AS agreed FROM stance), l AS (SELECT unnest([{{'name': 'has_rows', 'passed': has_rows}}, {{'name': 'filled', 'passed': filled}}, {{'name': 'unique_keys', 'passed': unique_keys}}, {{'name': 'agreed', 'passed': agreed}}, {{'name': 'ALL', 'passed': has_rows AND filled AND unique_keys AND agreed}}]) AS x FROM c) SELECT x.name AS name, x.passed AS passed, CASE WHEN x.passed THEN 'PASS' ELSE 'FAIL' END AS verdict FROM l")
def _checks(spark: SparkSession, sf: str) -> DataFrame:
    checks = {"has_rows": F.count(F.lit(1)) > 0, "filled": F.bool_and(F.col("attitude") != ""), "unique_keys": F.countDistinct("o_orderkey") == F.count(F.lit(1)), "agreed": F.bool_and(F.col("rater_a") == F.col("attitude"))}
    return contracts.named_checks(stance(spark, sf), checks)


@query("q43_conflicts", "SELECT l_orderkey, count(*) AS rows, count(DISTINCT l_returnflag) AS versions FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def _conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.conflicting(parquet(spark, sf, "lineitem"), ["l_orderkey"], ["l_returnflag"])


@query("q43_codebook", f"WITH {STANCE} SELECT attitude AS value, count(*) AS n FROM stance WHERE attitude NOT IN ('1-URGENT', '5-LOW') GROUP BY 1")
def _codebook(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.unexpected_values(stance(spark, sf), "attitude", ["1-URGENT", "5-LOW"])


@query("q43_label_consistency", f"WITH {GATED} SELECT doc_id, CASE WHEN gate = 'no' AND pred = 'yes' THEN 'gate_false_construct' ELSE 'gate_true_none' END AS rule FROM gated WHERE gate <> pred")
def _consistency(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"gate_false_construct": (F.col("gate") == "no") & (F.col("pred") == "yes"), "gate_true_none": (F.col("gate") == "yes") & (F.col("pred") == "no")}
    found = F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])
    return gated(spark, sf).select("doc_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("rule"))


# Stance.


@query("q49_stance_composition", f"WITH {STANCE} SELECT industry, boundary, attitude, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (PARTITION BY industry, boundary)::DOUBLE, 6) AS percent FROM stance GROUP BY 1, 2, 3")
def _stance_composition(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.stance_composition(stance(spark, sf), ["industry", "boundary"], "attitude")


@query("q49_analysis_join", f"WITH {STANCE}, {_THEMES}, a AS (SELECT o_orderkey, o_orderkey % 11 AS topic FROM stance) SELECT s.o_orderkey, attitude, coalesce(theme, 'No topic') AS theme, CASE WHEN themes.topic IS NULL THEN 1 ELSE 0 END AS missing_topic FROM stance s JOIN a USING (o_orderkey) LEFT JOIN themes ON a.topic = themes.topic WHERE boundary = 1")
def _analysis(spark: SparkSession, sf: str) -> DataFrame:
    s = stance(spark, sf).where("boundary = 1").withColumn("topic", F.col("o_orderkey") % 11)
    mapped = s.join(F.broadcast(_themes(spark)), "topic", "left")
    return mapped.select("o_orderkey", "attitude", F.coalesce("theme", F.lit("No topic")).alias("theme"), F.col("theme").isNull().cast("int").alias("missing_topic"))


@query("q49_top_themes", f"WITH {TOPICS}, {_THEMES}, c AS (SELECT coalesce(theme, 'Unmapped') AS theme, count(*) AS n FROM t LEFT JOIN themes ON t.topic = themes.topic WHERE t.topic <> -1 GROUP BY 1), k AS (SELECT theme FROM c ORDER BY n DESC, theme LIMIT 2) SELECT CASE WHEN theme IN (SELECT theme FROM k) THEN theme ELSE 'Other' END AS theme, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1")
def _top_themes(spark: SparkSession, sf: str) -> DataFrame:
    t = assignments(spark, sf).where("topic <> -1").join(F.broadcast(_themes(spark)), "topic", "left").select(F.coalesce("theme", F.lit("Unmapped")).alias("theme"), F.lit(1).alias("n"))
    return relational.top_n_and_rest(t, "theme", "n", 2, "Other")


# SQL of queries that stand in the catalogue.

ORACLES["q06_threshold_jaccard"] = f"""WITH {WORDED}, {_keyed(1, 5, 3)},
    a AS (SELECT term FROM k1 WHERE dp + dn >= 5 AND greatest(dp, dn) >= 3 ORDER BY z DESC, term LIMIT 50), b AS (SELECT term FROM k1 WHERE dp + dn >= 10 AND greatest(dp, dn) >= 5 ORDER BY z DESC, term LIMIT 50), c AS (SELECT term FROM k1 WHERE dp + dn >= 20 AND greatest(dp, dn) >= 10 ORDER BY z DESC, term LIMIT 50),
    x AS (SELECT 5 AS threshold, term FROM a UNION ALL SELECT 10, term FROM b UNION ALL SELECT 20, term FROM c)
    SELECT threshold::INT AS threshold, round(sum(CASE WHEN term IN (SELECT term FROM a) THEN 1 ELSE 0 END) / ((SELECT count(*) FROM a) + sum(CASE WHEN term IN (SELECT term FROM a) THEN 0 ELSE 1 END))::DOUBLE, 6) AS jaccard FROM x GROUP BY 1"""
ORACLES["q07_kwic"] = f"""WITH c AS (SELECT doc_id, {_CLEAN} AS c FROM documents), h AS (SELECT *, regexp_extract(c, '[Ll]icensed?') AS hit, strpos(c, regexp_extract(c, '[Ll]icensed?')) AS pos FROM c WHERE regexp_matches(c, '[Ll]icensed?'))
    SELECT doc_id, substr(c, greatest(pos - 120, 1), least(pos - 1, 120)) AS "left", hit, substr(c, pos + length(hit), 120) AS "right" FROM h"""
ORACLES["q25_topic_domination"] = f"""WITH {TOPICS}, p AS (SELECT topic, post, count(*) AS n, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, post) AS r FROM t GROUP BY 1, 2),
    a AS (SELECT topic, CAST(sum(n) AS BIGINT) AS n, count(*) AS posts, max(n) AS largest_post, CAST(sum(CASE WHEN r <= 3 THEN n END) AS BIGINT) AS top3 FROM p GROUP BY 1), s AS (SELECT topic, count(*) AS subreddits, max(n) AS largest_subreddit FROM (SELECT topic, subreddit, count(*) AS n FROM t GROUP BY 1, 2) GROUP BY 1),
    j AS (SELECT a.*, subreddits, largest_subreddit, round(largest_post / n::DOUBLE, 4) AS post_share, round(top3 / n::DOUBLE, 4) AS top3_share, round(largest_subreddit / n::DOUBLE, 4) AS subreddit_share FROM a JOIN s USING (topic))
    SELECT *, post_share >= 0.4 OR top3_share >= 0.6 OR subreddit_share >= 0.8 AS flagged FROM j"""
ORACLES["q27_spread_entropy"] = f"""WITH {TOPICS}, c AS (SELECT topic, industry, count(*) AS n FROM t GROUP BY 1, 2), m AS (SELECT *, n / sum(CASE WHEN topic <> -1 THEN n END) OVER (PARTITION BY industry)::DOUBLE AS p FROM c), q AS (SELECT *, p / sum(p) OVER (PARTITION BY topic) AS q FROM m)
    SELECT topic, round(-sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END) / ln(4.0::DOUBLE), 6) AS entropy, CAST(sum(CASE WHEN n >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS groups_n, CAST(sum(CASE WHEN p >= 0.005 THEN 1 ELSE 0 END) AS BIGINT) AS groups_share FROM q GROUP BY 1"""
ORACLES["q34_ctfidf"] = f"""WITH {COMMENTS}, w AS (SELECT industry, unnest({_WORDS}) AS term FROM comments), c AS (SELECT industry, term, count(*) AS n FROM w GROUP BY 1, 2),
    f AS (SELECT *, sum(n) OVER (PARTITION BY term) AS f, count(*) OVER (PARTITION BY term) AS df, sum(n) OVER (PARTITION BY industry) AS total FROM c), a AS (SELECT avg(t) AS a, count(*) AS classes FROM (SELECT sum(n) AS t FROM c GROUP BY industry)),
    s AS (SELECT industry, term, n / total::DOUBLE * ln(1 + a / f::DOUBLE) AS score FROM f, a WHERE df <= greatest(classes * 0.8, 1.0)), r AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY score DESC, term) AS rank FROM s)
    SELECT industry, term, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 12"""
ORACLES["q36_representatives"] = f"""WITH {TOPICS}, p AS (SELECT doc_id, topic, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM t JOIN embeddings ON doc_id = vec_id WHERE topic <> -1), m AS (SELECT topic, i, avg(x) AS m FROM p GROUP BY 1, 2),
    d AS (SELECT topic, doc_id, round(sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 6) AS cosine FROM p JOIN m USING (topic, i) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY cosine DESC, doc_id) AS rank FROM d)
    SELECT topic, doc_id, cosine, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10"""
ORACLES["q37_multiclass_metrics"] = f"""WITH {STANCE}, c AS (SELECT lower(attitude) AS t, lower(rater_a) AS p, count(*) AS n FROM stance GROUP BY 1, 2), l AS (SELECT t AS label FROM c UNION SELECT p FROM c),
    k AS (SELECT label, coalesce((SELECT sum(n) FROM c WHERE t = label), 0) AS s, coalesce((SELECT sum(n) FROM c WHERE p = label), 0) AS g, coalesce((SELECT sum(n) FROM c WHERE t = label AND p = label), 0) AS h FROM l),
    v AS (SELECT *, CASE WHEN g = 0 THEN 0 ELSE h / g::DOUBLE END AS pr, CASE WHEN s = 0 THEN 0 ELSE h / s::DOUBLE END AS re, CASE WHEN g + s = 0 THEN 0 ELSE 2 * h / (g + s)::DOUBLE END AS f1, s / sum(s) OVER ()::DOUBLE AS w FROM k)
    SELECT CAST(sum(s) AS BIGINT) AS n, CAST(sum(h) AS BIGINT) AS exact, round(sum(h) / sum(s)::DOUBLE, 6) AS accuracy, round(avg(pr), 6) AS macro_precision, round(avg(re), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(pr * w), 6) AS weighted_precision, round(sum(re * w), 6) AS weighted_recall, round(sum(f1 * w), 6) AS weighted_f1, CAST(sum(CASE WHEN s < 5 THEN 1 ELSE 0 END) AS BIGINT) AS low_support FROM v"""
