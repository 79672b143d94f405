"""The registered queries over the reference tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import scalars as S
from textloom.operators import corpus, evaluate, relational, robustness, sampling, stages, text, topics
from textloom.sources.tables import parquet
from textloom.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "q02_keyness_1gram"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str = ""):
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Views: the tables in the roles of the study's entities, and the same in SQL.


def comments(spark: SparkSession, sf: str) -> DataFrame:
    d, lab = parquet(spark, sf, "documents"), parquet(spark, sf, "labels")
    return d.join(lab, "doc_id", "left").select("doc_id", F.col("lang").alias("industry"), F.col("source").alias("subreddit"), F.expr("doc_id div 5").alias("post_id"), F.coalesce("text", F.lit("")).alias("body"), "quality", "toxic")


def gated(spark: SparkSession, sf: str) -> DataFrame:
    gate = lambda c, v: F.when(F.col(c) == v, "yes").otherwise("no")
    return comments(spark, sf).where("quality IS NOT NULL").withColumns({"gate": gate("quality", 1), "pred": gate("toxic", 0)})


def worded(df: DataFrame, stop_words: tuple[str, ...] = S.SF5_STOP_WORDS) -> DataFrame:
    return df.withColumn("words", S.content_tokens(F.col("body"), stop_words)).drop("body")


def assignments(spark: SparkSession, sf: str) -> DataFrame:
    """Locked topics: the label with 0 as outlier; a second partition that moves every seventh vector on by one."""
    e = parquet(spark, sf, "embeddings")
    topic = lambda t: F.when(t == 0, -1).otherwise(t)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return e.select(F.col("vec_id").alias("doc_id"), topic(F.col("label")).alias("topic"), topic(moved).alias("locked"), (F.col("vec_id") % 4).alias("industry"), F.expr("vec_id div 5").alias("post"), (F.col("vec_id") % 20).alias("subreddit"), F.col("embedding").alias("v"))


def threads(spark: SparkSession, sf: str) -> DataFrame:
    o, li = parquet(spark, sf, "orders"), parquet(spark, sf, "lineitem")
    n = li.groupBy(F.col("l_orderkey").alias("post")).agg(F.count(F.lit(1)).alias("num_comments"))
    return o.join(n, o.o_orderkey == n.post).select(F.col("o_custkey").alias("subreddit"), "post", "num_comments", F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("created"))


def thread_comments(spark: SparkSession, sf: str) -> DataFrame:
    return parquet(spark, sf, "lineitem").select(F.col("l_orderkey").alias("post"), F.col("l_linenumber").alias("arrival"))


def ranked_threads(spark: SparkSession, sf: str) -> DataFrame:
    g = threads(spark, sf).groupBy("subreddit").agg(F.sum("num_comments").alias("total"), F.count(F.lit(1)).alias("posts"))
    return corpus.rank_by(g, [F.desc("total"), F.desc("posts"), F.asc("subreddit")])


def stance(spark: SparkSession, sf: str) -> DataFrame:
    o, c = parquet(spark, sf, "orders"), parquet(spark, sf, "customer")
    rater = lambda k: F.when(F.col("o_orderkey") % k == 0, "5-LOW").otherwise(F.col("o_orderpriority"))
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", F.col("c_mktsegment").alias("industry"), F.col("o_orderpriority").alias("attitude"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("boundary"), "o_custkey", rater(3).alias("rater_a"), rater(4).alias("rater_b"), rater(5).alias("rater_c"))


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    e = parquet(spark, sf, "events").withColumn("bucket", F.date_format("ts", "yyyy-MM-dd"))
    return e.groupBy(F.col("user_id").alias("subreddit"), "bucket").agg(F.sum((F.col("event_type") == "click").cast("long")).alias("hits"), F.count(F.lit(1)).alias("total"))


# The cleaning rules as SQL's own steps, for texts whose character references are these six at most.
_NORM = r"""
replace(replace(replace(lower(
  regexp_replace(regexp_replace(regexp_replace(
    translate(
      replace(replace(replace(replace(replace(replace(coalesce(body, ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&'),
      '‘’“”', '''''""'),
    '(?i)https?://\S+|www\.\S+', ' ', 'g'), '(?i)(?:^|\s)[ru]/[A-Za-z0-9_]+', ' ', 'g'), '&\w+;', ' ', 'g')),
  'can''t', 'cannot'), 'won''t', 'will not'), 'n''t', ' not')"""
_WORDS = f"list_filter(regexp_extract_all({_NORM}, '[a-z0-9]+(?:''[a-z]+)?'), lambda t: length(t) > 1 AND t NOT IN ({', '.join(repr(w) for w in S.SF5_STOP_WORDS)}))"
COMMENTS = "comments AS (SELECT d.doc_id, d.lang AS industry, d.source AS subreddit, d.doc_id // 5 AS post_id, coalesce(d.text, '') AS body, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
GATED = COMMENTS + ", gated AS (SELECT *, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS gate, CASE WHEN toxic = 0 THEN 'yes' ELSE 'no' END AS pred FROM comments WHERE quality IS NOT NULL)"
WORDED = GATED + f", worded AS (SELECT doc_id, industry, gate, {_WORDS} AS words FROM gated)"
TOPICS = "t AS (SELECT vec_id AS doc_id, CASE WHEN label = 0 THEN -1 ELSE label END AS topic, CASE WHEN m = 0 THEN -1 ELSE m END AS locked, vec_id % 4 AS industry, vec_id // 5 AS post, vec_id % 20 AS subreddit FROM (SELECT *, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS m FROM embeddings))"
THREADS = "threads AS (SELECT o_custkey AS subreddit, o_orderkey AS post, n AS num_comments, o_totalprice AS score, o_orderdate AS created FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey), ranked AS (SELECT *, row_number() OVER (ORDER BY total DESC, posts DESC, subreddit) AS rank FROM (SELECT subreddit, CAST(sum(num_comments) AS BIGINT) AS total, count(*) AS posts FROM threads GROUP BY 1))"
STANCE = "stance AS (SELECT o_orderkey, c_mktsegment AS industry, o_orderpriority AS attitude, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS boundary, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN '5-LOW' ELSE o_orderpriority END AS rater_a, CASE WHEN o_orderkey % 4 = 0 THEN '5-LOW' ELSE o_orderpriority END AS rater_b, CASE WHEN o_orderkey % 5 = 0 THEN '5-LOW' ELSE o_orderpriority END AS rater_c FROM orders JOIN customer ON o_custkey = c_custkey)"
MONTHLY = "monthly AS (SELECT user_id AS subreddit, strftime(ts, '%Y-%m-%d') AS bucket, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS total FROM events GROUP BY 1, 2)"


def _grams(n: int) -> str:
    return f"SELECT doc_id, industry, gate, unnest(list_transform(range(1, len(words) - {n - 2}), lambda i: array_to_string(list_slice(words, i, i + {n - 1}), ' '))) AS term FROM worded"


def _stats(by: str, n: int = 1) -> str:
    return f"SELECT {by}, term, CAST(sum(c) AS BIGINT) AS f, count(*) AS df FROM (SELECT {by}, doc_id, term, count(*) AS c FROM ({_grams(n)}) GROUP BY ALL) GROUP BY ALL"


def _g2(a: str, b: str, n1: str, n2: str) -> str:
    cell = lambda o, r, c: f"(CASE WHEN {o} > 0 AND {r} * {c} > 0 THEN {o} * ln({o} / ({r} * {c} / CAST({n1} + {n2} AS DOUBLE))) ELSE 0 END)"
    return f"2 * ({cell(a, n1, f'({a} + {b})')} + {cell(b, n2, f'({a} + {b})')} + {cell(f'({n1} - {a})', n1, f'({n1} + {n2} - {a} - {b})')} + {cell(f'({n2} - {b})', n2, f'({n1} + {n2} - {a} - {b})')})"


def _z(yp: str, yn: str, np: str, nn: str, prior: str) -> str:
    al = f"({yp} + {yn} + 0.01::DOUBLE)"
    lg = lambda y, n: f"ln(({y} + {al}) / ({n} + {prior} - {y} - {al}))"
    return f"({lg(yp, np)} - {lg(yn, nn)}) / sqrt(1 / ({yp} + {al}) + 1 / ({yn} + {al}))"


def _keyed(n: int, total: int, group: int) -> str:
    pick = lambda c, s: f"CAST(sum(CASE WHEN gate = '{s}' THEN {c} ELSE 0 END) AS BIGINT)"
    return f"""c{n} AS (SELECT term, {pick('f', 'yes')} AS yp, {pick('f', 'no')} AS yn, {pick('df', 'yes')} AS dp, {pick('df', 'no')} AS dn FROM ({_stats('gate', n)}) GROUP BY 1),
    t{n} AS (SELECT sum(yp) AS np, sum(yn) AS nn, count(*) AS vocab, (SELECT count(*) FROM gated WHERE gate = 'yes') AS docs_p, (SELECT count(*) FROM gated WHERE gate = 'no') AS docs_n FROM c{n}),
    k{n} AS (SELECT term, yp, yn, dp, dn, {_z('yp', 'yn', 'np', 'nn', '(np + nn + vocab)')} AS z, {_g2('dp', 'dn', 'docs_p', 'docs_n')} AS g2 FROM c{n}, t{n} WHERE dp + dn >= {total} AND greatest(dp, dn) >= {group})"""


for _n in (1, 2, 3):

    @query(f"q01_term_freq_{_n}gram", f"WITH {WORDED} SELECT term, f, df, round(df / (SELECT count(*) FROM gated)::DOUBLE, 6) AS prevalence FROM ({_stats('1 AS one', _n).replace('SELECT 1 AS one, doc_id', 'SELECT doc_id').replace('SELECT 1 AS one, term', 'SELECT term')}) WHERE df >= 5")
    def _freq(spark: SparkSession, sf: str, n: int = _n) -> DataFrame:
        return text.frequency_table(worded(gated(spark, sf)), "words", n, 5)

    @query(f"q02_keyness_{_n}gram", f"WITH {WORDED}, {_keyed(_n, 10 if _n == 1 else 5, 5)} SELECT term, yp, yn, dp, dn, round(z, 6) AS z, round(g2, 6) AS g2 FROM k{_n}")
    def _keyness(spark: SparkSession, sf: str, n: int = _n) -> DataFrame:
        return text.keyness(worded(gated(spark, sf)), "words", "gate", n, 10 if n == 1 else 5, 5)


@query(
    "q03_keyness_one_vs_rest",
    f"""WITH {WORDED}, s AS (SELECT *, sum(f) OVER (PARTITION BY term) AS af, sum(df) OVER (PARTITION BY term) AS adf FROM ({_stats('industry')})),
    p AS (SELECT industry, sum(f) AS np FROM s GROUP BY 1), w AS (SELECT sum(f) AS an, count(DISTINCT term) AS vocab FROM s), z AS (SELECT industry, count(*) AS d FROM worded GROUP BY 1), a AS (SELECT count(*) AS da FROM worded),
    r AS (SELECT industry, term, f AS yp, af - f AS yn, df AS dp, adf - df AS dn, np, an, vocab, d, da FROM s JOIN p USING (industry) JOIN z USING (industry), w, a)
    SELECT industry, term, yp, CAST(yn AS BIGINT) AS yn, round({_z('yp', 'yn', 'np', '(an - np)', '(an + vocab)')}, 6) AS z, round({_g2('dp', 'dn', 'd', '(da - d)')}, 6) AS g2 FROM r WHERE dp + dn >= 5 AND greatest(dp, dn) >= 3""",
)
def _one_vs_rest(spark: SparkSession, sf: str) -> DataFrame:
    return text.keyness_one_vs_rest(worded(gated(spark, sf)), "words", "industry")


@query("q05_collocations")
def _collocations(spark: SparkSession, sf: str) -> DataFrame:
    w = stages.kept(worded(gated(spark, sf)), "words")  # read by each part, cut into words once
    return text.collocations(w.where("gate = 'yes'"), "words", text.keyword_candidates(w, "words", "gate"))


@query("q06_threshold_jaccard")
def _jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return text.threshold_jaccard(worded(gated(spark, sf)), "words", "gate", [5, 10, 20], 50)


@query("q07_kwic")
def _kwic(spark: SparkSession, sf: str) -> DataFrame:
    return text.kwic(parquet(spark, sf, "documents"), "text", r"[Ll]icensed?")


def _wilson_sql(k: str, n: str) -> str:
    p, n = f"({k} / {n}::DOUBLE)", f"{n}::DOUBLE"
    half = f"1.96::DOUBLE * sqrt({p} * (1 - {p}) / {n} + 3.8416::DOUBLE / (4 * {n} * {n}))"
    mid, below = f"({p} + 3.8416::DOUBLE / (2 * {n}))", f"(1 + 3.8416::DOUBLE / {n})"
    return f"round(({mid} - {half}) / {below}, 6) AS low, round(({mid} + {half}) / {below}, 6) AS high"


@query("q08_prevalence_wilson", f"WITH {GATED}, g AS (SELECT coalesce(industry, 'ALL') AS industry, count(*) AS n, CAST(sum(CASE WHEN gate = 'yes' THEN 1 ELSE 0 END) AS BIGINT) AS k FROM gated GROUP BY GROUPING SETS ((), (industry))) SELECT industry, n, k, {_wilson_sql('k', 'n')} FROM g")
def _prevalence(spark: SparkSession, sf: str) -> DataFrame:
    g = gated(spark, sf).rollup("industry").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("gate") == "yes").cast("long")).alias("k"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return g.select(F.coalesce("industry", F.lit("ALL")).alias("industry"), "n", "k", low.alias("low"), high.alias("high"))


@query("q10_repeated_text", r"WITH n AS (SELECT lower(trim(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\S+', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS x, source FROM documents) SELECT md5(x) AS text_md5, count(*) AS copies, string_agg(DISTINCT source, ';' ORDER BY source) AS groups FROM n WHERE length(x) > 0 GROUP BY x HAVING count(*) > 1")
def _repeated(spark: SparkSession, sf: str) -> DataFrame:
    return text.repeated_texts(parquet(spark, sf, "documents"), "text", "source")


@query("q12_keyword_score", "SELECT doc_id, len(list_filter([CASE WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'licence' END, CASE WHEN regexp_matches(text, '(?i)token|secret') THEN 'secret' END, CASE WHEN regexp_matches(text, '@') THEN 'mail' END], lambda v: v IS NOT NULL))::INT AS hits, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'licence' END, CASE WHEN regexp_matches(text, '(?i)token|secret') THEN 'secret' END, CASE WHEN regexp_matches(text, '@') THEN 'mail' END], lambda v: v IS NOT NULL), ';') AS names FROM documents")
def _keywords(spark: SparkSession, sf: str) -> DataFrame:
    n, names = text.hinted(F.col("text"), {"licence": "(?i)licen[sc]e", "secret": "(?i)token|secret", "mail": "@"})
    return parquet(spark, sf, "documents").select("doc_id", n.alias("hits"), names.alias("names"))


@query(
    "q13_activity_rank",
    f"""WITH {MONTHLY}, m AS (SELECT subreddit, bucket, hits, CASE subreddit % 4 WHEN 0 THEN 0 WHEN 1 THEN hits // 2 ELSE total END AS total FROM monthly),
    fails AS (SELECT user_id AS subreddit, count(DISTINCT (strftime(ts, '%Y-%m-%d'), event_type)) AS failures FROM events WHERE user_id % 3 = 0 AND event_type = 'click' GROUP BY 1),
    g AS (SELECT subreddit, sum(hits)::BIGINT AS hits, sum(total)::BIGINT AS total, count(*) FILTER (hits > 0) AS active, min(bucket) FILTER (hits > 0) AS first_active, max(bucket) FILTER (hits > 0) AS last_active,
      min(bucket) FILTER (hits > 0 AND hits = mx) AS peak FROM (SELECT *, max(hits) OVER (PARTITION BY subreddit) AS mx FROM m) GROUP BY 1),
    j AS (SELECT g.*, coalesce(failures, 0) AS failures, total >= hits AND total > 0 AS ok FROM g LEFT JOIN fails USING (subreddit))
    SELECT subreddit, hits, CASE WHEN ok THEN total END AS total, active, first_active, last_active, peak, CASE WHEN ok THEN round(1000 * hits / total::DOUBLE, 6) END AS per_1000, failures,
    (CASE WHEN failures > 0 THEN 'partial_counts' WHEN ok THEN 'complete' ELSE 'complete_counts' END) || (CASE WHEN ok THEN '' ELSE '_no_total' END) AS quality FROM j""",
)
def _activity(spark: SparkSession, sf: str) -> DataFrame:
    part = F.col("subreddit") % 4  # a fourth without totals, a fourth with totals below the hits
    m = monthly(spark, sf).withColumn("total", F.when(part == 0, None).when(part == 1, F.expr("hits div 2")).otherwise(F.col("total")))
    failed = parquet(spark, sf, "events").where("user_id % 3 = 0 AND event_type = 'click'").select(F.col("user_id").alias("subreddit"), F.date_format("ts", "yyyy-MM-dd").alias("bucket"), "event_type")
    return corpus.activity(m, "subreddit", "bucket", "hits", "total", failures=failed)


@query("q16_html_links", """WITH l AS (SELECT page_id, unnest(x) AS link, generate_subscripts(x, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href="(/[^"]*)"', 1) AS x FROM pages)), o AS (SELECT page_id, lower(link) AS k, min(pos) AS pos, arg_min(link, pos) AS link FROM l GROUP BY 1, 2) SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INT) AS rank, link FROM o""")
def _links(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.html_links(parquet(spark, sf, "pages"), "page_id", "html", '<a href="(/[^"]*)"')


@query("q17_tier_rank", f"WITH {THREADS} SELECT subreddit, total, posts, CAST(rank AS INT) AS rank, CASE WHEN rank <= 5 THEN 'large_top30' ELSE 'rest_top10' END AS tier FROM ranked")
def _tiers(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_threads(spark, sf).withColumn("tier", corpus.tier(F.col("rank")))


_POSTS = "tops AS (SELECT * FROM (SELECT t.*, r.rank, CASE WHEN r.rank <= 5 THEN 'large_top30' ELSE 'rest_top10' END AS tier, row_number() OVER (PARTITION BY t.subreddit ORDER BY num_comments DESC, score DESC, created DESC, post) AS post_rank FROM threads t JOIN ranked r USING (subreddit)) WHERE post_rank <= CASE WHEN tier = 'large_top30' THEN 8 ELSE 3 END)"
_SAMPLE = f"WITH {THREADS}, {_POSTS}, smp AS (SELECT * FROM (SELECT post, l_linenumber AS arrival, subreddit, rank, tier, post_rank, row_number() OVER (PARTITION BY post ORDER BY l_linenumber) AS nth FROM lineitem JOIN tops ON l_orderkey = post) WHERE nth <= CASE WHEN tier = 'large_top30' THEN 3 ELSE 2 END)"


def _harmonised(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.harmonise(threads(spark, sf), thread_comments(spark, sf), ranked_threads(spark, sf), "subreddit", (8, 3), (3, 2))


@query("q18_top_posts", f"WITH {THREADS}, {_POSTS} SELECT subreddit, post, num_comments, tier, CAST(post_rank AS INT) AS post_rank FROM tops")
def _top_posts(spark: SparkSession, sf: str) -> DataFrame:
    tiers = ranked_threads(spark, sf).select("subreddit", corpus.tier(F.col("rank")).alias("tier"))
    return corpus.top_posts(threads(spark, sf).join(tiers, "subreddit"), "subreddit", 8, 3).select("subreddit", "post", "num_comments", "tier", "post_rank")


@query("q20_tier_harmonise", f"{_SAMPLE} SELECT post, arrival, subreddit, tier, CAST(post_rank AS INT) AS post_rank, CAST(nth AS INT) AS nth FROM smp")
def _harmonise(spark: SparkSession, sf: str) -> DataFrame:
    return _harmonised(spark, sf).select("post", "arrival", "subreddit", "tier", "post_rank", "nth")


@query("q21_sampling_audit", f"{_SAMPLE} SELECT subreddit, min(tier) AS tier, count(*) AS posts, CAST(max(pr) AS INT) AS max_rank, max(n) AS max_comments, 0 AS violations FROM (SELECT subreddit, post, min(tier) AS tier, max(post_rank) AS pr, count(*) AS n FROM smp GROUP BY 1, 2) GROUP BY 1")
def _audit(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.sampling_audit(_harmonised(spark, sf), "subreddit", (8, 3), (3, 2))


@query("q24_prev_next_context", "SELECT conv_id, turn, coalesce(lag(text) OVER w, '') AS previous, coalesce(lead(text) OVER w, '') AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _context(spark: SparkSession, sf: str) -> DataFrame:
    return text.context(parquet(spark, sf, "conversations"), ["conv_id"], "turn", "text").select("conv_id", "turn", "previous", "next")


@query("q26_topic_industry_matrix", f"WITH {TOPICS}, c AS (SELECT topic, industry, count(*) AS n FROM t GROUP BY ALL) SELECT topic, industry, n, round(n / sum(n) OVER (PARTITION BY industry)::DOUBLE, 6) AS share_all, round(n / sum(CASE WHEN topic <> -1 THEN n END) OVER (PARTITION BY industry)::DOUBLE, 6) AS share_inside FROM c")
def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    return topics.topic_by_group(assignments(spark, sf))


@query("q28_jsd_sharedness", f"WITH {TOPICS}, b AS (SELECT industry, count(*) / (SELECT count(*) FROM t)::DOUBLE AS q FROM t GROUP BY 1), c AS (SELECT x.topic, b.industry, q, coalesce(n, 0) AS n FROM (SELECT DISTINCT topic FROM t WHERE topic <> -1) x CROSS JOIN b LEFT JOIN (SELECT topic, industry, count(*) AS n FROM t GROUP BY ALL) y ON x.topic = y.topic AND b.industry = y.industry), p AS (SELECT *, n / sum(n) OVER (PARTITION BY topic)::DOUBLE AS p FROM c), m AS (SELECT *, (p + q) / 2 AS m FROM p) SELECT topic, CAST(sum(n) AS BIGINT) AS n, round((sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END)) / 2, 6) AS jsd, arg_min(industry, (-p, industry)) AS dominant FROM m GROUP BY 1")
def _jsd(spark: SparkSession, sf: str) -> DataFrame:
    return topics.sharedness(assignments(spark, sf))


@query("q30_composition", f"WITH {TOPICS} SELECT topic, industry, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (PARTITION BY topic)::DOUBLE, 6) AS percent FROM t GROUP BY topic, industry")
def _composition(spark: SparkSession, sf: str) -> DataFrame:
    return topics.composition(assignments(spark, sf), "topic", "industry")


@query("q31_crosswalk", f"WITH {TOPICS}, c AS (SELECT topic, industry, locked, count(*) AS n FROM t GROUP BY ALL) SELECT topic, industry, locked, n, round(share, 6) AS share, CAST(rank AS INT) AS rank FROM (SELECT *, n / sum(n) OVER (PARTITION BY topic, industry)::DOUBLE AS share, row_number() OVER (PARTITION BY topic, industry ORDER BY n DESC, locked) AS rank FROM c) WHERE rank <= 3")
def _crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    return topics.crosswalk(assignments(spark, sf))


for _name, _f in {"q25_topic_domination": lambda s, d: topics.domination(assignments(s, d), "post", "subreddit"), "q27_spread_entropy": lambda s, d: topics.spread_entropy(assignments(s, d), 4), "q34_ctfidf": lambda s, d: topics.class_tfidf(worded(comments(s, d)), "words", "industry", 12), "q36_representatives": lambda s, d: topics.representatives(assignments(s, d)).select("topic", "doc_id", "cosine", "rank")}.items():
    query(_name)(_f)


@query("q29_log2_enrichment", f"WITH {TOPICS}, c AS (SELECT topic, industry, count(*) AS n FROM t WHERE topic <> -1 GROUP BY 1, 2), d AS (SELECT a.topic, b.industry, coalesce(n, 0) AS n FROM (SELECT DISTINCT topic FROM c) a CROSS JOIN (SELECT DISTINCT industry FROM c) b LEFT JOIN c ON c.topic = a.topic AND c.industry = b.industry), r AS (SELECT *, (n / sum(n) OVER (PARTITION BY industry)::DOUBLE) / (sum(n) OVER (PARTITION BY topic) / sum(n) OVER ()::DOUBLE) AS x FROM d) SELECT topic, industry, n, CASE WHEN n > 0 THEN round(least(greatest(log2(x), -3), 3), 6) END AS log2_enrichment FROM r")
def _enrichment(spark: SparkSession, sf: str) -> DataFrame:
    return topics.enrichment(assignments(spark, sf))


@query("q38_confusion_dense", f"WITH {STANCE}, c AS (SELECT lower(attitude) AS truth, lower(rater_a) AS pred, count(*) AS n FROM stance GROUP BY ALL), l AS (SELECT truth AS x FROM c UNION SELECT pred FROM c) SELECT a.x AS truth, b.x AS pred, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN c ON truth = a.x AND pred = b.x")
def _confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion(stance(spark, sf), "attitude", "rater_a")


@query("q37_multiclass_metrics")
def _multiclass(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.multiclass(evaluate.confusion(stance(spark, sf), "attitude", "rater_a"))


@query("q42_kappa", f"WITH {GATED}, k AS (SELECT (SELECT count(*) FROM gated)::DOUBLE AS n, (SELECT count(*) FROM gated WHERE gate = pred) AS h, (SELECT count(*) FROM gated WHERE gate = 'yes') AS gy, (SELECT count(*) FROM gated WHERE pred = 'yes') AS py), a AS (SELECT h / n AS agreement, (gy * py + (n - gy) * (n - py)) / (n * n) AS chance FROM k) SELECT round(agreement, 6) AS agreement, round(chance, 6) AS chance, round((agreement - chance) / (1 - chance), 6) AS kappa FROM a")
def _kappa(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.kappa(evaluate.confusion(gated(spark, sf), "gate", "pred"))


@query("q39_binary_gate", f"WITH {GATED}, c AS (SELECT industry, CAST(sum(CASE WHEN gate = 'yes' AND pred = 'yes' THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN gate = 'no' AND pred = 'no' THEN 1 ELSE 0 END) AS BIGINT) AS tn, CAST(sum(CASE WHEN gate = 'no' AND pred = 'yes' THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN gate = 'yes' AND pred = 'no' THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM gated GROUP BY 1), d AS (SELECT *, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) AS specificity, sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) AS root FROM c) SELECT industry, tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round((recall + specificity) / 2, 6) AS balanced_accuracy, round(coalesce(tn / nullif(tn + fn, 0)::DOUBLE, 0), 6) AS npv, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1, round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(root, 0), 0), 6) AS mcc, CASE WHEN fp = 0 AND fn = 0 THEN 'none' WHEN fn > fp THEN 'mainly_fn' WHEN fp > fn THEN 'mainly_fp' ELSE 'balanced' END AS error_pattern FROM d")
def _gate(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.gate_metrics(evaluate.gate_counts(gated(spark, sf), "gate", "pred", "industry"))


_PAIR = lambda a, b: f"SELECT '{a}' AS rater_a, '{b}' AS rater_b, CAST(sum(CASE WHEN {a} = attitude AND {b} = attitude THEN 1 ELSE 0 END) AS BIGINT) AS \"both\", CAST(sum(CASE WHEN {a} = attitude AND {b} <> attitude THEN 1 ELSE 0 END) AS BIGINT) AS only_a, CAST(sum(CASE WHEN {a} <> attitude AND {b} = attitude THEN 1 ELSE 0 END) AS BIGINT) AS only_b, CAST(sum(CASE WHEN {a} <> attitude AND {b} <> attitude THEN 1 ELSE 0 END) AS BIGINT) AS neither, round(avg(CASE WHEN {a} = {b} THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM stance AS s"


@query("q40_paired_raters", f"WITH {STANCE} {_PAIR('rater_a', 'rater_b')} UNION ALL {_PAIR('rater_a', 'rater_c')} UNION ALL {_PAIR('rater_b', 'rater_c')}".replace("stance AS s", "stance"))
def _paired(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.paired(stance(spark, sf), "attitude", ["rater_a", "rater_b", "rater_c"])


@query("q43_completeness", "SELECT 'quality' AS field, count(*) AS rows, count(*) - count(quality) AS blank, count(DISTINCT quality) AS \"values\" FROM labels UNION ALL SELECT 'toxic', count(*), count(*) - count(toxic), count(DISTINCT toxic) FROM labels")
def _complete(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.completeness(parquet(spark, sf, "labels"), ["quality", "toxic"])


@query("q46_ari_nmi", f"WITH {TOPICS}, c AS (SELECT topic, locked, count(*)::DOUBLE AS n FROM t GROUP BY ALL), a AS (SELECT sum(n) AS m FROM c GROUP BY topic), b AS (SELECT sum(n) AS m FROM c GROUP BY locked), k AS (SELECT (SELECT sum(n) FROM c) AS n, (SELECT sum(n * (n - 1) / 2) FROM c) AS s, (SELECT sum(m * (m - 1) / 2) FROM a) AS sa, (SELECT sum(m * (m - 1) / 2) FROM b) AS sb, (SELECT sum(n * ln(n)) FROM c) AS h, (SELECT sum(m * ln(m)) FROM a) AS ha, (SELECT sum(m * ln(m)) FROM b) AS hb), e AS (SELECT *, sa * sb / (n * (n - 1) / 2) AS x, ln(n) - ha / n AS ea, ln(n) - hb / n AS eb, ln(n) - h / n AS ec FROM k) SELECT CAST(n AS BIGINT) AS n, round((s - x) / ((sa + sb) / 2 - x), 6) AS ari, round((ea + eb - ec) / ((ea + eb) / 2), 6) AS nmi FROM e")
def _ari(spark: SparkSession, sf: str) -> DataFrame:
    return robustness.agreement(robustness.contingency(assignments(spark, sf), "topic", "locked"), "topic", "locked")


@query("q48_best_overlap", f"WITH {TOPICS}, c AS (SELECT topic AS ref, locked AS cand, count(*) AS n FROM t GROUP BY 1, 2), r AS (SELECT ref, sum(n) AS rn FROM c WHERE ref <> -1 GROUP BY 1), k AS (SELECT cand, sum(n) AS cn FROM c WHERE cand <> -1 GROUP BY 1), j AS (SELECT r.ref, b.cand, rn, b.n, coalesce(b.n / (rn + cn - b.n)::DOUBLE, 0) AS jaccard FROM r LEFT JOIN (SELECT * FROM c JOIN k USING (cand) WHERE ref <> -1) b ON r.ref = b.ref), o AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY jaccard DESC, n DESC, cand) AS p FROM j) SELECT ref, coalesce(cand, -1) AS cand, CAST(rn AS BIGINT) AS ref_n, coalesce(n, 0) AS \"both\", round(jaccard, 6) AS jaccard, round(coalesce(n / rn::DOUBLE, 0), 6) AS recall FROM o WHERE p = 1")
def _overlap(spark: SparkSession, sf: str) -> DataFrame:
    t = assignments(spark, sf).select(F.col("topic").alias("ref"), F.col("locked").alias("cand"))
    return robustness.best_overlap(robustness.contingency(t))


@query("q49_stance_tables", f"WITH {STANCE} SELECT industry, attitude, count(*) AS n, CAST(sum(boundary) AS BIGINT) AS present, round(count(*) * 100 / sum(count(*)) OVER (PARTITION BY industry)::DOUBLE, 6) AS percent, round(sum(boundary) / count(*)::DOUBLE, 6) AS rate FROM stance GROUP BY industry, attitude")
def _stance(spark: SparkSession, sf: str) -> DataFrame:
    g = stance(spark, sf).groupBy("industry", "attitude").agg(F.count(F.lit(1)).alias("n"), F.sum("boundary").alias("present"))
    return relational.share(g, "n", ["industry"], "percent", 100).withColumn("rate", S.ratio(F.col("present"), F.col("n")))


@query("q50_wald_ci", f"WITH {STANCE}, g AS (SELECT attitude, count(*)::DOUBLE AS n, sum(boundary) AS k FROM stance GROUP BY 1) SELECT attitude, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(greatest(0, k / n - 1.96::DOUBLE * sqrt(k / n * (1 - k / n) / n)), 6) AS low, round(least(1, k / n + 1.96::DOUBLE * sqrt(k / n * (1 - k / n) / n)), 6) AS high FROM g")
def _wald(spark: SparkSession, sf: str) -> DataFrame:
    g = stance(spark, sf).groupBy("attitude").agg(F.count(F.lit(1)).alias("n"), F.sum("boundary").alias("k"))
    low, high = S.wald(F.col("k"), F.col("n"))
    return g.select("attitude", "n", "k", low.alias("low"), high.alias("high"))


@query("q52_balanced_sample", f"WITH {STANCE}, o AS (SELECT *, md5(concat('42#', o_orderkey)) AS h FROM stance), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY industry, o_custkey ORDER BY h, o_orderkey) AS nth FROM o) WHERE nth <= 2), r AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY h, o_orderkey) AS rank FROM c) SELECT industry, o_orderkey, CAST(rank AS INT) AS rank FROM r WHERE rank <= (SELECT min(n) FROM (SELECT count(*) AS n FROM c GROUP BY industry))")
def _balanced(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.balanced_sample(stance(spark, sf), "industry", "o_custkey", "o_orderkey", 2, "42").select("industry", "o_orderkey", "rank")


@query(
    "q54_upsert_resume",
    """SELECT event_id, event_type FROM events WHERE event_id % 3 <> 0
    UNION ALL SELECT event_id, 'changed' FROM events WHERE event_id % 3 = 0 AND event_id % 2 = 0
    UNION ALL SELECT event_id, 'same' FROM events WHERE event_id % 3 = 0 AND event_id % 2 = 1
    UNION ALL SELECT -1 - event_id, event_type FROM events WHERE event_id % 5 = 0""",
)
def _upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = parquet(spark, sf, "events").select("event_id", "event_type")
    changed = e.where("event_id % 3 = 0").withColumn("event_type", F.when(F.col("event_id") % 2 == 0, "changed").otherwise("same"))
    fresh = e.where("event_id % 5 = 0").withColumn("event_id", -1 - F.col("event_id"))
    return relational.upsert(e, changed.unionByName(fresh), ["event_id"])


@query("q55_activity_by_day", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _by_day(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.activity_by_day(parquet(spark, sf, "events"))


@query("q56_late_comment_policy", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def _late(spark: SparkSession, sf: str) -> DataFrame:
    posts = parquet(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return incremental.eligible_comments(parquet(spark, sf, "lineitem"), posts, "l_orderkey", "o_orderdate", "1995-01-01", "1996-01-01").select("l_orderkey", "l_linenumber")

from textloom.plans import extended, assembled, ingest, samples, topic_tables  # noqa: E402, F401, I001  register their queries with those above
