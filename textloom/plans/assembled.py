"""Further registered queries: inference, topic tables, discovery of topics, assembly of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import assembly, clustering, evaluate, inference, multinomial, mutual, robustness, spectral, stages, text, topics, wording
from textloom.operators.rows import parsed
from textloom.plans import extended  # noqa: F401  its SQL is used below
from textloom.plans.catalogue import _WORDS, COMMENTS, GATED, ORACLES, STANCE, TOPICS, WORDED, _stats, assignments, comments, gated, query, stance, worded
from textloom.sources.tables import metric_rows, parquet

# Fixed values of the views below.
GROUPS = [0, 1, 2, 3]


# Inference.


@query("q44_cluster_bootstrap", f"WITH {STANCE} SELECT attitude, count(*) AS n, round(avg(boundary), 6) AS rate, (SELECT count(DISTINCT o_custkey) FROM stance) AS clusters, true AS inside FROM stance GROUP BY 1")
def _bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    b = inference.cluster_bootstrap(stance(spark, sf), "o_custkey", "attitude", "boundary")
    return b.select("attitude", "n", "rate", "clusters", ((F.col("ci_low") <= F.col("rate")) & (F.col("rate") <= F.col("ci_high"))).alias("inside"))


@query("q44_stratified_bootstrap")
def _gate_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.stratified_bootstrap(gated(spark, sf), "gate", "pred", "industry")


_REF = "1-URGENT"


@query(
    "q45_logit_one_factor",
    f"""WITH {STANCE}, a AS (SELECT attitude, count(*)::DOUBLE AS n, sum(boundary)::DOUBLE AS y FROM stance GROUP BY 1), p AS (SELECT *, y / n AS p, ln(y / (n - y)) AS b FROM a),
    s AS (SELECT o_custkey, attitude, sum(boundary - p) / any_value(n * p * (1 - p)) AS s FROM stance JOIN p USING (attitude) GROUP BY 1, 2), v AS (SELECT attitude, sum(s * s) AS v FROM s GROUP BY 1),
    c AS (SELECT x.attitude, sum(x.s * r.s) AS c FROM s x JOIN s r ON x.o_custkey = r.o_custkey AND r.attitude = '{_REF}' GROUP BY 1),
    z AS (SELECT g / (g - 1) * (n - 1) / (n - k) AS z FROM (SELECT count(DISTINCT o_custkey)::DOUBLE AS g, count(*) AS n, count(DISTINCT attitude) AS k FROM stance)),
    r AS (SELECT b, v FROM p JOIN v USING (attitude) WHERE attitude = '{_REF}')
    SELECT CASE WHEN attitude = '{_REF}' THEN 'intercept' ELSE 'attitude=' || attitude END AS term, round(CASE WHEN attitude = '{_REF}' THEN p.b ELSE p.b - r.b END, 6) AS coef,
    round(sqrt(z * CASE WHEN attitude = '{_REF}' THEN v.v ELSE v.v + r.v - 2 * coalesce(c, 0) END), 6) AS std_err FROM p JOIN v USING (attitude) LEFT JOIN c USING (attitude), z, r""",
)
def _logit_one(spark: SparkSession, sf: str) -> DataFrame:
    return inference.logit(stance(spark, sf), "boundary", {"attitude": _REF}, "o_custkey")[0].select("term", "coef", "std_err")


@query("q45_logit_two_factors")
def _logit_two(spark: SparkSession, sf: str) -> DataFrame:
    return inference.logit(stance(spark, sf), "boundary", {"attitude": _REF, "industry": "AUTOMOBILE"}, "o_custkey")[0]


@query(
    "q45_multinomial",
    f"""WITH {STANCE}, c AS (SELECT industry, attitude, count(*)::DOUBLE AS n FROM stance GROUP BY 1, 2), o AS (SELECT c.industry, c.attitude, ln(c.n / b.n) AS odds FROM c JOIN c b ON b.industry = c.industry AND b.attitude = '{_REF}' WHERE c.attitude <> '{_REF}')
    SELECT o.attitude, CASE WHEN o.industry = 'AUTOMOBILE' THEN 'intercept' ELSE 'industry=' || o.industry END AS term, round(CASE WHEN o.industry = 'AUTOMOBILE' THEN o.odds ELSE o.odds - r.odds END, 6) AS coef FROM o JOIN o r ON r.attitude = o.attitude AND r.industry = 'AUTOMOBILE'""",
)
def _multinomial(spark: SparkSession, sf: str) -> DataFrame:
    return multinomial.multinomial(stance(spark, sf), "attitude", {"industry": "AUTOMOBILE"}, _REF).select(F.col("outcome").alias("attitude"), "term", "coef")


@query("q45_multinomial_two_factors")
def _multinomial_two(spark: SparkSession, sf: str) -> DataFrame:
    return multinomial.multinomial(stance(spark, sf), "attitude", {"industry": "AUTOMOBILE", "boundary": "0"}, _REF, "o_custkey")


# Topics.


def _ctfidf(cells: str, by: str, k: int, max_df: float) -> str:
    return f"""c AS (SELECT {by}, term, count(*) AS n FROM ({cells}) GROUP BY ALL), f AS (SELECT *, sum(n) OVER (PARTITION BY term) AS f, count(*) OVER (PARTITION BY term) AS df, sum(n) OVER (PARTITION BY {by}) AS total FROM c),
    a AS (SELECT avg(t) AS a, count(*) AS classes FROM (SELECT sum(n) AS t FROM c GROUP BY {by})), s AS (SELECT {by}, term, n / total::DOUBLE * ln(1 + a / f::DOUBLE) AS score FROM f, a WHERE df <= greatest(classes * {max_df}, 1.0)),
    best AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, term) AS rank FROM s QUALIFY rank <= {k})"""


@query("q34_topics_per_class", f"WITH {WORDED}, {_ctfidf('SELECT gate AS topic, industry, unnest(words) AS term FROM worded', 'topic, industry', 10, 1.0)} SELECT topic, industry, term, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM best")
def _per_class(spark: SparkSession, sf: str) -> DataFrame:
    return topics.topics_per_class(worded(gated(spark, sf)), "words", "gate", "industry")


@query(
    "q36_topic_summary",
    f"""WITH {COMMENTS}, {TOPICS}, {_ctfidf(f'SELECT topic, unnest({_WORDS}) AS term FROM comments JOIN t USING (doc_id)', 'topic', 10, 1.0)}, w AS (SELECT topic, string_agg(term, '; ' ORDER BY rank) AS terms FROM best GROUP BY 1),
    e AS (SELECT topic, string_agg(CAST(doc_id AS VARCHAR), '; ' ORDER BY rank) AS examples FROM ({ORACLES['q36_representatives']}) GROUP BY 1), d AS ({ORACLES['q25_topic_domination']})
    SELECT topic, n, round(n / sum(n) OVER ()::DOUBLE, 6) AS share, round(CASE WHEN topic <> -1 THEN n / sum(CASE WHEN topic <> -1 THEN n END) OVER ()::DOUBLE END, 6) AS share_inside, posts, subreddits, flagged, coalesce(terms, '') AS terms, coalesce(examples, '') AS examples FROM d LEFT JOIN w USING (topic) LEFT JOIN e USING (topic)""",
)
def _summary(spark: SparkSession, sf: str) -> DataFrame:
    t = assignments(spark, sf)
    told = worded(comments(spark, sf).select("doc_id", "body")).join(t.select("doc_id", "topic"), "doc_id")
    return topics.topic_summary(t, topics.class_tfidf(told, "words", "topic", 10, 1.0), topics.representatives(t))


_PROFILES = f"p AS (SELECT topic, {', '.join(f'sum(CASE WHEN industry = {g} THEN 1 ELSE 0 END)::DOUBLE AS g{g}' for g in GROUPS)} FROM t WHERE topic <> -1 GROUP BY 1)"
_DOT = lambda x, y: " + ".join(f"{x}.g{g} * {y}.g{g}" for g in GROUPS)


@query("q35_profile_distances", f"WITH {TOPICS}, {_PROFILES} SELECT a.topic AS a, b.topic AS b, round(1 - ({_DOT('a', 'b')}) / sqrt(({_DOT('a', 'a')}) * ({_DOT('b', 'b')})), 6) AS distance FROM p a JOIN p b ON a.topic < b.topic")
def _distances(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.profile_distances(assignments(spark, sf), GROUPS)


@query("q35_profile_tree")
def _tree(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(clustering.average_linkage(clustering.profile_distances(assignments(spark, sf), GROUPS)), "first long, second long, distance double, size long")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled comments as vectors of their words; a topic is to be found without the language, which `ref` holds."""
    w = worded(gated(spark, sf)).select("doc_id", F.col("industry").alias("ref"), "words")
    return spectral.text_vectors(w, "words").select("doc_id", "ref", "v")


def _found(rows: DataFrame, k: int, least: int = 15) -> DataFrame:
    return clustering.clustered(rows, "doc_id", "v", least, 5, k).select("doc_id", "topic", "ref")


@query("q64_clusters")
def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    return _found(_texts(spark, sf), 15)


@query("q64_sweep_report")
def _sweep(spark: SparkSession, sf: str) -> DataFrame:
    made = clustering.swept(_texts(spark, sf), {f"k{k}": {"k": k} for k in (10, 15)}, _found, at_once=2)
    rows = {n: robustness.agreement(robustness.contingency(d, "ref", "topic"), "ref", "topic") for n, d in made.items()}
    return clustering.combined_report(rows, {"k15": "chosen"})


@query(
    "q47_adjusted_mutual_information",
    f"""WITH {TOPICS}, c AS (SELECT topic, locked, count(*)::DOUBLE AS m FROM t GROUP BY 1, 2), a AS (SELECT topic, sum(m) AS a FROM c GROUP BY 1), b AS (SELECT locked, sum(m) AS b FROM c GROUP BY 1), n AS (SELECT sum(m) AS n FROM c),
    i AS (SELECT sum(m / n * ln(n * m / (a * b))) AS mutual FROM c JOIN a USING (topic) JOIN b USING (locked), n),
    h AS (SELECT (SELECT -sum(a / n * ln(a / n)) FROM a, n) / 2 + (SELECT -sum(b / n * ln(b / n)) FROM b, n) / 2 AS mean),
    k AS (SELECT a, b, n, unnest(range(greatest(1, a + b - n)::BIGINT, least(a, b)::BIGINT + 1)) AS k FROM a, b, n),
    e AS (SELECT sum(k / n * ln(n * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(n - a - b + k + 1))) AS expected FROM k)
    SELECT n::BIGINT AS n, round(mutual, 6) AS mutual, round(expected, 6) AS expected, round((mutual - expected) / (mean - expected), 6) AS ami FROM n, i, h, e""",
)
def _ami(spark: SparkSession, sf: str) -> DataFrame:
    return mutual.adjusted_mutual_information(robustness.contingency(assignments(spark, sf), "topic", "locked"), "topic", "locked")


@query("q35_topic_words")
def _topic_words(spark: SparkSession, sf: str) -> DataFrame:
    docs = worded(gated(spark, sf)).select("industry", "words")
    return wording.topic_words(spectral.text_vectors(docs, "words", 64), "industry", "words", "v")


# Text.


@query("q05_evidence_table")
def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    w = stages.kept(worded(gated(spark, sf)), "words")  # read by each part, cut into words once
    keyed = None
    for n in (1, 2):
        one = text.keyness(w, "words", "gate", n, 10 if n == 1 else 5, 5).withColumn("n", F.lit(n))
        keyed = one if keyed is None else keyed.unionByName(one)
    return text.evidence_table(keyed, text.collocations(w.where("gate = 'yes'"), "words", text.keyword_candidates(w, "words", "gate")))


# Assembly.


@query("q63_metric_rows", f"WITH {COMMENTS}, m AS (SELECT count(*) AS rows, count(DISTINCT industry) AS groups, sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END)::BIGINT AS unlabelled FROM comments) SELECT 0 AS place, 'rows' AS metric, CAST(rows AS VARCHAR) AS value FROM m UNION ALL SELECT 1, 'groups', CAST(groups AS VARCHAR) FROM m UNION ALL SELECT 2, 'unlabelled', CAST(unlabelled AS VARCHAR) FROM m")
def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metric_rows(comments(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("industry").alias("groups"), F.count_if(F.col("quality").isNull()).alias("unlabelled")))


@query("q63_keywords", "SELECT p_name AS keyword, p_name AS query, p_name AS occupation_keyword FROM part")
def _keywords(spark: SparkSession, sf: str) -> DataFrame:
    return assembly.keyword_rows(parquet(spark, sf, "part").select(F.col("p_name").alias("keyword")))


@query(
    "q63_master",
    """WITH m AS (SELECT c_custkey AS place, c_mktsegment AS industry, CASE WHEN c_custkey % 7 = 0 THEN 'row_' || c_custkey ELSE 'c' || (c_custkey // 2) END AS comment_id, CASE WHEN c_custkey % 5 = 0 THEN 'UK_strong' ELSE 'non_UK_or_unclear' END AS uk_status FROM customer)
    SELECT place, industry, comment_id, CASE WHEN count(*) OVER (PARTITION BY comment_id) > 1 THEN comment_id || '__row_' || place ELSE comment_id END AS annotation_id, uk_status FROM m""",
)
def _master(spark: SparkSession, sf: str) -> DataFrame:
    c = parquet(spark, sf, "customer")
    ids = F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.concat(F.lit("c"), F.expr("c_custkey div 2").cast("string")))
    raw = c.select(F.col("c_custkey").alias("place"), F.col("c_mktsegment").alias("source_dataset"), ids.alias("comment_id"), (F.col("c_custkey") % 5 == 0).cast("int").alias("uk_strong_relevant"))
    return assembly.master_rows(raw, "place").select("place", "industry", "comment_id", "annotation_id", "uk_status")


@query("q63_boundary_input", f"WITH {COMMENTS} SELECT doc_id, length(trim(body)) >= 400 AS kept FROM comments")
def _boundary(spark: SparkSession, sf: str) -> DataFrame:
    kept, short = assembly.boundary_input(comments(spark, sf), "doc_id", "body", 400)
    return kept.select("doc_id", F.lit(True).alias("kept")).unionByName(short.select("doc_id", F.lit(False).alias("kept")))


@query("q63_frequency_by_group", f"WITH {WORDED} SELECT industry, term, f, df FROM ({_stats('industry')}) WHERE df >= 3")
def _by_group(spark: SparkSession, sf: str) -> DataFrame:
    return assembly.frequency_exports(worded(gated(spark, sf)), "words", "industry")["grouped"]


@query("q63_harmonised_gate", f"WITH {STANCE} SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN attitude IN ('1-URGENT', '2-HIGH') THEN 'yes' ELSE 'no' END ELSE 'no' END AS gate FROM stance")
def _gates(spark: SparkSession, sf: str) -> DataFrame:
    gate = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(" No")
    return stance(spark, sf).select("o_orderkey", assembly.harmonised_gate(gate, F.col("attitude"), ["1-urgent", "2-high"]).alias("gate"))


@query("q63_renumbered_sample", "WITH s AS (SELECT c_custkey FROM customer ORDER BY md5('42#' || c_custkey), c_custkey LIMIT 25) SELECT c_custkey, 'val_' || lpad(CAST(row_number() OVER (ORDER BY c_custkey) AS VARCHAR), 3, '0') AS validation_id FROM s")
def _renumbered(spark: SparkSession, sf: str) -> DataFrame:
    return assembly.renumbered_sample(parquet(spark, sf, "customer").select("c_custkey"), "c_custkey", 25, "42", "val")


@query(
    "q63_validation_set",
    "WITH o AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0) SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'existing' WHEN c_custkey % 3 = 0 THEN 'overlap' ELSE 'displaced' END AS sample_source FROM o UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 2 = 1 AND c_mktsegment = 'BUILDING'",
)
def _validation(spark: SparkSession, sf: str) -> DataFrame:
    c = parquet(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    found, displaced = assembly.validation_set(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1 AND c_mktsegment = 'BUILDING'"), c.where("c_custkey % 3 = 0"), "c_custkey", "c_mktsegment", "BUILDING")
    return found.select("c_custkey", "sample_source").unionByName(displaced.select("c_custkey", F.lit("displaced").alias("sample_source")))


@query("q63_field_evaluation", f"WITH {STANCE}, f AS (SELECT 'rater_a' AS field, lower(attitude) AS t, lower(rater_a) AS p FROM stance UNION ALL SELECT 'rater_b', lower(attitude), lower(rater_b) FROM stance) SELECT field, count(*) AS n, round(avg(CASE WHEN t = p THEN 1 ELSE 0 END), 6) AS accuracy FROM f GROUP BY 1")
def _fields(spark: SparkSession, sf: str) -> DataFrame:
    s = stance(spark, sf)
    return assembly.field_evaluation(s, {f: ("attitude", f) for f in ("rater_a", "rater_b")}).select("field", "n", "accuracy")


@query("q63_combined_runs", f"WITH {STANCE} SELECT o_orderkey, rater_a AS m_label FROM stance WHERE o_orderkey % 2 = 0")
def _combined(spark: SparkSession, sf: str) -> DataFrame:
    s = stance(spark, sf).select("o_orderkey", F.col("rater_a").alias("label"))
    runs = [s.where("o_orderkey % 4 <> 2"), s.where("o_orderkey % 4 >= 1")]
    return assembly.combined_runs(runs, "o_orderkey", ["label"], s.where("o_orderkey % 2 = 0"), {"label": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}, "m")


@query("q63_metadata", "SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN n_name ELSE '' END AS policy FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _metadata(spark: SparkSession, sf: str) -> DataFrame:
    n = parquet(spark, sf, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("policy"))
    return assembly.with_metadata(parquet(spark, sf, "customer"), n, "c_nationkey").select("c_custkey", "policy")


@query(
    "q63_responses",
    "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_name || chr(10) || c_mktsegment ELSE '' END AS answer, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS input_tokens FROM customer",
)
def _responses(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    told = F.concat(F.lit('{"output_text": "'), "c_name", F.lit('", "usage": {"input_tokens": '), F.col("c_custkey").cast("string"), F.lit("}}"))
    nested = F.concat(F.lit('{"output": [{"content": [{"text": "'), "c_name", F.lit('"}, {"text": ""}]}, {"content": null}, {"content": [{"text": "'), "c_mktsegment", F.lit('"}]}]}'))
    c = parquet(spark, sf, "customer").select("c_custkey", parsed(F.when(k == 0, told).when(k == 1, nested).otherwise("no JSON"), assembly.RESPONSE).alias("r"))
    return c.select("c_custkey", assembly.response_text(F.col("r")).alias("answer"), assembly.response_usage(F.col("r"))["input_tokens"].alias("input_tokens"))


@query("q63_topic_sources", f"WITH {TOPICS}, u AS (SELECT CAST(industry AS VARCHAR) AS industry, topic FROM t WHERE topic <> -1 UNION ALL SELECT 'pooled', topic FROM t WHERE topic <> -1) SELECT industry, topic, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY industry)::DOUBLE, 6) AS share FROM u GROUP BY 1, 2")
def _sources(spark: SparkSession, sf: str) -> DataFrame:
    t = assignments(spark, sf)
    return assembly.topic_sources({str(g): t.where(F.col("industry") == g).select("topic") for g in GROUPS}, t.select("topic")).select("industry", "topic", "n", "share")


@query("q63_template", f"WITH {GATED} SELECT CAST(doc_id AS VARCHAR) AS doc_id, industry, '' AS permalink, '' AS human_label FROM gated")
def _template(spark: SparkSession, sf: str) -> DataFrame:
    return assembly.annotation_template(gated(spark, sf), ["doc_id", "industry", "permalink"], ["human_label"])
