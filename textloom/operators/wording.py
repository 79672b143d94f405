"""Words that stand for topics: near to the topic, and unlike each other.

A topic's vector is the mean of its documents' vectors, a term's that of the documents which hold it. Of a topic's candidates the
choice is greedy: each next word has the greatest (1 - diversity) * relevance - diversity * likeness, relevance being its
cosine to the topic and likeness the greatest cosine to a word chosen before. Topics are chosen for side by side; a task holds
one topic's candidates, whose number is a parameter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import neighbours, topics

CHOSEN = "topic string, rank int, term string, relevance double, likeness double"


def _mean(rows: DataFrame, by: str, v: str, width: int) -> DataFrame:
    return rows.groupBy(by).agg(F.array(*[F.avg(F.col(v)[i]) for i in range(width)]).alias("m"))


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    length = lambda z: np.maximum(np.sqrt((z * z).sum(-1, keepdims=True)), 1e-300)
    return (x / length(x)) @ (y / length(y)).T


def chosen_words(candidates: DataFrame, k: int = 12, diversity: float = 0.3) -> DataFrame:
    """(topic, rank, term, relevance, likeness) from candidates (topic, term, vector, topic_vector); ties go by term."""

    def choose(group: pa.Table) -> pa.Table:
        group = group.sort_by("term")
        terms, x = group.column("term").to_pylist(), neighbours.matrix(group.column("vector").combine_chunks())
        relevance = _cosines(x, neighbours.matrix(group.column("topic_vector").combine_chunks())[:1])[:, 0].round(12)
        alike, near, left, out = _cosines(x, x).round(12), np.zeros(len(terms)), np.ones(len(terms), bool), []
        while left.any() and len(out) < k:
            best = int(np.argmax(np.where(left, (1 - diversity) * relevance - diversity * near, -np.inf)))
            out.append((len(out) + 1, terms[best], relevance[best], near[best]))
            left[best] = False
            near = alike[best] if len(out) == 1 else np.maximum(near, alike[best])
        columns = list(zip(*out, strict=True))
        return pa.table({"topic": pa.array([group.column("topic")[0].as_py()] * len(out), pa.string()), "rank": pa.array(columns[0], pa.int32()), "term": pa.array(columns[1], pa.string()), "relevance": columns[2], "likeness": columns[3]})

    rows = candidates.select(F.col("topic").cast("string").alias("topic"), "term", "vector", "topic_vector")
    return rows.groupBy("topic").applyInArrow(choose, CHOSEN)


def topic_words(docs: DataFrame, topic: str, words: str, v: str, k: int = 12, most: int = 40, diversity: float = 0.3, outlier: Column | None = None) -> DataFrame:
    """The words of each topic among its `most` best by class TF-IDF, from documents with a topic, words and a vector.

    Rows without a topic, or that are outliers, give no topic; a document counts once for a term however often it holds it. Vectors
    are of one length; a null or empty one takes no part in the means.
    """
    inside = docs.where(F.col(topic).isNotNull() if outlier is None else F.col(topic).isNotNull() & ~outlier).select(F.col(topic).alias("topic"), F.col(words).alias("words"), F.col(v).cast("array<double>").alias("v"))
    first = inside.where(F.size("v") > 0).select(F.size("v").alias("n")).first()
    if first is None:
        return docs.sparkSession.createDataFrame([], CHOSEN)
    best = topics.class_tfidf(inside, "words", "topic", most, 1.0).select("topic", "term")
    held = inside.where(F.size("v") > 0)
    by_term = held.select("v", F.explode(F.array_distinct("words")).alias("term")).join(best.select("term").distinct(), "term", "left_semi")
    of_terms = _mean(by_term, "term", "v", first["n"]).withColumnRenamed("m", "vector")
    of_topics = _mean(held, "topic", "v", first["n"]).withColumnRenamed("m", "topic_vector")
    return chosen_words(best.join(of_terms, "term").join(of_topics, "topic"), k, diversity)
