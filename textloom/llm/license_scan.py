"""Licence scanning: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory. DataFrame functions only.

Comment marks are stripped. Candidates of a whole text are its lines, their sentences, its blocks
(consecutive lines joined) and all of it, so that notices, headers and licence files all meet the
templates in licence_forms: notices, usual headers and full texts. A match must hold all keys of its
template; the cue that spares other candidates is made of these keys. Equal candidates are scored once.
A vector holds the counts of the terms times their inverse document frequency over all distinct
candidates and templates; only terms that it shares with a template meet one. SPDX identifiers are read
as such and score 1. A document has the licence of its best candidate, if the cosine reaches the
threshold; a named licence goes before 'All rights reserved'. One without takes the licence of the
nearest directory above it, by a join of its ancestor paths with the directories whose licence file
has a licence.

Defined results: null texts have no lines and null paths no ancestors. Ties between templates go to
the name that sorts first, also between the identifiers of an SPDX expression. Repeated rows stay
repeated, an empty table gives an empty table, and other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import licence_forms, storage
from .licence_forms import CUE, RESERVED, SPDX, SPDX_LINE, TEMPLATES  # noqa: F401

TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice)(\.[a-z]+)?$"
THRESHOLD = 0.8


MARKS = r"(?m)^[ \t]*(?:(?://+|/\*+|\*+/?|#+|--+|;+|%+|<!--)[ \t]*)?|[ \t\r]*(?:\*+/|-->)?[ \t\r]*$"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), "licence", "license"), F.lit(TERM), F.lit(0))


def candidates(text: Column) -> Column:
    """The distinct lines, sentences of lines, blocks and whole of a text that have a cue."""
    bare = F.regexp_replace(text, MARKS, "")
    joined = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    with_cue = lambda xs: F.filter(xs, lambda x: x.rlike(CUE))
    lines = with_cue(F.transform(F.split(bare, "\n"), joined))
    sentences = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.;]) ")))
    blocks = F.transform(with_cue(F.split(text, r"\n[ \t\r]*\n")), lambda x: joined(F.regexp_replace(x, MARKS, "")))
    return F.array_distinct(F.concat(lines, with_cue(sentences), blocks, F.array(joined(bare))))


def spdx_licences(text: Column) -> Column:
    """The known licences that SPDX lines name."""
    expressions = F.regexp_extract_all(text, F.lit(SPDX_LINE), F.lit(1))
    ids = F.flatten(F.transform(expressions, lambda x: F.split(F.regexp_replace(F.lower(x), r"[()]|-->", " "), r"\s+")))
    known = F.create_map(*[F.lit(x) for pair in SPDX.items() for x in pair])
    return F.filter(F.transform(ids, lambda x: F.element_at(known, F.regexp_replace(x, r"(-only|-or-later|\+)$", ""))), lambda x: x.isNotNull())


def unit_scores(units: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct candidates (unit, text) -> (unit, licence, score) of the best template, where it reaches the threshold."""
    spark = units.sparkSession
    rows = [(i, *form) for i, form in enumerate(licence_forms.forms())]
    forms = spark.createDataFrame(rows, "form int, licence string, notice string, keys array<string>")
    tf = units.select("unit", F.explode(_terms(F.col("text"))).alias("term")).groupBy("unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    ttf = forms.select("form", "licence", F.size("keys").alias("n_keys"), "keys", F.explode(_terms(F.col("notice"))).alias("term"))
    ttf = ttf.groupBy("form", "licence", "n_keys", "term", F.array_contains("keys", F.col("term")).cast("int").alias("is_key")).agg(F.count(F.lit(1)).alias("tf"))
    df = tf.select("term").union(ttf.select("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = units.agg((F.count(F.lit(1)) + F.lit(len(rows))).alias("n"))
    idf = df.crossJoin(F.broadcast(total)).select("term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(idf, "term").select("unit", "term", (F.col("tf") * F.col("idf")).alias("w"))
    tw = ttf.join(idf, "term").select("form", "licence", "n_keys", "term", "is_key", (F.col("tf") * F.col("idf")).alias("tw"))
    norms = w.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    tnorms = tw.groupBy("form").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"))
    # Keys first: most candidates hold those of no form, and none of their other terms then meets a template.
    keyed = tf.select("unit", "term").join(F.broadcast(tw.where("is_key = 1").select("form", "n_keys", "term")), "term")
    pairs = keyed.groupBy("unit", "form", "n_keys").agg(F.count(F.lit(1)).alias("n")).where("n = n_keys")
    able = pairs.groupBy("unit").agg(F.collect_set("form").alias("able"))  # as many as there are forms at most
    held = w.join(able, "unit").join(F.broadcast(tw), "term").where(F.array_contains("able", F.col("form")))
    dots = held.groupBy("unit", "form", "licence").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norms, "unit").join(F.broadcast(tnorms), "form")
    scored = scored.select("unit", "licence", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 6).alias("score")).where(F.col("score") >= threshold)
    best = scored.groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("less"), "licence")).alias("best"))
    return best.select("unit", F.col("best.licence").alias("licence"), (-F.col("best.less")).alias("score"))


def _best() -> Column:
    return F.min(F.struct((F.col("licence") == RESERVED).alias("reserved"), (-F.col("score")).alias("less"), "licence")).alias("best")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """The directories above a path, the nearest first, ending with ''."""
    parts = F.split(directory(path), "/")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def licences(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, licence, score, origin): origin is own, inherited or none."""
    f = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spark, folder = f.sparkSession, storage.new_folder(f.sparkSession, "licences")
    # The texts are read once: what follows needs only the candidates with a cue, and those once each.
    marked = f.where(F.col("text").rlike(CUE))
    # A line with an SPDX identifier says no more than that, so the cosine doesn't see it.
    plain = candidates(F.regexp_replace("text", SPDX_LINE, ""))
    units = marked.select("doc_id", "path", F.transform(spdx_licences(F.col("text")), lambda x: F.struct(F.lit("").alias("text"), x.alias("spdx"))).alias("named"), F.transform(plain, lambda x: F.struct(x.alias("text"), F.lit("").alias("spdx"))).alias("plain"))
    units = units.select("doc_id", "path", F.explode(F.concat("named", "plain")).alias("u")).select("doc_id", "path", "u.*").withColumn("unit", F.md5(F.col("text").cast("binary")))
    lines = storage.write_table(units.where(F.col("text").rlike(CUE) | (F.col("spdx") != "")), f"{folder}/lines")
    distinct = storage.write_table(lines.where("spdx = ''").groupBy("unit").agg(F.first("text").alias("text")), f"{folder}/distinct")
    scores = unit_scores(distinct, threshold)
    named = lines.where("spdx <> ''").select("doc_id", "path", F.col("spdx").alias("licence"), F.lit(1.0).alias("score"))
    hits = lines.select("doc_id", "path", "unit").join(scores, "unit").select("doc_id", "path", "licence", "score").unionByName(named).groupBy("doc_id", "path").agg(_best())
    own = storage.write_table(hits.select("doc_id", "path", F.col("best.licence").alias("licence"), (-F.col("best.less")).alias("score")), f"{folder}/own")
    storage.release(spark)
    name = F.element_at(F.split("path", "/"), -1)
    rooted = own.where(name.rlike(LICENCE_FILE)).groupBy(directory(F.col("path")).alias("dir")).agg(_best())
    own = own.withColumnsRenamed({"doc_id": "own_id", "path": "own_path"})
    is_own = F.col("doc_id").eqNullSafe(F.col("own_id")) & F.col("path").eqNullSafe(F.col("own_path"))
    bare = f.select("doc_id", "path").join(own, is_own, "left_anti").where("path IS NOT NULL")
    up = bare.select("doc_id", "path", F.posexplode(ancestors(F.col("path"))).alias("far", "dir"))
    nearest = up.join(rooted, "dir").groupBy("doc_id", "path").agg(F.min(F.struct("far", F.col("best.licence").alias("licence"), (-F.col("best.less")).alias("score"))).alias("up"))
    taken = nearest.select(F.col("doc_id").alias("own_id"), F.col("path").alias("own_path"), "up.licence", "up.score", F.lit("inherited").alias("origin"))
    found = own.withColumn("origin", F.lit("own")).unionByName(taken)
    out = f.select("doc_id", "path").join(found, is_own, "left")
    return out.select("doc_id", "path", F.coalesce("licence", F.lit("")).alias("licence"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("origin", F.lit("none")).alias("origin"))


def document_path(doc_id: Column, source: Column) -> Column:
    """The tables have no paths; documents are laid out by source and id, every tenth being its directory's licence file."""
    name = F.when(doc_id % 10 == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("doc-"), doc_id.cast("string"), F.lit(".txt")))
    levels = [source, F.expr("cast(doc_id div 1000 as string)"), F.when(doc_id % 100 < 10, F.lit(None).cast("string")).otherwise(F.expr("cast(doc_id div 10 as string)"))]
    return F.concat_ws("/", *levels, name)
