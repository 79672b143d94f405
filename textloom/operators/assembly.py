"""Assembly of inputs: keyword and master readers, validation sets, prediction runs, annotation templates, responses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators import contracts, evaluate, relational, rows, text
from textloom.operators.relational import md5_order


def _or_blank(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that df has, blank where it has none."""
    return next((F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names if c in df.columns), F.lit(""))


def keyword_rows(df: DataFrame) -> DataFrame:
    """occupation_keyword and query in both layouts: a file with only `keyword` uses it for what is missing. An empty file is an error."""
    if "keyword" not in df.columns:
        relational.require_columns(df, ["occupation_keyword", "query"])
    if df.isEmpty():
        raise ValueError("no keyword rows")
    # Without a query column the keyword stands for both, even where the other column is there.
    occupation = _or_blank(df, "keyword") if "query" not in df.columns else _or_blank(df, "occupation_keyword", "keyword")
    return df.withColumns({"query": _or_blank(df, "query", "keyword"), "occupation_keyword": occupation})


def master_rows(df: DataFrame, order: str) -> DataFrame:
    """Columns industry, comment_id, annotation_id, uk_status. order: the row's place, from 1.

    Blank ids become row_<place>; all members of a set of equal ids get the suffix __row_<place> in annotation_id.
    """
    given = _or_blank(df, "comment_id")
    ids = F.when(F.trim(given) == "", F.concat(F.lit("row_"), F.col(order).cast("string"))).otherwise(given)
    status = F.when(_or_blank(df, "uk_strong_relevant") == "1", "UK_strong").otherwise("non_UK_or_unclear")
    named = df.withColumns({"industry": _or_blank(df, "source_dataset", "industry_keyword"), "comment_id": ids, "uk_status": status})
    return rows.row_ids(named, "comment_id", order).withColumnRenamed("row_id", "annotation_id")


def boundary_input(df: DataFrame, id_col: str, text_col: str, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(texts of `least` characters and more, shorter ones); ids have to be there and unique."""
    relational.require_columns(df, [id_col, text_col])
    relational.assert_unique(df, [id_col])
    size = F.char_length(F.trim(F.coalesce(F.col(text_col), F.lit(""))))
    return df.where(size >= least), df.where(size < least)


def frequency_exports(docs: DataFrame, words: str, by: str, n: int = 1, least: int = 10, least_in_group: int = 3, k: int = 50) -> dict[str, DataFrame]:
    """Tables: pooled (df >= least), top (its k most frequent), grouped (df >= least_in_group within a group)."""
    pooled = text.frequency_table(docs, words, n, least)
    return {"pooled": pooled, "top": pooled.orderBy(F.desc("df"), "term").limit(k), "grouped": text.term_stats(docs, words, [by], n).where(F.col("df") >= least_in_group)}


def harmonised_gate(gate: Column, label: Column, positive: list[str]) -> Column:
    """The gate where it isn't blank, else yes or no by the label; blank where both are."""
    of_label = F.when(F.trim(label) == "", "").otherwise(F.when(F.lower(F.trim(label)).isin(positive), "yes").otherwise("no"))
    return F.coalesce(F.nullif(F.lower(F.trim(gate)), F.lit("")), of_label, F.lit(""))


def renumbered_sample(df: DataFrame, id_col: str, size: int, seed: str, prefix: str) -> DataFrame:
    """`size` rows by hashed id, in order of the id, with validation_id <prefix>_001 onwards."""
    taken = df.orderBy(md5_order(seed, id_col), id_col).limit(size)  # a top-k, size rows at most
    place = F.row_number().over(Window.partitionBy().orderBy(id_col))
    return taken.withColumn("validation_id", F.concat(F.lit(f"{prefix}_"), F.lpad(place.cast("string"), 3, "0")))


def validation_set(old: DataFrame, new: DataFrame, members: DataFrame, key: str, group: str, moved: str) -> tuple[DataFrame, DataFrame]:
    """(the set, displaced rows): old rows of other groups, old rows of `moved` that are members, and new ones, tagged in sample_source."""
    others, of_moved = old.where(F.col(group) != moved), old.where(F.col(group) == moved)
    ids = members.select(key).distinct()
    kept = of_moved.join(ids, key, "left_semi")
    tagged = [d.withColumn("sample_source", F.lit(s)) for d, s in ((others, "existing"), (kept, "overlap"), (new, "new"))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged), of_moved.join(ids, key, "left_anti")


def checked_sizes(df: DataFrame, key: str, group: str, size: int, per_group: dict[str, int]) -> DataFrame:
    """df, if it has `size` rows with as many keys and just these group sizes; else ValueError. One pass."""
    checks = {"rows": F.count(F.lit(1)) == size, "keys": F.count_distinct(key) == size, "groups": F.count_if(~F.col(group).isin([*per_group])) == 0}
    checks |= {f"group {g}": F.count_if(F.col(group) == g) == n for g, n in per_group.items()}
    failed = [r["name"] for r in contracts.named_checks(df, checks).where("NOT passed AND name <> 'ALL'").collect()]  # a row for each check
    if failed:
        raise ValueError(f"sizes differ: {failed}")
    return df


def field_evaluation(df: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Multi-class measures of each field {name: (truth, prediction)}, one row a field."""
    each = [evaluate.multiclass(evaluate.confusion(df, t, p)).withColumn("field", F.lit(f)) for f, (t, p) in fields.items()]
    return reduce(DataFrame.unionByName, each)


def combined_runs(runs: list[DataFrame], key: str, values: list[str], wanted: DataFrame, codebook: dict[str, list[str]], prefix: str) -> DataFrame:
    """The runs' rows of the wanted keys, later runs first among repeats, with columns prefixed.

    ValueError where repeats conflict, a wanted key is missing, or a value is not in its codebook (blank or null never is).
    """
    tagged = [r.select(key, *values).withColumn("_run", F.lit(i)) for i, r in enumerate(runs)]
    rows_ = reduce(DataFrame.unionByName, tagged).join(wanted.select(key).distinct(), key, "left_semi")
    clash = contracts.conflicting(rows_, [key], values)
    if not clash.isEmpty():
        raise ValueError(f"conflicting predictions: {[r[key] for r in clash.limit(5).collect()]}")
    one = contracts.first_by(rows_, [key], [F.desc("_run")]).select(key, *values)
    missing = wanted.select(key).distinct().join(one, key, "left_anti")
    if not missing.isEmpty():
        raise ValueError(f"missing predictions: {[r[key] for r in missing.limit(5).collect()]}")
    for field, allowed in codebook.items():
        if not one.where(F.col(field).isNull() | (F.col(field) == "") | ~F.col(field).isin(allowed)).isEmpty():
            raise ValueError(f"labels outside the codebook: {field}")
    return one.select(key, *[F.col(v).alias(f"{prefix}_{v}") for v in values])


def with_metadata(df: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """df with the columns of metadata, a row a key at most; blank where a key has none."""
    relational.assert_unique(metadata, [key])
    added = [c for c in metadata.columns if c != key]
    joined = df.drop(*added).join(metadata, key, "left")  # small metadata is broadcast by its measured size
    return joined.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in added})


_COUNTS = ("input_tokens", "output_tokens", "total_tokens")
_CONTENT = T.ArrayType(T.StructType([T.StructField("text", T.StringType())]))
RESPONSE = T.StructType(
    [
        T.StructField("output_text", T.StringType()),
        T.StructField("output", T.ArrayType(T.StructType([T.StructField("content", _CONTENT)]))),
        T.StructField("usage", T.StructType([T.StructField(c, T.LongType()) for c in _COUNTS])),
    ]
)


def response_text(response: Column) -> Column:
    """The output text of a parsed response, else its contents' texts that aren't empty, one a line."""
    parts = F.flatten(F.transform(F.coalesce(response["output"], F.array()), lambda o: F.coalesce(o["content"], F.array())))
    texts = F.filter(F.transform(parts, lambda c: c["text"]), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.coalesce(F.nullif(response["output_text"], F.lit("")), F.array_join(texts, "\n"), F.lit(""))


def response_usage(response: Column) -> dict[str, Column]:
    """Token counts as text, blank where the response has none."""
    return {c: F.coalesce(response["usage"][c].cast("string"), F.lit("")) for c in _COUNTS}


def topic_sources(tables: dict[str, DataFrame], pooled: DataFrame) -> DataFrame:
    """(industry, topic, n, share): each industry's topics without outliers, then the pooled ones as 'pooled'."""
    def shares(t: DataFrame) -> DataFrame:
        c = t.where("topic <> -1").groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
        return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row a topic

    return relational.union_tagged({**{k: shares(t) for k, t in tables.items()}, "pooled": shares(pooled)}, "industry")


def annotation_template(df: DataFrame, kept: list[str], blank: list[str]) -> DataFrame:
    """The kept columns as text, missing ones blank, then blank columns to fill in."""
    return df.select(*[_or_blank(df, c).alias(c) for c in kept], *[F.lit("").alias(c) for c in blank])
