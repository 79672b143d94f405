"""Filters, classifications and keys of single rows, and JSON fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def in_either(names: list[str], *columns: Column) -> Column:
    """Whether any of the columns, trimmed and lower-cased, is one of the names."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin(*names)
    return hit


def first_group(aliases: dict[str, list[str]], *columns: Column) -> Column:
    """The group whose aliases hold the first column that names any, else ''."""
    pairs = [F.lit(x) for group, names in aliases.items() for n in names for x in (n, group)]
    known = F.create_map(*pairs)
    return F.coalesce(*[F.element_at(known, F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))) for c in columns], F.lit(""))


def numeric_flag(x: Column) -> Column:
    """True for what reads as the number 1, false for anything else."""
    return F.coalesce(x.cast("string").try_cast("double") == 1.0, F.lit(False))


def numbered_slice(df: DataFrame, order: list[Column], start: int, limit: int) -> DataFrame:
    """Rows start to start + limit - 1 of the order, counted from 1; limit 0 takes all that follow. Sorted by Spark's own limit and offset, in parallel."""
    ordered = df.orderBy(*order).offset(max(start, 1) - 1)
    return ordered.limit(limit) if limit else ordered


def best_rank_within(ranks: Column, most: int) -> Column:
    """Whether the best of the ranks in a list like '3;17' is at most `most`."""
    return F.array_min(F.transform(F.split(ranks, ";"), lambda x: F.trim(x).try_cast("int"))) <= most


def classified(included: Column, excluded: Column) -> Column:
    return F.when(included, "included").when(excluded, "excluded").otherwise("unmapped")


def row_ids(df: DataFrame, id_col: str, order: str) -> DataFrame:
    """Blank ids become row_<order>; every member of a set of equal ids gets the suffix __row_<order>."""
    given = F.trim(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    at = F.col(order).cast("string")
    with_ids = df.withColumn("row_id", F.when(given == "", F.concat(F.lit("row_"), at)).otherwise(given))
    copies = F.count(F.lit(1)).over(Window.partitionBy("row_id"))
    return with_ids.withColumn("row_id", F.when(copies > 1, F.concat("row_id", F.lit("__row_"), at)).otherwise(F.col("row_id")))


def duplicate_marks(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Columns later, earlier, member: what keeping the first, keeping the last, and dropping all members would drop."""
    w = Window.partitionBy(*keys)
    nth, n = F.row_number().over(w.orderBy(order)), F.count(F.lit(1)).over(w)
    return df.withColumns({"later": nth > 1, "earlier": nth < n, "member": n > 1})


def parsed(text: Column, schema: T.StructType) -> Column:
    """The JSON in a text; a struct of nulls where it is none."""
    none = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    return F.coalesce(F.from_json(text, schema), none)


def rendered(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def compact(limits: dict[str, int]) -> list[Column]:
    """Columns cut to so many characters each."""
    return [F.substr(F.coalesce(F.col(c), F.lit("")), F.lit(1), F.lit(n)).alias(c) for c, n in limits.items()]


def joined(*columns: Column) -> Column:
    """Several texts as one, blanks left out, white space collapsed."""
    return F.trim(F.regexp_replace(F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), r"\s+", " "))


def post_id(x: Column) -> Column:
    """An id without the prefix of its kind."""
    return F.regexp_replace(F.trim(x), "^t[0-9]_", "")


def fixed_places(x: Column, places: int = 4) -> Column:
    return F.format_string(f"%.{places}f", x.cast("double"))


def inferred_tier(policy: Column, rank: Column, legacy: Column, large: int = 5) -> Column:
    """The tier that the policy names, else that of the rank, else the old one."""
    return F.when(policy.isin("large_top30", "rest_top10"), policy).when(rank <= large, "large_top30").when(rank.isNotNull(), "rest_top10").otherwise(F.coalesce(legacy, F.lit("")))
