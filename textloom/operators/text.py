"""Term statistics, keyness, collocations and concordances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import scalars as S


def term_stats(docs: DataFrame, words: str, by: list[str], n: int = 1) -> DataFrame:
    """(by..., term, f, df): occurrences, and documents that hold the term. One row a document; words is an array."""
    # The inner explode would filter by the size of the array first, and so cut each text into words twice.
    # Documents are dealt before their terms arise: what moves is the words, and a document's terms are counted where they are.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(*by, "doc_id", F.col(words).alias("_words")).repartition(parts, "doc_id")
    grams = dealt.select(*by, "doc_id", F.explode_outer(S.ngrams(F.col("_words"), n)).alias("term")).where("term IS NOT NULL")
    per_doc = grams.groupBy(*by, "doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy(*by, "term").agg(F.sum("n").alias("f"), F.count(F.lit(1)).alias("df"))


def frequency_table(docs: DataFrame, words: str, n: int, min_df: int) -> DataFrame:
    """(term, f, df, prevalence) of the terms in at least min_df documents; documents without an n-gram count too."""
    total = docs.agg(F.count(F.lit(1)).alias("docs"))
    return term_stats(docs, words, [], n).where(F.col("df") >= min_df).crossJoin(F.broadcast(total)).select("term", "f", "df", (F.col("df") / F.col("docs")).alias("prevalence"))


def keyness_of_counts(counts: DataFrame, totals: DataFrame, min_total: int, min_group: int) -> DataFrame:
    """counts (term, yp, yn, dp, dn) and one row of totals (np, nn, vocab, docs_p, docs_n) -> weighted log-odds and G2.

    The prior of a term is its count in both groups plus 0.01, that of all terms their sum plus the vocabulary's size.
    """
    t = counts.crossJoin(F.broadcast(totals)).where((F.col("dp") + F.col("dn") >= min_total) & (F.greatest("dp", "dn") >= min_group))
    yp, yn = F.col("yp").cast("double"), F.col("yn").cast("double")
    alpha, prior = yp + yn + 0.01, (F.col("np") + F.col("nn") + F.col("vocab")).cast("double")
    logit = lambda y, n: F.ln((y + alpha) / (n + prior - y - alpha))
    delta = logit(yp, F.col("np")) - logit(yn, F.col("nn"))
    z = delta / F.sqrt(1 / (yp + alpha) + 1 / (yn + alpha))
    return t.select("term", "yp", "yn", "dp", "dn", z.alias("z"), S.g2(F.col("dp"), F.col("dn"), F.col("docs_p"), F.col("docs_n")).alias("g2"))


def keyness(docs: DataFrame, words: str, gate: str, n: int = 1, min_total: int = 10, min_group: int = 5) -> DataFrame:
    """Which terms tell documents with gate 'yes' from those with 'no'."""
    s = term_stats(docs, words, [gate], n)
    pick = lambda col, side: F.sum(F.when(F.col(gate) == side, F.col(col)).otherwise(0))
    counts = s.groupBy("term").agg(pick("f", "yes").alias("yp"), pick("f", "no").alias("yn"), pick("df", "yes").alias("dp"), pick("df", "no").alias("dn"))
    # dp and dn, never null, keep all columns in this branch too, so that both read one shuffle.
    sums = counts.agg(F.sum("yp").alias("np"), F.sum("yn").alias("nn"), F.count(F.col("dp") + F.col("dn")).alias("vocab"))
    sizes = docs.agg(F.sum((F.col(gate) == "yes").cast("long")).alias("docs_p"), F.sum((F.col(gate) == "no").cast("long")).alias("docs_n"))
    return keyness_of_counts(counts, sums.crossJoin(sizes), min_total, min_group)


def keyness_one_vs_rest(docs: DataFrame, words: str, by: str, min_total: int = 5, min_group: int = 3) -> DataFrame:
    """Keyness of every group against all others, from one count: the rest is the total less the group."""
    s = term_stats(docs, words, [by])
    term = Window.partitionBy("term")
    s = s.withColumns({"all_f": F.sum("f").over(term), "all_df": F.sum("df").over(term)})
    per = s.groupBy(by).agg(F.sum("f").alias("np"))
    sizes = docs.groupBy(by).agg(F.count(F.lit(1)).alias("docs_p"))
    whole = s.groupBy("term").agg(F.sum("f").alias("f")).agg(F.sum("f").alias("all_n"), F.count(F.lit(1)).alias("vocab"))
    docs_all = docs.agg(F.count(F.lit(1)).alias("docs_all"))
    joined = s.join(F.broadcast(per), by).join(F.broadcast(sizes), by).crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(docs_all))
    yp, yn = F.col("f").cast("double"), (F.col("all_f") - F.col("f")).cast("double")
    dp, dn = F.col("df"), F.col("all_df") - F.col("df")
    alpha, prior = yp + yn + 0.01, (F.col("all_n") + F.col("vocab")).cast("double")
    logit = lambda y, n: F.ln((y + alpha) / (n + prior - y - alpha))
    delta = logit(yp, F.col("np")) - logit(yn, F.col("all_n") - F.col("np"))
    out = joined.where((dp + dn >= min_total) & (F.greatest(dp, dn) >= min_group))
    return out.select(F.col(by), "term", F.col("f").alias("yp"), (F.col("all_f") - F.col("f")).alias("yn"), (delta / F.sqrt(1 / (yp + alpha) + 1 / (yn + alpha))).alias("z"), S.g2(dp, dn, F.col("docs_p"), F.col("docs_all") - F.col("docs_p")).alias("g2"))


def top_terms(keyed: DataFrame, k: int, descending: bool = True) -> DataFrame:
    return keyed.orderBy(F.desc("z") if descending else F.asc("z"), "term").limit(k)


def keyword_candidates(docs: DataFrame, words: str, gate: str, each: int = 20, most: int = 30, min_df: int = 10) -> DataFrame:
    """(term, pos): the `each` terms of highest keyness, then the `each` most frequent in documents with gate 'yes', without repeats, at most `most`."""
    numbered = lambda df, after, *order: df.select("term", (F.row_number().over(Window.orderBy(*order)) + after).alias("pos"))  # noqa: E731  of `each` rows
    keyed = numbered(top_terms(keyness(docs, words, gate), each), 0, F.desc("z"), "term")
    order = F.desc("df"), F.desc("f"), F.col("term")
    common = frequency_table(docs.where(F.col(gate) == "yes"), words, 1, min_df).orderBy(*order).limit(each)
    both = keyed.unionByName(numbered(common, each, *order)).groupBy("term").agg(F.min("pos").alias("pos"))
    return both.orderBy("pos").limit(most)


def keyness_diagnostic(docs: DataFrame, words: str, gate: str, by: str, terms: DataFrame) -> DataFrame:
    """For each term: in how many groups it leans to 'yes', the largest group's share of its positive documents, and a verdict."""
    s = term_stats(docs, words, [by, gate]).join(F.broadcast(terms.select("term")), "term")
    pick = lambda side: F.sum(F.when(F.col(gate) == side, F.col("df")).otherwise(0))
    cells = s.groupBy("term", by).agg(pick("yes").alias("dp"), pick("no").alias("dn"))
    sizes = docs.groupBy(by).agg(F.sum((F.col(gate) == "yes").cast("long")).alias("n_p"), F.sum((F.col(gate) == "no").cast("long")).alias("n_n"))
    leans = (F.col("dp") > 0) & (S.ratio(F.col("dp"), F.col("n_p")) >= S.ratio(F.col("dn"), F.col("n_n")))
    per = cells.join(F.broadcast(sizes), by).groupBy("term").agg(F.sum(leans.cast("long")).alias("directions"), F.sum("dp").alias("pos_df"), F.max("dp").alias("most"))
    share = S.ratio(F.col("most"), F.col("pos_df"))
    verdict = F.when((share >= 0.6) | (F.col("directions") <= 1), "concentrated").when(F.col("directions") == 2, "partial").otherwise("broad")
    return per.select("term", "directions", "pos_df", share.alias("dominant_share"), verdict.alias("verdict"))


def threshold_jaccard(docs: DataFrame, words: str, gate: str, thresholds: list[int], k: int) -> DataFrame:
    """How far the top k terms at each threshold overlap with those at the first one. Terms are counted once."""
    keyed = keyness(docs, words, gate, 1, min(thresholds), max(3, min(thresholds) // 2))
    bound = len(thresholds) * k
    order = Window.partitionBy("threshold").orderBy(F.desc("z"), "term")
    # The terms of each threshold, k at most, from one count.
    levels = F.array(*[F.when((F.col("dp") + F.col("dn") >= t) & (F.greatest("dp", "dn") >= max(3, t // 2)), F.lit(t)) for t in thresholds])
    tops = keyed.select("term", "z", F.explode(F.filter(levels, lambda t: t.isNotNull())).alias("threshold")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    tops = tops.select("threshold", "term").limit(bound)
    sets = tops.groupBy("threshold").agg(F.collect_set("term").alias("terms"))
    first = sets.where(F.col("threshold") == thresholds[0]).select(F.col("terms").alias("base"))
    both = sets.join(F.broadcast(first), F.lit(True))  # one row
    return both.select("threshold", S.ratio(F.size(F.array_intersect("terms", "base")), F.size(F.array_union("terms", "base"))).alias("jaccard"))


def collocations(docs: DataFrame, words: str, keywords: DataFrame, window: int = 5, min_df: int = 5, most: int = 50) -> DataFrame:
    """(keyword, collocate, pairs, df, log_dice) in a window of words on both sides, the `most` most frequent of each keyword.

    Each place that holds a keyword looks at its neighbours in the document's own array, so that no places are joined and no others looked at.
    """
    w, keys = F.col(words), F.col("_keys")
    places = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(keys, x), i)), lambda i: i.isNotNull())
    around = lambda i: F.filter(F.sequence(F.greatest(i - window, F.lit(0)), F.least(i + window, F.size(w) - 1)), lambda j: F.get(w, i) != F.get(w, j))
    near = F.flatten(F.transform(places, lambda i: F.transform(around(i), lambda j: F.struct(F.get(w, i).alias("keyword"), F.get(w, j).alias("collocate")))))
    held = docs.select("doc_id", words).crossJoin(F.broadcast(keywords.agg(F.collect_set("term").alias("_keys"))))  # a few dozen terms
    # The inner explode would filter by the size of the array first, and so find all pairs twice.
    pairs = held.select("doc_id", F.explode_outer(near).alias("p")).where("p IS NOT NULL").select("doc_id", "p.*")
    per_doc = pairs.groupBy("keyword", "collocate", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    counted = per_doc.groupBy("keyword", "collocate").agg(F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("pairs"), "collocate"))
    top = counted.withColumn("rank", rank).where((F.col("rank") <= most) & (F.col("df") >= min_df))
    f = docs.select(F.explode_outer(w).alias("t")).where("t IS NOT NULL").groupBy("t").agg(F.count(F.lit(1)).alias("f"))
    a, b = f.select(F.col("t").alias("keyword"), F.col("f").alias("f_k")), f.select(F.col("t").alias("collocate"), F.col("f").alias("f_c"))
    joined = top.join(a, "keyword").join(b, "collocate")
    return joined.select("keyword", "collocate", "pairs", "df", (14 + F.log2(2 * F.col("pairs") / (F.col("f_k") + F.col("f_c")))).alias("log_dice"))


def kwic(docs: DataFrame, text: str, pattern: str, width: int = 120) -> DataFrame:
    """(doc_id, left, hit, right): the first hit of the pattern in each cleaned text."""
    c = S.clean_text(F.col(text))
    at = F.regexp_instr(c, F.lit(pattern))
    hit = F.regexp_extract(c, pattern, 0)
    left = F.substr(c, F.greatest(at - width, F.lit(1)), F.least(at - 1, F.lit(width)))
    return docs.where(c.rlike(pattern)).select("doc_id", left.alias("left"), hit.alias("hit"), F.substr(c, at + F.length(hit), F.lit(width)).alias("right"))


def repeated_texts(docs: DataFrame, text: str, by: str) -> DataFrame:
    """Normalised texts that occur more than once: their digest, copies, and groups in order."""
    norm = F.lower(S.clean_text(F.col(text)))
    rows = docs.select(F.md5(norm.cast("binary")).alias("text_md5"), by).where(F.length(norm) > 0)
    groups = F.array_join(F.array_sort(F.collect_set(by)), ";")
    return rows.groupBy("text_md5").agg(F.count(F.lit(1)).alias("copies"), groups.alias("groups")).where("copies > 1")


def context(turns: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """Adds the previous and next text of the same thread, '' at its ends."""
    w = Window.partitionBy(*by).orderBy(order)
    return turns.withColumns({"previous": F.coalesce(F.lag(text).over(w), F.lit("")), "next": F.coalesce(F.lead(text).over(w), F.lit(""))})


def hinted(col: Column, patterns: dict[str, str]) -> tuple[Column, Column]:
    """How many patterns match, and their names joined by ';'."""
    hits = S.pattern_hits(col, patterns)
    return F.size(hits), F.array_join(hits, ";")


def evidence_table(keyed: DataFrame, pairs: DataFrame, most: int = 100, near: int = 8) -> DataFrame:
    """The `most` strongest terms by z over all lengths (term, n, dp, dn, z), with their `near` best collocates, and blank columns for the reader."""
    top = keyed.orderBy(F.desc("z"), "term").limit(most)
    nth = F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("log_dice"), "collocate"))
    best = pairs.join(F.broadcast(top.select(F.col("term").alias("keyword"))), "keyword", "left_semi").withColumn("r", nth).where(F.col("r") <= near)  # `most` terms
    listed = best.groupBy("keyword").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "collocate"))), lambda s: s["collocate"]), "; ").alias("collocates"))
    out = top.join(listed, F.col("term") == F.col("keyword"), "left")
    return out.select("term", "n", "dp", "dn", "z", F.coalesce("collocates", F.lit("")).alias("collocates"), *[F.lit("").alias(c) for c in ("category", "include", "note")])
