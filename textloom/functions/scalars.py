"""Column expressions: cleaning, tokens, labels, lenient numbers and small statistics."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Function words that carry no topic.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")
#: The survey's SF-5: the reference's fallback list, which holds none of its negations, and its forum terms.
SF5_STOP_WORDS = tuple(
    """
    a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down
    during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more
    most my myself of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them
    themselves then there these they this those through to too under until up very was we were what when where which while who whom why with you
    your yours yourself yourselves
    im ive id youre theyre thats theres reddit comment post people thing things way lot really like
    """.split()
)
TOKEN = "[a-z0-9]+(?:'[a-z]+)?"
Z95 = 1.96


def strip(x: Column) -> Column:
    """Without white space at both ends, Unicode's too; null counts as ''."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", "")


def clean_text(x: Column, drop_urls: bool = True) -> Column:
    """White space collapsed, links dropped on request."""
    out = F.coalesce(x, F.lit(""))
    if drop_urls:
        out = F.regexp_replace(out, r"https?://\S+", " ")
    return F.trim(F.regexp_replace(out, r"[ \t\n\x0b\f\r]+", " "))


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescaped(x: Column) -> Column:
    """HTML character references resolved, all of the standard's names among them. Only texts that may hold one leave the JVM."""
    return F.coalesce(_unescape(F.when(x.rlike("&[#A-Za-z]"), x)), x)


def normalise_for_tokens(x: Column) -> Column:
    """In this order: references resolved, curly quotes made straight, links, mentions and references that are left dropped, lower case, contractions written out.

    A mention is r/ or u/ and a name, after white space or at the start, in either case. Null counts as ''.
    """
    space = r"\s\x1C-\x1F"
    out = F.translate(unescaped(F.coalesce(x, F.lit(""))), "‘’“”", "''\"\"")
    out = F.regexp_replace(out, rf"(?iuU)https?://[^{space}]+|www\.[^{space}]+", " ")
    out = F.regexp_replace(out, rf"(?iuU)(?:^|[{space}])[ru]/[A-Za-z0-9_]+", " ")
    out = F.lower(F.regexp_replace(out, r"(?U)&\w+;", " "))
    for short, full in (("can't", "cannot"), ("won't", "will not"), ("n't", " not")):
        out = F.replace(out, F.lit(short), F.lit(full))
    return out


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(normalise_for_tokens(x), F.lit(TOKEN), F.lit(0))


def content_tokens(x: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    return F.filter(tokens(x), lambda t: (F.length(t) > 1) & ~t.isin(*stop_words))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words joined by a space; none if there are fewer."""
    if n == 1:
        return words
    places = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
    return F.when(F.size(words) >= n, F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def truncate(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.rtrim(F.substring(x, 1, most - 3)), F.lit("..."))).otherwise(x)


def slug(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z0-9_]+", "_"), "^_+|_+$", ""))


def community_name(x: Column) -> Column:
    """'https://host/r/Name/', '/r/Name' or 'r/Name' -> 'Name'."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r"^(?:https?://[^/]+)?/?[rR]/", ""), "/.*$", "")


def split_values(x: Column, sep: str = ";") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), sep), lambda v: F.trim(v)), lambda v: v != "")


def as_int(x: Column, default: int = 0) -> Column:
    """int(float(text)), or the default where that fails."""
    return F.coalesce(F.trim(x.cast("string")).try_cast("double").try_cast("bigint"), F.lit(default))


def label(x: Column) -> Column:
    """Lower case, trimmed; null and the words for it are ''."""
    out = F.lower(F.trim(F.coalesce(x.cast("string"), F.lit(""))))
    return F.when(out.isin("nan", "none", "null"), "").otherwise(out)


def yes_no(x: Column) -> Column:
    out = label(x)
    return F.when(out.isin("yes", "1", "true", "y", "1.0"), "yes").when(out.isin("no", "0", "false", "n", "0.0"), "no").otherwise("")


def gate_from_label(x: Column, negative: tuple[str, ...], unclear_is_yes: bool = False) -> Column:
    """yes for a positive class, no for a negative one; '' stays ''."""
    out = label(x)
    unclear = F.lit("yes" if unclear_is_yes else "no")
    return F.when(out == "", "").when(out == "unclear", unclear).when(out.isin(*negative), "no").otherwise("yes")


def month_of_epoch(seconds: Column) -> Column:
    """YYYY-MM in UTC; '' for 0 and for what isn't a number."""
    n = as_int(seconds)
    return F.when(n > 0, F.date_format(F.timestamp_seconds(n), "yyyy-MM")).otherwise("")


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The Wilson interval; null where n is 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    below = 1 + z * z / n
    return (mid - half) / below, (mid + half) / below


def wald(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    half = z * F.sqrt(p * (1 - p) / n)
    return F.greatest(F.lit(0.0), p - half), F.least(F.lit(1.0), p + half)


def g2(a: Column, b: Column, n1: Column, n2: Column) -> Column:
    """Log-likelihood of a of n1 against b of n2."""
    total = (n1 + n2).cast("double")
    cells = [(a, n1, a + b), (b, n2, a + b), (n1 - a, n1, n1 + n2 - a - b), (n2 - b, n2, n1 + n2 - a - b)]
    terms = []
    for seen, row, col in cells:
        expected = row * col / F.nullif(total, F.lit(0.0))
        terms.append(F.when((seen > 0) & (expected > 0), seen * F.ln(seen / expected)).otherwise(0.0))
    return 2 * reduce(lambda x, y: x + y, terms)


def log2_or_null(x: Column) -> Column:
    return F.when(x > 0, F.log2(x))


def pattern_hits(x: Column, patterns: dict[str, str]) -> Column:
    """The names of the patterns that match, in order."""
    return F.filter(F.array(*[F.when(x.rlike(p), F.lit(name)) for name, p in patterns.items()]), lambda v: v.isNotNull())
