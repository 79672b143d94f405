"""The cleaning of texts for tokens, step by step, against Python's own regular expressions."""

import html
import random
import re

from pyspark.sql import functions as F

from textloom.functions import scalars as S

PIECES = ["R/Foo_1", "(r/foo)", "x-u/bar", "u/me", "/r/foo", " r/a", "\tU/B", "HTTPS://A.b/c?d", "www.x.y", "WWW.Z", "xwww.q", "&amp;", "&AMP", "&amp;lt;", "&eacute;", "&notaname;", "&#39;", "&#x27;s", "&nbsp;r/x", "&&&", "& b;", "&é;", "&copy1;"]
PIECES += ["can't", "CAN’T", "won't", "don‘t", "isn't", "n't", "“q”", " ", "\n", " ", "\x1c", "word", "É", "1a", "'", "-", "http://", "https:/x"]


def by_hand(text):
    t = html.unescape(text or "")
    for curly, straight in (("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"')):
        t = t.replace(curly, straight)
    t = re.compile(r"https?://\S+|www\.\S+", re.I).sub(" ", t)
    t = re.compile(r"(?:^|\s)[ru]/[A-Za-z0-9_]+", re.I).sub(" ", t)
    t = re.sub(r"&\w+;", " ", t).lower()
    return t.replace("can't", "cannot").replace("won't", "will not").replace("n't", " not")


def test_steps(spark):
    r = random.Random(8)
    texts = [None, "", *PIECES] + ["".join(r.choice(PIECES) + r.choice(["", " "]) for _ in range(r.randint(1, 8))) for _ in range(800)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    got = {x.i: (x.n, x.k) for x in df.select("i", S.normalise_for_tokens(F.col("t")).alias("n"), S.tokens(F.col("t")).alias("k")).collect()}
    for i, t in enumerate(texts):
        assert got[i][0] == by_hand(t), (t, got[i][0], by_hand(t))
        assert got[i][1] == re.findall("[a-z0-9]+(?:'[a-z]+)?", by_hand(t))
