"""Spelling variants: words within one edit of each other, found by an even-partition pigeonhole join.

A word of l code points is indexed by two segments, its first l // 2 code points and the rest. One edit leaves
one of the two untouched, and it is known where: a word of equal length has the first segment at its
beginning or the second at its end, at the same place; a word that is one longer has the first at its
beginning or the second at its end, moved by one. Words that share a segment alone are many, and grow with
the square of the vocabulary (110 million pairs of equal length in 375,000 words). So the segment that the
edit is in is halved by the same rule, and one of its halves must be found as well, again at its
place or moved by one: an entry of the index is a word without one of four pieces, a probe the same of a word
of that length, or of one longer without a piece that is one longer. Each word makes four entries and
eight probes; candidates come from an equality join on (length, number of the piece, what is left).

Two words can agree in several entries only where one is longer, and then in neighbouring ones; the pair is
taken from the first alone. The pieces left out are verified to differ by exactly one edit, inside the join.

Words are counted by one pass over the texts that adds up within each task, so that frequent words reach
the shuffle once a task. The words' table is written to the shared folder; the join reads it twice.
What the edit's piece is taken out of is held by few words, and nothing is gathered for a key; pairs
that aren't near are dropped inside the join. All tables of words grow with the vocabulary, so none is broadcast, however few bytes its
file takes: their joins are by merging, and each round of `roots` is written, not planned anew inside the next.

Defined results: a null text has no words, nor has an empty one; a null id counts as the text '' in a word's
hash. Repeated rows count each time. Of near words with equally large n the first in code-point order is
the form. An empty table gives an empty table. Columns that aren't named in the parameters are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

LEAST_LENGTH, LEAST_TIMES, TIMES_MORE, SPOILT = 7, 2, 10, 31
#: Distinct words that a task counts before it passes them on.
_HELD = 1 << 18
#: Of Latin-1, the letters A-Z and a-z, these as small ones, and U+00C0 to U+00FF; all else parts words.
_letters = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))


def words_of(doc_id: str, text: str) -> Counter[bytes]:
    """The words of one text, in Latin-1, and how often each stands there. Code points above U+00FF part words, like other signs."""
    seed, out = zlib.crc32(doc_id.encode() + b":"), Counter()
    for run, times in Counter(text.encode("latin-1", "replace").translate(_letters).split()).items():
        n = len(run)
        if n < LEAST_LENGTH:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
        if h % SPOILT == 0:
            if n == LEAST_LENGTH:
                continue
            at = h % n
            run = run[:at] + run[at + 1 :]
        out[run] += times
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def passed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if text:
                for word, times in words_of(doc_id or "", text).items():
                    held[word] += times
                if len(held) > _HELD:
                    yield passed()
                    held.clear()
    if held:
        yield passed()


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): every distinct word that stands in all texts LEAST_TIMES times or more."""
    narrow = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TIMES)


def _pieces(length: Column) -> list[tuple[Column, Column]]:
    """Beginning and end of the four pieces of a word of this length: both halves, halved."""
    half = F.floor(length / 2)
    cuts = [F.lit(0), F.floor(half / 2), half, half + F.floor((length - half) / 2), length]
    return [(a.cast("int"), b.cast("int")) for a, b in zip(cuts, cuts[1:], strict=False)]


def _entries(size: Column, more: int) -> list[Column]:
    """For each piece of a word of `size`: a word that is `more` longer, without the piece, a bar in its place, and the piece."""
    word, out = F.col("word"), []
    for number, (start, end) in enumerate(_pieces(size)):
        rest = F.concat(F.substring(word, F.lit(1), start), F.lit("|"), F.substring(word, end + more + 1, F.char_length(word)))
        out.append(F.struct(size.alias("size"), F.lit(number).alias("number"), rest.alias("rest"), F.substring(word, start + 1, end - start + more).alias("piece")))
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """(short, n_short, long, n_long): each two words one edit apart, once; of equal length, the smaller one as short."""
    length = F.char_length("word")
    index = words.select(F.col("n").alias("n_short"), F.inline(F.array(*_entries(length, 0)))).withColumnRenamed("piece", "of_short")
    probes = words.select(F.col("n").alias("n_long"), F.inline(F.array(*_entries(length, 0), *_entries(length - 1, 1)))).withColumnRenamed("piece", "of_long")
    more = F.char_length("of_long") - F.char_length("of_short")
    # With an equal piece one place on, the pair is also found without the piece before this one.
    first = (F.col("number") == 0) | (F.substring("of_long", F.lit(2), F.char_length("of_short")) != F.col("of_short"))
    near = F.when(more == 0, F.col("of_short") < F.col("of_long")).otherwise(first) & (F.levenshtein("of_short", "of_long", 1) == 1)
    whole = lambda piece: F.replace(F.col("rest"), F.lit("|"), F.col(piece))
    return index.hint("merge").join(probes, ["size", "number", "rest"]).where(near).select(whole("of_short").alias("short"), "n_short", whole("of_long").alias("long"), "n_long")


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, form) -> (word, root). Each step multiplies n by TIMES_MORE, so `most`, the largest n, bounds their number; each round doubles what a root spans."""
    steps = max(1, math.ceil(math.log(max(most, 2) / LEAST_TIMES, TIMES_MORE)))
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        onward = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        out = storage.materialise(out.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return out


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each word: word, n, n_near, form (its near word of largest n, if that is TIMES_MORE times its own or more), form_n, root (the last of its forms, else itself)."""
    words = storage.materialise(count_words(docs, id_col, text_col), "spelling-words")
    most = words.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    pairs = near_pairs(words)
    ways = F.array(
        F.struct(F.col("short").alias("word"), F.col("n_short").alias("n"), F.struct((-F.col("n_long")).alias("less"), F.col("long").alias("near")).alias("other")),
        F.struct(F.col("long").alias("word"), F.col("n_long").alias("n"), F.struct((-F.col("n_short")).alias("less"), F.col("short").alias("near")).alias("other")),
    )
    best = pairs.select(F.inline(ways)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("best"), F.first("n").alias("own"))
    enough = -F.col("best.less") >= TIMES_MORE * F.col("own")
    near = storage.materialise(best.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "spelling-near")
    last = roots(near.where("form IS NOT NULL"), most)
    out = words.join(near.hint("merge"), "word", "left").join(last.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
