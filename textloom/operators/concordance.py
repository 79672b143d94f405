"""Concordances of many terms: each text's first place of every term, in one pass, and a sample of each term's hits.

A term is a sequence of words; between its words, white space of any length counts as one space. A text is cut into words once,
and each word leads to the terms that begin with it. A task keeps the hits of each term that come first in the order of a
digest of seed, term and id, as many as the sample has; the sample of all is the same choice among the tasks' choices, so it
doesn't depend on how rows are dealt out, and a term that is in every text costs a task no more than another.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textloom.functions import scalars as S

_WORD = re.compile(r"\w+")


def _cut(term: str) -> tuple[str, list[tuple[str, str]]]:
    """The first word, and then what stands between words and each next word."""
    words = list(_WORD.finditer(term))
    if not words or words[0].start() or words[-1].end() != len(term):
        raise ValueError(f"a term begins and ends with a letter, digit or underscore: {term!r}")
    return words[0][0], [(re.sub(r"\s+", " ", term[a.end() : b.start()]), b[0]) for a, b in zip(words, words[1:])]


class Finder:
    def __init__(self, terms: list[str]):
        self.by_first: dict[str, list[tuple[str, list[tuple[str, str]]]]] = {}
        for term in terms:
            first, rest = _cut(term.lower())
            self.by_first.setdefault(first, []).append((term, rest))

    def first_hits(self, text: str) -> dict[str, tuple[int, int]]:
        """Term -> (start, end) of its first place; text in lower case."""
        found, words = {}, list(_WORD.finditer(text))
        for i, word in enumerate(words):
            for term, rest in self.by_first.get(word[0], ()):
                if term in found or i + len(rest) >= len(words):
                    continue
                for k, (between, nxt) in enumerate(rest):
                    a, b = words[i + k], words[i + k + 1]
                    if b[0] != nxt or re.sub(r"\s+", " ", text[a.end() : b.start()]) != between:
                        break
                else:
                    found[term] = (word.start(), words[i + len(rest)].end())
        return found


def concordances(docs: DataFrame, id_col: str, text_col: str, terms: list[str], per_term: int = 20, width: int = 120, seed: str = "0") -> DataFrame:
    """(term, rank, id, left, hit, right): of each term `per_term` of the texts that hold it, in the order of md5(seed#term#id), with `width` signs to both sides in the cleaned text.

    Rows with a null id are left out; of rows that share an id, each counts. Terms are matched whole, in any case; repeated terms once.
    """
    finder, kind, of_id = Finder(sorted(set(terms))), docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), S.normalise_for_tokens(F.col(text_col)).alias("text"))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list[tuple[int, int, tuple]]] = {}
        for batch in batches:
            for n, (i, text) in enumerate(zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                for term, (a, b) in finder.first_hits(text).items():
                    digest = hashlib.md5(f"{seed}#{term}#{i}".encode()).hexdigest()
                    kept, entry = best.setdefault(term, []), (-int(digest, 16), n)
                    if len(kept) < per_term or entry > kept[0][:2]:
                        row = (i, digest, text[max(0, a - width) : a], text[a:b], text[b : b + width])
                        (heapq.heappush if len(kept) < per_term else heapq.heapreplace)(kept, (*entry, row))
        out = [(term, *row) for term, kept in best.items() for _, _, row in kept]
        names = ["term", "id", "digest", "left", "hit", "right"]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, of_id if k == "id" else pa.string()) for k, c in zip(names, zip(*out), strict=True)], names)

    found = rows.mapInArrow(hits, f"term string, id {kind}, digest string, `left` string, hit string, `right` string")
    rank = F.row_number().over(Window.partitionBy("term").orderBy("digest", "id", "left", "right"))  # per_term rows from each task
    return found.withColumn("rank", rank).where(F.col("rank") <= per_term).select("term", "rank", F.col("id").alias(id_col), "left", "hit", "right")
