"""Byte-level BPE in linear time: longest matches, backtracking and adjacent-token compatibility.

Bytes are mapped to Latin-1 letters, so that one Aho-Corasick automaton finds, for every place of a
word, the longest token that starts there. Tokens are taken greedily; a token stays only if it is
compatible with the one before it, that is, if merging both from their bytes would give exactly these
two. Where no token fits, the last one is given up for a shorter one, and a place that has failed is
never tried again. Compatibility is decided by undoing merges on both sides of the border and is
memoised. The result is exactly what applying the merges by rank gives.

Defined results: a null text is empty and has no tokens. Special tokens are ordinary text. Words and
texts of any length take time in proportion to their length. Repeated rows stay repeated, an empty
table gives an empty table, and other columns are left out.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import load_ranks

#: Bounds of the memos: words held, the longest that is held, pairs of tokens held; characters of text taken together.
MEMO_WORDS = 300_000
MEMO_CHARS = 40
_PAIRS_HELD = 1 << 19
GROUP_CHARS = 2_000_000
_BETWEEN = "\u0100"


class BytePairEncoder:
    """Encodes and decodes with the ranks of one vocabulary; every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self._merged: dict[tuple[int, int], int] = {}  # the pair of tokens that a token is merged from -> token
        self._halves: dict[int, tuple[int, int]] = {}
        self._shorter: dict[int, int] = {}  # the next shorter token that a token starts with
        self._fits: dict[int, bool] = {}
        self._words: dict[str, bytes] = {}
        self._lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self._lengths[list(self.length)] = list(self.length.values())
        self._length_list = self._lengths.tolist()
        self._learn()
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            if i in self._halves:
                self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()

    def _learn(self) -> None:
        """Finds, in order of rank, the pair that each token is merged from. A token that merging its own bytes never gives has none and is only ever a whole word."""
        for token, i in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self._halves[i] = (i, i)
                continue
            for cut in range(len(token) - 1, 0, -1):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None and left in self._halves and right in self._halves and (len(token[:cut]) == 1 or left < i) and (len(token[cut:]) == 1 or right < i) and self._compatible(left, right):
                    self._merged[left, right], self._halves[i] = i, (left, right)
                    break
        self._fits.clear()
        for token, i in self.ranks.items():
            for cut in range(len(token) - 1, 0, -1):
                if (j := self.ranks.get(token[:cut])) is not None and j in self._halves:
                    self._shorter[i] = j
                    break

    def _order(self, token: int) -> int:
        """Single bytes come before every merge, whatever their ids."""
        return -1 if self.length[token] == 1 else token

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens together gives exactly these two."""
        limit = float("inf")
        while True:
            merged = self._merged.get((left, right))
            if merged is not None and merged < limit:
                return False
            a, b = self._order(left), self._order(right)
            if a < 0 and b < 0:
                return True
            if a > b:  # the left token was merged last: step back to before that
                limit, left = left, self._halves[left][1]
            else:  # a merge of equal rank further left comes first
                limit, right = right + 1, self._halves[right][0]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= _PAIRS_HELD:
                self._fits.clear()
            known = self._fits[key] = self._compatible(left, right)
        return known

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of each word; one pass of the automaton goes over all words, which a letter outside Latin-1 keeps apart."""
        joined = _BETWEEN.join([w.decode("latin-1") for w in words])
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        longest = np.full(len(joined) + 1, -1, np.int64)
        longest[found[:, 0] - self._lengths[found[:, 1]] + 1] = found[:, 1]  # of tokens with one start, the longest ends last, and stays
        longest, length, ranks, fits = longest.tolist(), self._length_list, self.ranks, self._fits
        out, start = [], 0
        for word in words:
            stop = start + len(word)
            whole = ranks.get(word)
            if whole is not None:
                out.append([whole])
            else:
                tokens, at, last = [], start, -1
                while at < stop:
                    token = longest[at]
                    if last >= 0 and not (fits.get(last << 32 | token) or self.compatible(last, token)):
                        tokens = self._backtrack(longest, start, stop)
                        break
                    tokens.append(token)
                    at += length[token]
                    last = token
                out.append(tokens)
            start = stop + 1
        return out

    def _backtrack(self, longest: list[int], start: int, stop: int) -> list[int]:
        open_at, out, at = bytearray(b"\x01") * (stop - start + 1), [], start
        token: int | None = longest[start]
        while token is not None:
            end = at + self.length[token]
            if open_at[end - start] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at, token = end, longest[end] if end < stop else None
            elif (less := self._shorter.get(token)) is not None:
                token = less
            else:
                open_at[at - start] = 0
                token = out.pop()
                at -= self.length[token]
        return out

    def encode_packed(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; a word is encoded once while the memo lasts."""
        group, size = [], 0
        for text in texts:
            group.append(self.pattern.findall(text))
            size += len(text)
            if size >= GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[list[str]]) -> Iterator[bytes]:
        memo, words = self._words, set().union(*group)
        new = words.difference(memo)
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            new = words
        new = list(new)
        memo.update(zip(new, [array("I", ids).tobytes() for ids in self.encode_words([w.encode() for w in new])], strict=True))
        for found in group:
            yield b"".join(map(memo.__getitem__, found))
        for word in new:
            if len(word) > MEMO_CHARS:
                del memo[word]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.encode_packed([text])), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@cache
def encoder(path: str) -> tuple[BytePairEncoder, list[str]]:
    """The encoder of a rank file, and its ids in decimal."""
    bpe = BytePairEncoder(load_ranks(path))
    return bpe, [str(i) for i in range(max(bpe.bytes_of) + 1)]


def encode_documents(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]: the digests of the decimal ids joined by commas, and of the bytes that the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, decimal = encoder(ranks)
        for batch in batches:
            rows = []
            for encoded in bpe.encode_packed(text.as_py() or "" for text in batch.column("text")):
                ids = np.frombuffer(encoded, "<u4").tolist()
                written = ",".join(map(decimal.__getitem__, ids)).encode()
                rows.append((len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest(), *[ids] * with_ids))
            columns = [*zip(*rows, strict=True)] or [()] * (3 + with_ids)
            types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks)[0]
        for batch in batches:
            out = [bpe.decode(ids.as_py() or []) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")
