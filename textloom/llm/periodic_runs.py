"""Maximal periodic runs of words, by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of words that repeats its first q words at least LEAST_EXPONENT times, q being the
smallest such number, and that can't be extended. Texts are independent, so none is shuffled: a task
takes its texts in blocks of words and for each block

1. cuts its words into LZ blocks, each the longest piece that also begins earlier; at the borders of
   these blocks, common extensions to both sides give tandem repeats that cover, by shifts to the
   right, the first place of every tandem repeat there is;
2. walks from these along the suffix links of the block's suffix tree, from each tandem repeat to the
   one that begins a word later, until a walk ends or meets another: the complete vocabulary;
3. locates all places of the vocabulary, the leaves below each of its members; places of one
   period that follow each other are a run.

Only tandem repeats whose half isn't itself repeated are followed, so that a run counts with its smallest
period alone, and places are O(n log n) in number. Before the first step, texts are cut where no run can
be: each word of a run stands in it LEAST_EXPONENT times at least, so a word that stands less often in
its piece of text is a border, and so on until nothing changes. This drops no run and no part of one.

Memory is bounded by BLOCK words, or by a single text where that is longer: about 150 bytes for a word
that the cuts leave.

Defined results: a null or empty text, or one without words, has no run and collapses to ''. A null id
stays null. Repeated rows stay repeated, each with its own result. An empty table gives an empty table.
Columns that aren't named in the parameters are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_EXPONENT, LEAST_WORDS = 4, 6
#: Words that are searched at once, but for a longer text.
BLOCK = 1 << 18
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])


def possible(text_of: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places where a run can be, ascending, and the piece of text that each is in."""
    at, piece, n_words = np.arange(len(words)), text_of.astype(np.int64), int(words.max(initial=0)) + 1
    while len(at):
        _, back, times = np.unique(piece * n_words + words[at], return_inverse=True, return_counts=True)
        left = times[back] >= LEAST_EXPONENT
        kept = at[left]
        borders = np.concatenate([[True], (np.diff(kept) > 1) | (np.diff(piece[left]) > 0)]) if len(kept) else np.empty(0, bool)
        new = np.cumsum(borders) - 1
        long = np.bincount(new)[new] >= LEAST_WORDS if len(kept) else borders
        if long.all() and left.all():
            return kept, new
        at, piece = kept[long], new[long]
    return at, piece


class Factors:
    """Names for all substrings of 1, 2, 4, 8, ... words, equal where they are; the last ones order the suffixes."""

    def __init__(self, s: np.ndarray):
        name = np.unique(s, return_inverse=True)[1]
        self.names, n, size = [name.astype(np.int32)], len(s), 1
        while n and int(name.max()) < n - 1:
            after = np.zeros(n, np.int64)
            after[: max(0, n - size)] = name[size:].astype(np.int64) + 1
            name = np.unique(name * np.int64(n + 1) + after, return_inverse=True)[1]
            self.names.append(name.astype(np.int32))
            size *= 2
        self.rank = self.names[-1]
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = np.arange(n)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are equal from places i and j (i <> j) on; the text's last word is unique."""
        i, j, first = i.copy(), j.copy(), i
        for level in range(len(self.names) - 1, -1, -1):
            name = self.names[level]
            step = (name[i] == name[j]).astype(np.int64) << level
            i += step
            j += step
        return i - first

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are equal up to places i and j (i <> j), these included; the text's first word is unique."""
        i, j, first = i + 1, j + 1, i + 1
        for level in range(len(self.names) - 1, -1, -1):
            name, a, b = self.names[level], i - (1 << level), j - (1 << level)
            same = (a >= 0) & (b >= 0) & (name[np.maximum(a, 0)] == name[np.maximum(b, 0)])
            i, j = np.where(same, a, i), np.where(same, b, j)
        return first - i


def lz_blocks(f: Factors) -> np.ndarray:
    """Where the blocks begin; each is the longest piece that begins earlier too, or a new word."""
    n = len(f.rank)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    lower, upper = [0] * n, [0] * n
    for i, r in zip(range(n - 1, -1, -1), f.rank[::-1].tolist(), strict=True):  # only suffixes that begin earlier are left
        a, b = before[r], after[r]
        lower[i], upper[i] = a, b
        if a >= 0:
            after[a] = b
        if b >= 0:
            before[b] = a
    longest = np.zeros(n, np.int64)
    for side in (np.array(lower), np.array(upper)):
        i = np.flatnonzero(side >= 0)
        longest[i] = np.maximum(longest[i], f.forward(i, f.order[side[i]]))
    size, starts, i = np.maximum(longest, 1).tolist(), [], 0
    while i < n:
        starts.append(i)
        i += size[i]
    return np.array(starts)


def _each(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row its number, repeated `count` times, and first, first + 1, ..."""
    row = np.repeat(np.arange(len(count)), count)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def _primitive(f: Factors, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether the halves aren't repetitions themselves: none of half / p, p a prime factor of half, is a period."""
    out, rest = np.ones(len(half), bool), half.copy()
    least = np.zeros(int(half.max(initial=1)) + 1, np.int64)
    for p in range(2, int(len(least) ** 0.5) + 1):
        if not least[p]:
            multiples = least[p * p :: p]
            multiples[multiples == 0] = p
    while (at := np.flatnonzero(out & (rest > 1))).size:
        p = np.where(least[rest[at]] > 0, least[rest[at]], rest[at])
        period = half[at] // p
        out[at] = f.forward(start[at], start[at] + period) < 2 * half[at] - period
        while (divisible := rest[at] % p == 0).any():
            rest[at] = np.where(divisible, rest[at] // p, rest[at])
    return out


def covering(s: np.ndarray, f: Factors) -> tuple[np.ndarray, np.ndarray]:
    """(start, half) of tandem repeats from which shifts to the right reach the first place of every one."""
    h = lz_blocks(f)
    n = len(s)
    end = np.append(h[1:], n)
    end_of_next = np.append(end[1:], n)
    found = []
    # Across a block's end, beginning inside; then across a block's beginning, the half at most as long as it and the next.
    for border, count, back in ((end, np.where(end < n, end - h, 0), True), (h, end_of_next - h, False)):
        row, half = _each(np.ones(len(h), np.int64), count)
        right = border[row] + (0 if back else half)
        left = right - half
        keep = (left > 0) & (right < n)
        keep[keep] = s[left[keep]] == s[right[keep]]
        left, right, half = left[keep], right[keep], half[keep]
        ahead, behind = f.forward(left, right), f.backward(left - 1, right - 1)
        keep = ahead + behind >= half
        found.append((np.maximum(left - behind, left - half + 1)[keep], half[keep]))
    start, half = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = _primitive(f, start, half)
    return start[keep], half[keep]


class SuffixTree:
    """Nodes 0 to n - 1 are the leaves by rank, the root is n. low and high: the leaves below a node."""

    def __init__(self, s: np.ndarray, f: Factors):
        n, self.order, self.rank = len(s), f.order, f.rank
        common = f.forward(f.order[:-1], f.order[1:]).tolist()
        depth, low, high, parent = [0], [0], [n], [-1]
        leaf, stack = [0] * n, [0]
        for r, shared in enumerate([*common, 0]):  # what leaf r shares with the next one
            last, first = r, r
            while depth[stack[-1]] > shared:
                top = stack.pop()
                if last == r:
                    leaf[r] = top + n
                else:
                    parent[last - n] = top + n
                high[top], first, last = r + 1, low[top], top + n
            if depth[stack[-1]] < shared:
                stack.append(len(depth))
                depth.append(shared)
                low.append(first)
                high.append(0)
                parent.append(0)
            if last == r:
                leaf[r] = stack[-1] + n
            else:
                parent[last - n] = stack[-1] + n
        parent[0] = n
        self.parent = np.array(leaf + parent)
        self.low = np.concatenate([np.arange(n), low])
        self.high = np.concatenate([np.arange(1, n + 1), high])
        self.depth = np.concatenate([n - f.order, depth])
        self._up = [self.parent]
        while (self._up[-1] != n).any():
            self._up.append(self._up[-1][self._up[-1]])
        inner = np.arange(n, len(self.parent))
        self.link = np.empty(len(self.parent), np.int64)
        self.link[:n] = f.rank[np.minimum(f.order + 1, n - 1)]
        self.link[inner] = self.locus(np.minimum(f.order[self.low[inner]] + 1, n - 1), self.depth[inner] - 1)
        self.link[n] = n
        child = np.flatnonzero(np.arange(len(self.parent)) != n)
        above = self.parent[child]
        self.words = int(s.max()) + 1
        key = above * self.words + s[f.order[self.low[child]] + self.depth[above]]
        by = np.argsort(key)
        self.edges, self.children = key[by], child[by]

    def locus(self, place: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The highest node whose path begins with the `length` words from `place` on."""
        node = self.rank[place].astype(np.int64)
        for up in reversed(self._up):
            above = up[node]
            node = np.where(self.depth[above] >= length, above, node)
        return node

    def child(self, node: int, word: int) -> int:
        """The child of a node on a word, or -1."""
        key = node * self.words + word
        at = bisect_left(self.edges, key)
        return int(self.children[at]) if at < len(self.edges) and self.edges[at] == key else -1


def vocabulary(s: np.ndarray, tree: SuffixTree, start: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, half) of every tandem repeat, by walks along suffix links from covering ones."""
    words, link, parent, depth = s.tolist(), tree.link.tolist(), tree.parent.tolist(), tree.depth.tolist()
    seen: set[tuple[int, int]] = set()
    for node, i, k in zip(tree.locus(start, 2 * half).tolist(), start.tolist(), half.tolist(), strict=True):
        size = 2 * k - 1
        while (node, k) not in seen:
            seen.add((node, k))
            first, node, i = words[i], link[node], i + 1
            while depth[parent[node]] >= size:
                node = parent[node]
            if depth[node] > size:  # inside an edge one word alone can follow
                if words[i + size] != first:
                    break
            elif (node := tree.child(node, first)) < 0:
                break
            else:
                i = int(tree.order[tree.low[node]])
    found = np.array(list(seen), np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def runs_of(words: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in texts laid end to end, words given as numbers: start, length, period, by start, then period."""
    at, piece = possible(text_of, words)
    none = np.empty(0, np.int64)
    if not len(at):
        return none, none, none
    place = np.arange(len(at)) + piece + 1  # each piece has a unique word of its own before it, the last one also after it
    s = np.full(len(at) + int(piece[-1]) + 2, -1, np.int64)
    s[place] = words[at]
    borders = np.flatnonzero(s < 0)
    s[borders] = int(words.max()) + 1 + np.arange(len(borders))
    s = np.unique(s, return_inverse=True)[1]
    f = Factors(s)
    start, half = covering(s, f)
    if not len(start):
        return none, none, none
    tree = SuffixTree(s, f)
    node, half = vocabulary(s, tree, start, half)
    row, leaf = _each(tree.low[node], tree.high[node] - tree.low[node])
    here, period = f.order[leaf], half[row]
    by = np.lexsort((here, period))
    here, period = here[by], period[by]
    new = np.concatenate([[True], (np.diff(here) != 1) | (np.diff(period) != 0)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(here)) - 1
    start, period = here[first], period[first]
    length = here[last] - start + 2 * period
    keep = length >= np.maximum(LEAST_WORDS, LEAST_EXPONENT * period)
    origin = np.full(len(s), -1, np.int64)
    origin[place] = at
    start, length, period = origin[start[keep]], length[keep], period[keep]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def _blocks(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for text in texts:
        words = (text or "").encode().split()  # of bytes: at white space of ASCII alone
        if held and size + len(words) > BLOCK:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that are left if each run keeps one period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for held in _blocks(batch.column("text").to_pylist()):
            numbers: dict[bytes, int] = {}
            sizes = np.array([len(w) for w in held])
            words = np.fromiter((numbers.setdefault(x, len(numbers)) for w in held for x in w), np.int64, int(sizes.sum()))
            start, length, period = runs_of(words, np.repeat(np.arange(len(held)), sizes))
            edges = np.cumsum([0, *sizes])
            cuts = np.searchsorted(start, edges)
            each = [list(zip((start[a:b] - e).tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True)) for a, b, e in zip(cuts, cuts[1:], edges, strict=False)]
            runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in each], pa.list_(_RUN))
            texts = pa.array([collapsed(w, own) for w, own in zip(held, each, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(held)), pa.array(sizes, pa.int64()), runs, texts], ["doc_id", "n_words", "runs", "collapsed"])
            done += len(held)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_words, runs (start, length, period; by start, then period), collapsed (the text whose runs keep one period each)."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(_search, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def longest_repeated(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first. Null without runs."""
    return F.reduce(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def with_repeated_words(text: Column, doc_id: Column) -> Column:
    """In documents whose id's crc32 h divides by 10, the words from some place on repeat a number of them: with g = h // 10 and n words, from g % n on the first 1 + (n - g % n) // (3 + g % 8)."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size(words), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    part = F.slice(words, a + 1, p)
    again = F.slice(F.flatten(F.array_repeat(part, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), changed).otherwise(text)
