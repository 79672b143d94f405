"""Removal of lines that match an earlier line: an exact set-similarity join.

Lines are sets of words, words being 64-bit hashes. A global order puts rare words first: by how often
they occur, counted over all documents in a table of a fixed number of hashed buckets, then by hash.
Any order that is the same everywhere gives exact results; this one makes prefixes rare. For a Jaccard
similarity of t, sets of n and m words share at least t / (1 + t) * (n + m) words, so they share one of
the first n - ceil(t n) + 1 words (prefix filter), have t n <= m (length filter), and share enough of
what follows the common word (positional filter). A posting also carries 128 parity bits of its set;
sets that differ by d words differ by at most d of them, which turns most other pairs away.

Equal sets collapse before the join: lines are grouped by two digests of their sets, without their words, and
only the first line of each set yields postings. Words that occur once can't be shared and give no posting. What a
common word yields is the nearest earlier candidate of each set, not the pairs. Its words are fetched
and compared. Parity bits tell little about sets of many more words than bits, so larger sets carry WIDE bits
at most as well.

Where that fails and a set has other candidates, it is open. Postings that can meet an open one, by word and
size, go through the join once more, to find the sets that are open or some open set's candidate: a row for each
posting at most. The postings of these, and no others, go through it a third time, now with their sets' words, and every
candidate is compared until one matches; so no match is lost, and again a posting yields one row at most.

A task holds, of one word, the postings within the length filter of the current one.

Defined results: lines are cut at line feeds; a line without words is never removed; a null text is
one empty line. Order is by document id, null first, then place in the text; whatever has an earlier
match goes, whether or not that one stays. Rows that repeat an id count as parts of one document, and
lines of one place in them go in order of their hash. Null ids are held as the smallest long, which no
other id may be. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage
from .exact_dedup import Filter

SIMILARITY = 0.8
#: Buckets of the table of frequencies, a fixed size.
BUCKETS = 1 << 20
#: Bytes of text that are split at once, but for a longer text; postings compared at once, but for those that one word needs.
_CHUNK = 1 << 20
_POSTINGS = 1 << 17
#: Sets of more words than SMALL carry further parity bits, WIDE at most.
SMALL, WIDE = 192, 512
#: Bits of the filter of what can meet an open set, and the ratio of sizes that it holds as one.
_MEETING_BITS, _CLASS = 1 << 27, 1.1
#: Parts of the words whose postings are shuffled one after the other, so that not all are on disk at once.
PASSES = 2
_NULL_ID = -(2**63)

_U = np.uint64
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_OF_BYTE = np.random.default_rng(42).integers(1, 2**64, 256, np.uint64)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(max(n, _CHUNK + (_CHUNK >> 2)), base, np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection that spreads every bit (the SplitMix64 finaliser)."""
    x = x + _U(seed)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of data, and how many line feeds stand before it."""
    b = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~_SPACE[b], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_OF_BYTE[b] * _powers_of(_BASE, len(b)), out=sums[1:])
    hashes = _mix((sums[ends] - sums[starts]) * _powers_of(_INVERSE, len(b) + 1)[starts])
    return hashes, np.searchsorted(np.flatnonzero(b == 10), starts)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of about _CHUNK bytes together, with the place of the first."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append((text or "").encode())
        size += len(held[-1])
        if size >= _CHUNK:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, held in _chunks(batch.column("text").to_pylist()):
            hashes, _ = _words(b"\n".join(held))
            counts += np.bincount((hashes & _U(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])


def word_frequencies(texts: DataFrame) -> np.ndarray:
    """How often the words of each bucket occur: BUCKETS numbers, whatever the corpus."""
    rows = texts.select("text").mapInArrow(_count_batches, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def _line_table(data: bytes, n_lines: int, frequency: np.ndarray, t: float) -> dict[str, np.ndarray | pa.Array]:
    """A row for each line: size, two digests, parity bits, the prefix and how many words of it are left out in front."""
    hashes, line = _words(data)
    often = frequency[(hashes & _U(BUCKETS - 1)).astype(np.int64)]
    order = np.lexsort((hashes, often, line))
    hashes, often, line = hashes[order], often[order], line[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])])[: len(hashes)]
    hashes, often, line = hashes[new], often[new], line[new]
    size = np.bincount(line, minlength=n_lines)
    full = np.flatnonzero(size)
    at = np.concatenate([[0], np.cumsum(size)])[:-1]

    def by_line(ufunc: np.ufunc, values: np.ndarray) -> np.ndarray:
        out = np.zeros(n_lines, np.uint64)
        if len(full):
            out[full] = ufunc.reduceat(values, at[full])
        return out.view(np.int64)

    out = {"size": size.astype(np.int32), "d1": by_line(np.add, _mix(hashes, 1)), "d2": by_line(np.add, _mix(hashes, 2))}
    bit = _mix(hashes, 3) >> _U(57)
    one = _U(1) << (bit & _U(63))
    # A set of n words matches none but equal ones where neither a smaller set of n - 1 words nor one larger by a word could reach t.
    first = np.where(size > 0, size - np.ceil(t * size - 1e-9).astype(np.int64) + 1, 0)
    first = np.where(size >= t * (size + 1) - 1e-9, first, 0)
    alone = np.zeros(n_lines, np.int64)
    if len(full):
        alone[full] = np.add.reduceat((often <= 1).astype(np.int64), at[full])
    skip = np.minimum(alone, first)
    held = first - skip
    offsets = np.concatenate([[0], np.cumsum(held)])
    places = np.repeat(at + skip - offsets[:-1], held) + np.arange(offsets[-1])
    prefix = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes[places].view(np.int64)))
    parity = {"s1": by_line(np.bitwise_xor, np.where(bit < 64, one, _U(0))), "s2": by_line(np.bitwise_xor, np.where(bit < 64, _U(0), one))}
    return out | parity | {"wide": _wide_bits(hashes, size, at), "skip": skip.astype(np.int32), "prefix": prefix}


def _wide_bits(hashes: np.ndarray, size: np.ndarray, at: np.ndarray) -> pa.Array:
    """Parity bits of sets of more than SMALL words, about as many as the set has words; null for others. The half of them, one part xor the other, are those that a smaller set has."""
    out: list[bytes | None] = [None] * len(size)
    place = (_mix(hashes, 4) & _U(WIDE - 1)).astype(np.int64)
    for i in np.flatnonzero(size > SMALL).tolist():
        bits = min(WIDE, 1 << (int(size[i]) - 1).bit_length())
        odd = np.bincount(place[at[i] : at[i] + size[i]] & (bits - 1), minlength=bits) & 1
        out[i] = np.packbits(odd.astype(np.uint8)).tobytes()
    return pa.array(out, pa.binary())


def _wide_apart(wide: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """In how many wide bits the sets p and q differ at least, pair by pair; 0 where one has none."""
    out = np.zeros(len(p), np.int64)
    length = lambda x: np.fromiter((0 if b is None else len(b) for b in wide[x]), np.int64, len(x))
    lp, lq = length(p), length(q)
    for m, n in {*zip(lp.tolist(), lq.tolist(), strict=True)}:
        if m and n:
            at = np.flatnonzero((lp == m) & (lq == n))
            rows = [np.frombuffer(b"".join(wide[x[at]]), np.uint64).reshape(len(at), -1) for x in (p, q)]
            least = min(m, n) // 8
            while any(r.shape[1] > least for r in rows):
                rows = [r[:, : r.shape[1] // 2] ^ r[:, r.shape[1] // 2 :] if r.shape[1] > least else r for r in rows]
            out[at] = np.bitwise_count(rows[0] ^ rows[1]).sum(axis=1, dtype=np.int64)
    return out


_LINES = "doc_id long, line int, size int, d1 long, d2 long, s1 long, s2 long, wide binary, skip int, prefix array<long>"


def _line_batches(shared, t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for first, held in _chunks(batch.column("text").to_pylist()):
                lines = np.array([x.count(b"\n") + 1 for x in held])
                n = int(lines.sum())
                doc = np.repeat(ids[first : first + len(held)], lines)
                line = np.arange(n) - np.repeat(np.cumsum(lines) - lines, lines)
                rows = {"doc_id": doc, "line": line.astype(np.int32)} | _line_table(b"\n".join(held), n, shared.value, t)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows.values()], [*rows])

    return run


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, lines): the words of those lines."""
    for batch in batches:
        ids, wanted = batch.column("doc_id").to_pylist(), batch.column("lines").to_pylist()
        found = [(i, k, x[k]) for i, ks, text in zip(ids, wanted, batch.column("text").to_pylist(), strict=True) for x in [(text or "").split("\n")] for k in ks if k < len(x)]
        for first, held in _chunks([x for _, _, x in found]):
            hashes, line = _words(b"\n".join(held))
            order = np.lexsort((hashes, line))
            hashes, line = hashes[order], line[order]
            new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])])[: len(hashes)]
            hashes, line = hashes[new], line[new]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(line, minlength=len(held)))])
            d1 = np.add.reduceat(np.append(_mix(hashes, 1), _U(0)), offsets[:-1])
            of = found[first : first + len(held)]
            words = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in of], pa.int64()), pa.array([x[1] for x in of], pa.int32()), pa.array(d1.view(np.int64)), words], ["doc_id", "line", "d1", "words"])


_PAIRS = "doc long, line int, d1 long, with_doc long, with_line int, with_d1 long, score double, more boolean"


def _pair_batch(a: dict[str, np.ndarray], later: np.ndarray, earlier: np.ndarray, score: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    columns = [a[c][x] for x in (later, earlier) for c in ("doc_id", "line", "d1")]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in [*columns, score, more]], [c.split()[0] for c in _PAIRS.split(", ")])


def _candidates(a: dict[str, np.ndarray], compared: int, t: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Postings sorted by word and size; the first `compared` of them have met each other. kind: the "nearest" earlier set of each; the "members", each with itself, of any pair whose later set is open; or of each open one an earlier set that matches it by its "words"."""
    n = len(a["word"])
    size, place, word, s1, s2 = a["size"].astype(np.int64), a["place"].astype(np.int64), a["word"], a["s1"].view(np.uint64), a["s2"].view(np.uint64)
    bounds = np.concatenate([np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])), [n]])
    end = np.repeat(bounds[1:], np.diff(bounds))
    rank = np.empty(n, np.int64)
    rank[np.lexsort((a["d1"], a["line"], a["doc_id"]))] = np.arange(n)
    best, nearest, more = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
    sets: dict[int, frozenset] = {}

    def words_of(x: int) -> frozenset:
        if x not in sets:
            if len(sets) >= _POSTINGS // 8:
                sets.clear()
            sets[x] = frozenset(a["words"][x].tolist())
        return sets[x]

    i, k = np.arange(n), 1
    while len(i := i[i + k < end[i]]):
        i = i[size[i] >= t * size[i + k] - 1e-9]  # sizes ascend: who fails here fails from here on
        j = i + k
        k += 1
        both = size[i] + size[j]
        need = np.ceil(t / (1 + t) * both - 1e-9).astype(np.int64)
        apart = np.bitwise_count(s1[i] ^ s1[j]).astype(np.int64) + np.bitwise_count(s2[i] ^ s2[j])
        ok = (apart <= both - 2 * need) & (j >= compared)
        ok &= np.minimum(place[i], place[j]) + np.minimum(size[i] - place[i], size[j] - place[j]) >= need
        if kind != "nearest":
            ok &= a["open"][i] | a["open"][j]
        ok = np.flatnonzero(ok)
        if (large := (size[i[ok]] > SMALL) & (size[j[ok]] > SMALL)).any():
            far = ok[large]
            apart[far] = np.maximum(apart[far], _wide_apart(a["wide"], i[far], j[far]))
            ok = ok[apart[ok] <= both[ok] - 2 * need[ok]]
        p, q, score = i[ok], j[ok], apart[ok] / both[ok]
        swap = rank[p] > rank[q]
        for late, early, s in ((p[swap], q[swap], score[swap]), (q[~swap], p[~swap], score[~swap])):  # no index stands twice in `late`
            if kind == "members":
                own = a["open"][late]
                nearest[late[own]], nearest[early[own]] = late[own], early[own]
                continue
            if kind == "words":
                for x, y in zip(late.tolist(), early.tolist(), strict=True):
                    if a["open"][x] and nearest[x] < 0:
                        common = len(words_of(x) & words_of(y))
                        if common >= t * (size[x] + size[y] - common) - 1e-9:
                            nearest[x], best[x] = y, 0
                continue
            more[late] |= nearest[late] >= 0
            better = s < best[late]
            best[late[better]], nearest[late[better]] = s[better], early[better]
    hit = np.flatnonzero(nearest >= 0)
    yield _pair_batch(a, hit, nearest[hit], best[hit], more[hit])


def _candidate_batches(t: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, compared = [], 0, 0
        for batch in batches:
            held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names})
            rows += batch.num_rows
            if rows - compared >= _POSTINGS:
                a = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
                yield from _candidates(a, compared, t, kind)
                keep = (a["word"] == a["word"][-1]) & (a["size"] >= t * a["size"][-1] - 1e-9)
                held = [{c: x[keep] for c, x in a.items()}]
                rows = compared = int(keep.sum())
        if rows > compared:
            yield from _candidates({c: np.concatenate([h[c] for h in held]) for c in held[0]}, compared, t, kind)

    return run


def _postings(sets: DataFrame) -> DataFrame:
    exploded = sets.select("doc_id", "line", "d1", "size", "s1", "s2", "wide", "skip", *[c for c in ("open", "words") if c in sets.columns], F.posexplode("prefix").alias("pos", "word"))
    return exploded.where("word IS NOT NULL").withColumn("place", F.col("pos") + F.col("skip")).drop("pos", "skip")


def _firsts(rows: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """The rows of the first line of each set. Only rows whose set may have several lines are shuffled."""
    several = sets.where("lines > 1").select(F.col("d1").alias("digest"), "d2", "at.doc_id", "at.line")
    split = Filter(several.select("digest"), several.count(), folder).split(rows.withColumnRenamed("d1", "digest"))
    held = split.where("may_hold").join(several.select("digest", "d2", F.col("doc_id").alias("of"), F.col("line").alias("at")), ["digest", "d2"], "left")
    held = held.where("of IS NULL OR (doc_id = of AND line = at)").dropDuplicates(["digest", "d2"])  # rows that repeat an id and a text
    columns = ["doc_id", "line", "size", F.col("digest").alias("d1"), "s1", "s2", "wide", "skip", "prefix"]
    return split.where("NOT may_hold").select(*columns).unionByName(held.select(*columns))


def _pairs(postings: DataFrame, t: float, kind: str) -> DataFrame:
    return postings.repartition("word").sortWithinPartitions("word", "size").mapInArrow(_candidate_batches(t, kind), _PAIRS)


def _meeting_places(words: np.ndarray, classes: np.ndarray, bits: int) -> np.ndarray:
    return (_mix(words.view(np.uint64) ^ _mix(classes.astype(np.uint64), 5), 6) & _U(bits - 1)).astype(np.int64)


def _class_of(sizes: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(sizes, 1)) / np.log(_CLASS)).astype(np.int64)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prefixes' words, the row that each is of, and the rows' sizes."""
    lists = batch.column("prefix")
    counts = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(counts)), counts), batch.column("size").to_numpy().astype(np.int64)


def _meeting_filter(open_sets: DataFrame, t: float) -> tuple[np.ndarray, int]:
    """A bitmap of the words of open sets with the classes of sizes that can match, _MEETING_BITS bits at most."""
    count = open_sets.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    bits = max(1 << 15, min(_MEETING_BITS, 1 << (64 * max(count, 1) - 1).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, row, size = _flat(batch)
            low, high = _class_of(np.floor(t * size))[row], _class_of(np.ceil(size / t))[row]
            for k in range(int((high - low).max(initial=-1)) + 1):
                own = low + k <= high
                yield pa.RecordBatch.from_arrays([pa.array(_meeting_places(words[own], low[own] + k, bits))], ["place"])

    at = F.col("place") + 1
    chunks = open_sets.select("size", "prefix").mapInArrow(places, "place long").groupBy(F.bitmap_bucket_number(at).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))
    out = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for chunk in chunks.collect():  # 4 kB each, 16 MB in all at most
        out[chunk["chunk"] - 1] = np.frombuffer(chunk["bitmap"], np.uint8)
    return out.ravel(), bits


def _meeting(rows: DataFrame, open_sets: DataFrame, t: float) -> DataFrame:
    """The rows that may meet an open set; the words of their prefixes by which they can't are null."""
    bitmap, bits = _meeting_filter(open_sets, t)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)  # _MEETING_BITS bits at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, row, size = _flat(batch)
            at = _meeting_places(words, _class_of(size)[row], bits)
            meets = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            lists = batch.column("prefix")
            offsets = pa.array(lists.offsets.to_numpy() - lists.offsets[0].as_py(), pa.int32())
            prefix = pa.ListArray.from_arrays(offsets, pa.array(words, mask=~meets))
            out = pa.RecordBatch.from_arrays([prefix if c == "prefix" else batch.column(c) for c in batch.schema.names], batch.schema.names)
            yield out.filter(pa.array(np.bincount(row[meets], minlength=len(size)) > 0))

    return rows.mapInArrow(run, rows.schema)


def _set_words(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, line) -> doc_id, line, d1, words."""
    wanted = lines.groupBy("doc_id").agg(F.collect_set("line").alias("lines"))
    words = texts.join(wanted, "doc_id").select("doc_id", "lines", "text").mapInArrow(_word_batches, "doc_id long, line int, d1 long, words array<long>")
    # Rows that repeat an id and a text give the same line more than once.
    return words.groupBy("doc_id", "line", "d1").agg(F.first("words").alias("words"))


def _verified(pairs: DataFrame, texts: DataFrame, t: float) -> DataFrame:
    """pairs with the column near: whether they match by their words."""
    words = _set_words(pairs.select(F.col("doc").alias("doc_id"), "line").union(pairs.select("with_doc", "with_line")), texts)
    left = words.toDF("doc", "line", "d1", "a")
    right = words.toDF("with_doc", "with_line", "with_d1", "b")
    both = pairs.join(left, ["doc", "line", "d1"]).join(right, ["with_doc", "with_line", "with_d1"])
    shared = F.size(F.array_intersect("a", "b"))
    return both.select(*pairs.columns, (shared >= F.lit(t) * (F.size("a") + F.size("b") - shared) - 1e-9).alias("near"))


def _earliest(pairs: DataFrame) -> DataFrame:
    return pairs.where("near").groupBy("doc", "line", "d1").agg(F.min(F.struct("with_doc", "with_line")).alias("near"))


def _id(value: Column) -> Column:
    return F.when(value != _NULL_ID, value)


def line_matches(docs: DataFrame, t: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line: doc_id, line, matched, with_doc, with_line (an earlier line that matches it, or null)."""
    spark = docs.sparkSession
    folder = storage.new_folder(spark, "line-dedup")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(word_frequencies(texts))  # BUCKETS numbers
    lines = storage.write_table(texts.mapInArrow(_line_batches(shared, t), _LINES), f"{folder}/lines")
    sets = lines.where("size > 0").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "line")).alias("at"), F.count(F.lit(1)).alias("lines"))
    sets = storage.write_table(sets, f"{folder}/sets")
    storage.release(spark)
    firsts = _firsts(lines.where("size(prefix) > 0"), sets, f"{folder}/filter")

    found = []
    for i in range(PASSES):  # each shuffles its share of the words
        own = _postings(firsts).where(F.pmod("word", F.lit(PASSES)) == i)
        found.append(storage.write_table(_pairs(own, t, "nearest"), f"{folder}/candidates-{i}"))
        storage.release(spark)
    nearest = reduce(DataFrame.unionByName, found).groupBy("doc", "line", "d1")
    other = F.struct("score", "with_doc", "with_line", "with_d1")
    nearest = nearest.agg(F.min(other).alias("m"), (F.max("more") | (F.min("with_d1") != F.max("with_d1"))).alias("more"))
    nearest = storage.write_table(nearest.select("doc", "line", "d1", "m.with_doc", "m.with_line", "m.with_d1", "more"), f"{folder}/nearest")
    tried = storage.write_table(_verified(nearest, texts, t), f"{folder}/tried")
    storage.release(spark)
    near = _earliest(tried)
    keys = ["doc_id", "line", "d1"]
    still = storage.write_table(tried.where("NOT near AND more").select(F.col("doc").alias("doc_id"), "line", "d1"), f"{folder}/open")
    if not still.isEmpty():
        rows = lines.where("size(prefix) > 0")
        own = Filter(still.select(F.col("d1").alias("digest")), still.count(), f"{folder}/open-filter").split(rows.withColumnRenamed("d1", "digest"))
        own = own.where("may_hold").withColumnRenamed("digest", "d1").join(still, keys, "left_semi")
        rest = storage.write_table(_meeting(rows, storage.write_table(own.select("size", "prefix"), f"{folder}/open-sets"), t), f"{folder}/meeting")
        rest = _firsts(rest, sets, f"{folder}/meeting-filter").join(still.withColumn("open", F.lit(True)), keys, "left")
        rest = storage.write_table(rest.withColumn("open", F.coalesce("open", F.lit(False))), f"{folder}/meeting-firsts")
        members = _pairs(_postings(rest), t, "members").select(F.col("doc").alias("doc_id"), "line", "d1").distinct()
        members = storage.write_table(members, f"{folder}/members")
        storage.release(spark)
        rest = rest.join(members, keys, "left_semi").join(_set_words(members.select("doc_id", "line"), texts), keys)
        rest = storage.write_table(_pairs(_postings(rest), t, "words").withColumn("near", F.lit(True)), f"{folder}/open-matches")
        near = near.unionByName(_earliest(rest))
    storage.release(spark)

    at = sets.select("d1", "d2", "lines", F.col("at.doc_id").alias("doc"), F.col("at.line").alias("line")).join(near, ["doc", "line", "d1"], "left")
    known = storage.write_table(at.where("near IS NOT NULL OR lines > 1").select("d1", "d2", F.struct("doc", "line").alias("at"), "near"), f"{folder}/known")
    joined = lines.where("size > 0").select("doc_id", "line", "d1", "d2").join(known, ["d1", "d2"], "left")
    is_first = (F.col("doc_id") == F.col("at.doc")) & (F.col("line") == F.col("at.line"))
    match = F.when(is_first, F.col("near")).otherwise(F.struct(F.col("at.doc").alias("with_doc"), F.col("at.line").alias("with_line")))
    m = F.when(F.col("at").isNotNull(), match)
    out = joined.select("doc_id", "line", m.alias("m")).unionByName(lines.where("size = 0").select("doc_id", "line", F.lit(None).cast("struct<with_doc:long,with_line:int>").alias("m")))
    return out.select(_id(F.col("doc_id")).alias("doc_id"), "line", F.col("m").isNotNull().alias("matched"), _id(F.col("m.with_doc")).alias("with_doc"), F.col("m.with_line").alias("with_line"))


def line_duplicates(docs: DataFrame, t: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_lines, n_removed, removed_lines (places from 0, joined by commas)."""
    places = F.array_sort(F.collect_list(F.when(F.col("matched"), F.col("line"))))
    g = line_matches(docs, t, id_col, text_col).groupBy("doc_id")
    return g.agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("matched").cast("long")).alias("n_removed"), F.array_join(F.transform(places, lambda p: p.cast("string")), ",").alias("removed_lines"))


def without_duplicates(docs: DataFrame, t: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the removed lines taken out of the text; all columns. Ids are taken to be unique."""
    gone = line_matches(docs, t, id_col, text_col).where("matched").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("line").alias("__gone"))
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]), "left")
    kept = F.array_join(F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    return joined.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns)
