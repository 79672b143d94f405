"""SimHash near-deduplication over deletion variants of fingerprint segments.

A fingerprint has 64 bits, and fingerprints link at three or fewer differing bits. Cut into two
segments of 32 bits, one segment of a linked pair differs by at most one bit. So every distinct
fingerprint is indexed under the 64 variants in which one bit of one segment is a wildcard; linked
fingerprints share a variant. Equal variants meet in a shuffle, and every candidate is verified by
counting the differing bits. Copies collapse before that: the index holds distinct fingerprints only.
Within a variant, a walk over the unvisited members emits a spanning forest of the links, never all
pairs, in memory that grows with the distinct fingerprints of that variant.

without_near_copies goes by a similarity instead: texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more. Its fingerprints have 160 bits in eight segments of 20, so that of two
that differ by at most 15 bits one segment differs by at most one. Texts of similarity 0.8 differ by
24 bits in the mean, and are found where one segment of eight does. Segments are dealt without one of
their four parts, and the variants with a wildcard in that part arise in the task that holds such a group. Within a variant each member gets
its nearest earlier one as its candidate; candidates are verified by the shingle sets themselves, the
nearest of each text first and then the others wherever the two are not yet connected.

That finds most links, and the large classes; an exact way finds the rest. In one order of all shingles two sets of
that similarity share one among the first n - ceil(0.8 n) + 1 of each, n being a set's size. The order goes
by how often a shingle's bucket occurs in all texts, rare ones first, so that passages which many texts share seldom are
among them. Texts are paired where such a shingle joins two classes that are still apart, and sizes, places and
then parity bits of the sets, which bound in how many shingles they differ, allow the similarity; the sets confirm it. Shingles that lie within one class are left out before pairs arise.

Defined results: a null or empty text, or one without words, has the fingerprint zero, linked like
any other. A text of one or two words has one shingle. Null ids take part, but name a component only
if it has no other id. Repeated rows stay repeated. An empty table gives an empty table. In
without_near_copies texts without words equal each other, a text of fewer than five words has one
shingle, and rows are judged one by one, whatever their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage
from .components import connected_components
from .exact_dedup import BIG_GROUPS, Filter, join_groups
from .substring_dedup import _gram_hashes, _WordHashes

MAX_BITS = 3
SEED = 42
SHINGLE_WORDS = 3
_CHUNK = 1 << 15  # shingles whose bits are unpacked at once


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a whole text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the white space \x20 \x09-\x0D
    if not words:
        return 0
    width = min(SHINGLE_WORDS, len(words))
    total, ones = len(words) - width + 1, np.zeros(64, np.int64)
    for at in range(0, total, _CHUNK):
        part = words[at : at + _CHUNK + width - 1]
        shingles = map(b" ".join, zip(*[part[i:] for i in range(width)], strict=False))
        digests = b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def variants(prints: DataFrame) -> DataFrame:
    """(variant, fp): each fingerprint under its 64 one-wildcard segment variants."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    key = lambda j: F.when(j < 32, low).otherwise(high).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), (j % 32).cast("int"))))
    coded = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.call_function("shiftleft", j.cast("long"), F.lit(32)).bitwiseOR(key(j)))
    return prints.select("fp", F.explode(coded).alias("variant"))


def spanning_links(members: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among distinct fingerprints (unsigned)."""
    links, waiting, frontier = [], members, []
    while len(waiting) or frontier:
        if not frontier:
            frontier, waiting = [waiting[0]], waiting[1:]
        at = frontier.pop()
        near = np.bitwise_count(waiting ^ at) <= MAX_BITS
        if near.any():
            found, waiting = waiting[near], waiting[~near]
            links.append((np.full(len(found), at), found))
            frontier.extend(found)
    return links


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by variant; a variant that goes on in the next batch is carried over."""
    rest_v, rest_f = np.empty(0, np.int64), np.empty(0, np.uint64)

    def linked(v: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.diff(v)) + 1
        starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(v)]))
        sizes = ends - starts
        two = starts[sizes == 2]
        two = two[np.bitwise_count(f[two] ^ f[two + 1]) <= MAX_BITS]
        links = [(f[two], f[two + 1])]
        for s, e in zip(starts[sizes > 2], ends[sizes > 2], strict=True):
            links += spanning_links(f[s:e])
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*links, strict=True))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for batch in batches:
        v = np.concatenate((rest_v, batch.column("variant").to_numpy()))
        f = np.concatenate((rest_f, batch.column("fp").to_numpy().view(np.uint64)))
        if not len(v):
            continue
        cut = int(np.searchsorted(v, v[-1]))  # the last variant may go on
        if cut:
            yield from linked(v[:cut], f[:cut])
        rest_v, rest_f = v[cut:], f[cut:]
    if len(rest_v):
        yield from linked(rest_v, rest_f)


def near_links(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints -> links (a, b) that connect whatever lies within MAX_BITS of each other."""
    dealt = variants(prints).repartition("variant").sortWithinPartitions("variant")
    return dealt.mapInArrow(_link_batches, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, fp, fingerprint (hex), component_id (smallest doc_id reachable)."""
    spark = docs.sparkSession
    folder = storage.new_folder(spark, "simhash")
    printed = storage.write_table(fingerprints(docs, id_col, text_col), f"{folder}/prints")
    distinct = printed.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    nodes = connected_components(near_links(distinct.select("fp")))
    members = distinct.join(nodes, distinct.fp == nodes.node, "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    named = members.groupBy("component").agg(F.min("least_id").alias("component_id"))
    classes = storage.write_table(members.join(named, "component").select("fp", "component_id"), f"{folder}/classes")
    return printed.join(classes, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Shingles, similarity and fingerprints of without_near_copies.
WORDS, SIMILARITY = 5, 0.8
SEGMENTS, SEGMENT_BITS = 8, 20
#: Parts of a segment.
PARTS, PART_BITS = 4, 5
#: Candidates differ by this many bits at most: those expected at SIMILARITY and over three standard errors more.
FAR_BITS = 38
#: In a variant of more members than this, those within LEADER_BITS of a leader are nobody's candidate but their leader's.
ALL_LEAD, LEADER_BITS = 256, 24
_LANES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7))


def shingle_set(text: str | None, held: _WordHashes, width: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(_gram_hashes(np.fromiter(map(held.__getitem__, words), np.uint64, len(words)), min(width, len(words))))


def set_fingerprint(grams: np.ndarray) -> np.ndarray:
    """The SimHash bits of a set: SEGMENTS rows of SEGMENT_BITS."""
    bits, ones = SEGMENTS * SEGMENT_BITS, np.zeros(SEGMENTS * SEGMENT_BITS, np.int64)
    for at in range(0, len(grams), _CHUNK):
        lanes = np.stack([(grams[at : at + _CHUNK] ^ x) * _LANES[0] for x in _LANES], axis=1)
        lanes = (lanes ^ (lanes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        lanes ^= lanes >> np.uint64(32)
        ones += np.add.reduce(np.unpackbits(lanes.view(np.uint8).reshape(len(lanes), -1), axis=1)[:, :bits], axis=0, dtype=np.int64)
    return (2 * ones > len(grams)).reshape(SEGMENTS, SEGMENT_BITS)


def _print_batches(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, powers = _WordHashes(), 1 << np.arange(SEGMENT_BITS)
        for batch in batches:
            nodes, prints, segments = [], [], []
            for text in batch.column("row").field(text_col):
                grams = shingle_set(text.as_py(), held)
                bits = set_fingerprint(grams)
                nodes.append(xxhash.xxh64_intdigest(grams.tobytes(), SEED) - (1 << 63))
                prints.append(np.packbits(bits).tobytes())
                segments.append((bits @ powers).astype(np.int32))
            arrays = [batch.column("row"), pa.array(nodes, pa.int64()), pa.array(prints, pa.binary()), pa.array(segments, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "node", "print", "segments"])

    return run


def set_places(prints: DataFrame) -> DataFrame:
    """(key, free, node, print): each fingerprint under its segments without one of their parts, and that part's bits. Two whose segments differ in one bit share the key without that bit's part."""
    segment, shift = F.element_at("segments", F.floor(F.col("at") / PARTS).cast("int") + 1), F.pmod("at", F.lit(PARTS)) * PART_BITS
    part = F.call_function("shiftleft", F.lit((1 << PART_BITS) - 1), shift)
    key = F.call_function("shiftleft", F.col("at"), F.lit(SEGMENT_BITS)).bitwiseOR(segment.bitwiseAND(F.bitwise_not(part)))
    free = F.call_function("shiftright", segment.bitwiseAND(part), shift)
    dealt = prints.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS * PARTS - 1))))
    return dealt.select(key.alias("key"), free.alias("free"), "node", "print")


def _nearest_earlier(group: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by group -> (row, its nearest earlier row of the group, differing bits), where within FAR_BITS."""
    n = len(group)
    edges = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [n]])
    size = np.diff(edges)
    begin = np.repeat(edges[:-1], size)
    best, far = np.full(n, -1), np.full(n, FAR_BITS + 1)
    i, k = np.flatnonzero(np.repeat(size <= ALL_LEAD, size)), 1
    while len(i := i[i - k >= begin[i]]):
        apart = np.bitwise_count(prints[i] ^ prints[i - k]).sum(axis=1, dtype=np.int64)
        nearer = apart < far[i]
        far[i[nearer]], best[i[nearer]] = apart[nearer], i[nearer] - k
        k += 1
    for s, e in zip(edges[:-1][size > ALL_LEAD], edges[1:][size > ALL_LEAD], strict=True):
        leaders = np.empty(0, np.int64)
        for at in range(s, e, ALL_LEAD):  # a block meets the leaders before it, then each other
            block = np.arange(at, min(at + ALL_LEAD, e))
            for x in leaders:
                apart = np.bitwise_count(prints[block] ^ prints[x]).sum(axis=1, dtype=np.int64)
                nearer = apart < far[block]
                far[block[nearer]], best[block[nearer]] = apart[nearer], x
            rest = block[far[block] > LEADER_BITS]
            while len(rest):
                x, rest = rest[0], rest[1:]
                leaders = np.append(leaders, x)
                apart = np.bitwise_count(prints[rest] ^ prints[x]).sum(axis=1, dtype=np.int64)
                nearer = apart < far[rest]
                far[rest[nearer]], best[rest[nearer]] = apart[nearer], x
                rest = rest[far[rest] > LEADER_BITS]
    hit = np.flatnonzero(best >= 0)
    return hit, best[hit], far[hit]


def _candidate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by key and node; a key that goes on in the next batch is carried over."""
    rest: list[pa.RecordBatch] = []

    def linked(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = {c: pa.concat_arrays([b.column(c) for b in rows]) for c in ("key", "free", "node", "print")}
        raw = np.frombuffer(b"".join(columns["print"].to_pylist()), np.uint8).reshape(len(columns["node"]), -1)
        prints = np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8))).view(np.uint64)
        key, free, node = (columns[c].to_numpy().astype(np.int64) for c in ("key", "free", "node"))
        for bit in range(PART_BITS):  # a variant: this bit is a wildcard
            variant = key << PART_BITS | free & ~(1 << bit)
            order = np.argsort(variant, kind="stable")
            at, of, far = _nearest_earlier(variant[order], prints[order])
            yield pa.RecordBatch.from_arrays([pa.array(node[order[at]]), pa.array(node[order[of]]), pa.array(far.astype(np.int32))], ["a", "b", "far"])

    for batch in batches:
        if not batch.num_rows:
            continue
        v = batch.column("key").to_numpy()
        cut = int(np.searchsorted(v, v[-1]))
        if cut or (rest and rest[-1].column("key")[-1].as_py() != v[-1]):
            yield from linked([*rest, batch.slice(0, cut)] if cut else rest)
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield from linked(rest)


def _set_batches(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), held).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "grams"])

    return run


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) those whose sets have the similarity."""
    both = pairs.select("a", "b").join(sets.toDF("a", "of_a"), "a").join(sets.toDF("b", "of_b"), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(common >= F.lit(similarity) * (F.size("of_a") + F.size("of_b") - common) - 1e-9).select("a", "b")


#: Buckets in which shingles are counted; one number each, whatever the corpus.
GRAM_BUCKETS = 1 << 18


def _gram_bucket(grams: np.ndarray) -> np.ndarray:
    return ((grams * _LANES[1]) >> np.uint64(46)).astype(np.int64)


def _count_batches(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = _WordHashes(), np.zeros(GRAM_BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column("row").field(text_col):
                counts += np.bincount(_gram_bucket(shingle_set(text.as_py(), held)), minlength=GRAM_BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["bucket", "n"])

    return run


def gram_levels(printed: DataFrame, text_col: str) -> np.ndarray:
    """For each bucket of shingles the binary logarithm of the times that it occurs in sets of all rows."""
    rows = printed.select("row").mapInArrow(_count_batches(text_col), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(GRAM_BUCKETS, np.int64)
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return np.log2(counts + 1).astype(np.uint8)


def prefix(grams: np.ndarray, levels: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in the order of (level, hash), as many as a set of that similarity must share one of."""
    least = int(np.ceil(similarity * len(grams) - 1e-9))
    return grams[np.lexsort((grams, levels[_gram_bucket(grams)]))[: len(grams) - least + 1]]


def _prefix_batches(text_col: str, levels, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), held) for t in batch.column("row").field(text_col)]
            first = [prefix(g, levels.value, similarity).view(np.int64) if len(g) else g.view(np.int64) for g in sets]
            arrays = [batch.column("node"), pa.array([len(g) for g in sets], pa.int32()), pa.array(first, pa.list_(pa.int64())), pa.array([sketch(g) for g in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "size", "grams", "sketch"])

    return run


#: Bits of a set's sketch, at least and at most.
SKETCH_LEAST, SKETCH_MOST = 1 << 6, 1 << 16
#: Parts of the shingles whose postings are shuffled one after the other, so that not all are on disk at once.
PASSES = 2


def sketch(grams: np.ndarray) -> bytes:
    """A set's size (four bytes) and its parity bits, about as many as it has shingles. The half of them, one part xor the other, are those that a smaller set has."""
    bits = min(SKETCH_MOST, max(SKETCH_LEAST, 1 << max(len(grams) - 1, 0).bit_length()))
    places = ((grams * _LANES[2]) >> np.uint64(48)).astype(np.int64) & (bits - 1)
    return np.uint32(len(grams)).astype("<u4").tobytes() + np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8)).tobytes()


def can_be_alike(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Rows of two sketches as 16-bit numbers, those of a table of one length: whether the sets may have the similarity. Sets that differ by d shingles differ by at most d parity bits."""
    both = sum(x[:, 0].astype(np.int64) + (x[:, 1].astype(np.int64) << 16) for x in (a, b))
    a, b = a[:, 2:], b[:, 2:]
    while a.shape[1] != b.shape[1]:
        a, b = (x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :] if x.shape[1] > min(a.shape[1], b.shape[1]) else x for x in (a, b))
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= (1 - similarity) / (1 + similarity) * both + 1e-6


def _sketch_batches(similarity: float):
    def rows(column: list[bytes], at: np.ndarray) -> np.ndarray:
        return np.frombuffer(b"".join([column[i] for i in at]), "<u2").reshape(len(at), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_a, of_b, keep = batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist(), np.zeros(batch.num_rows, bool)
            lengths = np.array([(len(x), len(y)) for x, y in zip(of_a, of_b, strict=True)], np.int64).reshape(-1, 2)
            for pair in np.unique(lengths, axis=0):
                at = np.flatnonzero((lengths == pair).all(axis=1))
                keep[at] = can_be_alike(rows(of_a, at), rows(of_b, at), similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _prefixes(printed: DataFrame, nodes: DataFrame, known: DataFrame, similarity: float, text_col: str, folder: str) -> DataFrame:
    """(node, size, grams, sketch, class) of each node, class being null where it is the node itself. Only rows that may share their node, or stand in a class with others, are shuffled."""
    levels = printed.sparkSession.sparkContext.broadcast(gram_levels(printed, text_col))
    special = nodes.where("copies > 1").select(F.col("node").alias("digest")).union(known.select("node"))
    special = storage.write_table(special.distinct(), f"{folder}/special")
    split = Filter(special, special.count(), f"{folder}/special-filter").split(printed.select("row", F.col("node").alias("digest"))).withColumnRenamed("digest", "node")
    of = lambda rows: rows.select("row", "node").mapInArrow(_prefix_batches(text_col, levels, similarity), "node long, size int, grams array<long>, sketch binary")
    held = of(split.where("may_hold")).groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "grams", "sketch")]).join(known, "node", "left")
    held = held.select("node", "size", "grams", "sketch", F.when(F.col("component") != F.col("node"), F.col("component")).alias("class"))
    return storage.write_table(of(split.where("NOT may_hold")).withColumn("class", F.lit(None).cast("long")).unionByName(held), f"{folder}/prefixes")


def pairs_apart(printed: DataFrame, nodes: DataFrame, known: DataFrame, similarity: float, text_col: str, folder: str) -> DataFrame:
    """(a, b): every two nodes of different classes that can have the similarity. known: (node, component) of nodes in a class with others."""
    spark = printed.sparkSession
    sets = _prefixes(printed, nodes, known, similarity, text_col, folder)
    storage.release(spark)
    least = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("size_a") + F.col("size_b")) - 1e-9)  # shingles in common
    able = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) >= least
    pairs, own, of_gram = None, F.coalesce("class", "node"), Window.partitionBy("gram")
    for i in range(PASSES):  # each shuffles its share of the shingles
        posted = sets.select("node", "size", "class", F.posexplode("grams").alias("at", "gram")).where(F.pmod("gram", F.lit(PASSES)) == i)
        joining = posted.withColumns({"x": F.min(own).over(of_gram), "y": F.max(own).over(of_gram)}).where("x <> y")
        joining = storage.write_table(joining.select("gram", "node", "size", own.alias("class"), "at"), f"{folder}/joining-{i}")
        storage.release(spark)
        a, b = (joining.select("gram", *[F.col(c).alias(f"{c}_{e}") for c in ("node", "size", "class", "at")]) for e in "ab")
        both = a.join(b, "gram").where((F.col("node_a") < F.col("node_b")) & (F.col("class_a") != F.col("class_b")) & able)
        found = storage.write_table(both.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), f"{folder}/pairs-{i}")
        pairs = found if pairs is None else pairs.unionByName(found)
        storage.remove_folder(spark, f"{folder}/joining-{i}")
        storage.release(spark)
    # Sketches tell apart most texts that share a passage, before whole sets move.
    of = lambda e: sets.select(F.col("node").alias(e), F.col("sketch").alias(f"of_{e}"))
    told = pairs.distinct().join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(_sketch_batches(similarity), "a long, b long")
    told = storage.write_table(told, f"{folder}/apart")
    storage.remove_folder(spark, f"{folder}/prefixes")
    storage.release(spark)
    return told


def _sets_of(pairs: DataFrame, texts: DataFrame, path: str) -> DataFrame:
    """(node, grams) of the nodes that stand in pairs (a, b), from texts (digest, text); a filter keeps others from the shuffle."""
    ends = pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct()
    near_nodes = Filter(ends, ends.count(), f"{path}-filter")
    own = near_nodes.split(texts).where("may_hold").join(ends, "digest", "left_semi").groupBy(F.col("digest").alias("node")).agg(F.first("text").alias("text"))
    return storage.write_table(own.mapInArrow(_set_batches("text"), "node long, grams array<long>"), path)


def without_near_copies(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each class of texts that verified links connect, all columns: the one of the smallest id, a null id last. Only rows that may have others of their class are shuffled."""
    spark = docs.sparkSession
    folder = storage.new_folder(spark, "near-copies")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    printed = storage.write_table(rows.mapInArrow(_print_batches(text_col), f"row {kind}, node long, print binary, segments array<int>"), f"{folder}/prints")
    id_ = F.col(f"row.`{id_col}`")
    rank = F.struct(id_.isNull().alias("no_id"), id_.alias("id"), F.col("node"))
    nodes = printed.groupBy("node").agg(F.first("print").alias("print"), F.first("segments").alias("segments"), F.min(rank).alias("rank"), F.count(F.lit(1)).alias("copies"))
    nodes = storage.write_table(nodes, f"{folder}/nodes")

    dealt = set_places(nodes).repartition("key").sortWithinPartitions("key", "node")
    links = dealt.mapInArrow(_candidate_batches, "a long, b long, far int").distinct()
    links = storage.write_table(links, f"{folder}/candidates")
    storage.release(spark)  # of the shuffle files, which would add up
    texts = printed.select(F.col("node").alias("digest"), F.col(f"row.`{text_col}`").alias("text"))
    sets = _sets_of(links, texts, f"{folder}/sets")

    nearest = links.groupBy("a").agg(F.min(F.struct("far", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    found = storage.write_table(_alike(nearest, sets, similarity), f"{folder}/near-0")
    known = connected_components(found)
    class_of = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    apart = links.join(nearest, ["a", "b"], "left_anti").join(class_of("a"), "a", "left").join(class_of("b"), "b", "left")
    apart = apart.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
    found = found.unionByName(storage.write_table(_alike(apart, sets, similarity), f"{folder}/near-1"))
    storage.remove_folder(spark, f"{folder}/sets")
    known = connected_components(found)
    storage.release(spark)
    rest = pairs_apart(printed, nodes, known, similarity, text_col, folder)
    found = found.unionByName(storage.write_table(_alike(rest, _sets_of(rest, texts, f"{folder}/sets-apart"), similarity), f"{folder}/near-2"))
    storage.remove_folder(spark, f"{folder}/sets-apart")

    known = connected_components(found)
    storage.release(spark)
    members = nodes.select("node", "rank", "copies").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = members.groupBy("component").agg(F.min("rank").alias("best"), F.sum("copies").alias("rows")).where("rows > 1")
    several = storage.write_table(members.join(classes, "component").select(F.col("node").alias("digest"), "copies", "component", "best"), f"{folder}/classes")
    total = printed.count()
    keyed = Filter(several.select("digest"), several.count(), f"{folder}/class-filter").split(printed.select("row", F.col("node").alias("digest"), rank.alias("rank")))
    held = join_groups(keyed.where("may_hold").select("row", "digest", "rank"), several, "left", total // BIG_GROUPS + 1)
    best = held.where(F.col("rank") == F.col("best")).groupBy("component").agg(F.first("row").alias("row"))  # repeated rows meet here
    kept = keyed.where("NOT may_hold").select("row").unionByName(held.where("component IS NULL").select("row")).unionByName(best.select("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
