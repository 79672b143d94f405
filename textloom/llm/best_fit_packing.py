"""Best-fit packing of documents into training sequences, planned over a histogram of lengths.

A piece is at most `capacity` tokens long, so the histogram has at most `capacity` rows whatever the
corpus. The driver packs it best-fit decreasing, whole counts at a time: the plan says which ranks of
each length go to which sequences at which offset. Pieces then get their rank within their length
(numbered in buckets of a hash of the id, with the buckets' sizes summed before them, so that a
length that half of all pieces have is numbered by many tasks) and take the planned slot by a join.

Defined results: a null text is empty, and an empty text is one piece holding the end id alone. A
longer document is cut into pieces of `capacity` tokens, the first of which may be shorter; nothing
else is cut. Repeated rows and null ids are packed like others. An empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage
from .tokens import load_added, load_ranks

CAPACITY = 2048
END_ID = 0


@cache
def _encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary in a merger that gives the same ids several times as fast as the library of the .json file; its added tokens count as such wherever a text holds them."""
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens=load_added(path))


def piece_bounds(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than the capacity."""
    first = length % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): ids are little-endian unsigned 32-bit numbers."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.asarray([*encoding.encode(text.as_py() or "", allowed_special="all"), end_id], "<u4").tobytes()
                for k, (at, n) in enumerate(piece_bounds(len(ids) // 4, capacity)):
                    piece = ids[4 * at : 4 * (at + n)]
                    rows.append((doc_id, k, at, n, zlib.crc32(piece), piece))
            columns = [*zip(*rows, strict=True)] or [()] * 6
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            width = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:width], types, strict=False)], names[:width])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Rows (length, first_rank, ranks, first_sequence, each, offset): `ranks` pieces of that length from
    first_rank on go, `each` to a sequence, to consecutive sequences, the first of each at `offset`.
    Open sequences are held as runs of equally full ones: by space left, a list of (first sequence, count).
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    spaces: list[int] = []  # sorted spaces left for which there are open sequences
    open_runs: dict[int, list[tuple[int, int]]] = {}
    sequences = 0

    def put_back(space: int, first: int, count: int) -> None:
        if space and count:
            if space not in open_runs:
                bisect.insort(spaces, space)
                open_runs[space] = []
            open_runs[space].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, count = open_runs[space].pop()
                if not open_runs[space]:
                    del open_runs[space]
                    spaces.pop(at)
            else:
                space, first = capacity, sequences
                count = -(-left // (capacity // length))
                sequences += count
            each = space // length  # the fuller sequence is the better fit, so it is filled before the next
            used = min(count, left // each)
            if used:
                plan.append((length, rank, used * each, first, each, capacity - space))
                put_back(space - each * length, first, used)
                rank, left = rank + used * each, left - used * each
            if used < count and left:
                some = min(each, left)
                plan.append((length, rank, some, first + used, some, capacity - space))
                put_back(space - some * length, first + used, 1)
                rank, left, used = rank + some, left - some, used + 1
            put_back(space, first + used, count - used)
    return plan


def ranked_within_length(pieces: DataFrame) -> DataFrame:
    """Adds rank: 0, 1, ... within each length, in no order that means anything but always the same."""
    buckets = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = salted.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    return salted.withColumn("inner", inner).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inner") - 1).drop("bucket", "inner", "before")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents with sequence_id and offset, gapless from 0 in each sequence."""
    spark = docs.sparkSession
    pieces = storage.materialise(tokenised_pieces(docs, tokenizer, capacity, end_id, with_ids, id_col, text_col), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(plan_slots(histogram, capacity), "length long, first_rank long, ranks long, first_sequence long, each long, at long")
    slot = F.col("rank") - F.col("first_rank")
    fits = (F.col("rank") >= F.col("first_rank")) & (slot < F.col("ranks"))
    numbered = ranked_within_length(pieces).alias("p")
    # The plan's size is bounded by the capacity, not by the corpus.
    joined = numbered.join(F.broadcast(plan.alias("s")), (F.col("p.length") == F.col("s.length")) & fits)
    sequence = F.col("first_sequence") + F.expr("(rank - first_rank) div each")
    return joined.select("p.*", sequence.alias("sequence_id"), (F.col("at") + F.pmod(slot, F.col("each")) * F.col("p.length")).alias("offset")).drop("rank")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, documents): the token ids of each sequence, of at most `capacity` tokens."""
    placed = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    rows = packed.groupBy("sequence_id").agg(placed.alias("placed"))
    return rows.select("sequence_id", F.expr("aggregate(placed, X'', (a, x) -> concat(a, x.ids))").alias("ids"), F.col("placed.doc_id").alias("documents"))
