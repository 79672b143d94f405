"""Removal of repeated passages with a log-structured index of window fingerprints.

A window is `width` consecutive words of one document; a word goes if it is covered by a window whose
words also start in a document with a smaller id. Neighbouring windows mostly share the smallest hash
among the short k-grams inside them. Such a maximal run of windows is one *stretch*: a window decides
its own smallest k-gram, so equal windows lie in stretches with an equal anchor, and a stretch is
written as one fingerprint (anchor, 128-bit digest of its words) for the some twenty windows it holds.

The index is a log of immutable runs, each sorted by fingerprint, holding for each fingerprint the
documents that have it, and after compaction the smallest. A new batch is joined with the runs and with itself, by a shuffle on fingerprints:

1. A stretch whose digest belongs to a smaller document goes as a whole. The digest covers the words'
   bytes, which verifies the hit.
2. Where one anchor has stretches with different digests, they may share some of their windows. The
   smallest document of each such digest is read again, and digests of its single windows in those
   stretches decide.

The batch is a run of the log from then on; compaction merges runs when there are several.

Defined results: null and empty texts have no words. Fewer than `width` words make no window. Repeats
within one document don't count, nor does a row that repeats an id. Rows with a null id are neither
matched nor changed. An empty table gives an empty table. Columns not named in the parameters are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .exact_dedup import id_ranges

WIDTH = 50
GRAM = 12
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_WORDS_HELD = 1 << 17


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_HELD:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def _gram_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all runs of `width` word hashes, by doubling."""
    out, have, power, have_power = None, 0, h, 1
    while True:
        if width & have_power:
            if out is None:
                out, have = power, have_power
            else:
                n = len(h) - have - have_power + 1
                out = out[:n] * (_FACTOR ** np.uint64(have_power)) + power[have : have + n]
                have += have_power
        if have == width:
            out = out ^ (out >> np.uint64(29))
            return out * np.uint64(0xBF58476D1CE4E5B9)
        n = len(h) - 2 * have_power + 1
        power = power[:n] * (_FACTOR ** np.uint64(have_power)) + power[have_power : have_power + n]
        have_power *= 2


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    rest = width - have
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest else a


class Windows:
    """The words of a text and its stretches of windows."""

    def __init__(self, text: str | None, hashes: dict[bytes, int], width: int = WIDTH, gram: int = GRAM):
        self.words = (text or "").encode().split()  # bytes: exactly the white space \x20 \x09-\x0D
        self.width = width
        n = len(self.words)
        if n < width:
            self.starts = self.counts = self.anchors = np.empty(0, np.int64)
            return
        h = np.fromiter(map(hashes.__getitem__, self.words), np.uint64, n)
        anchors = _sliding_min(_gram_hashes(h, gram), width - gram + 1)
        self.starts = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
        self.counts = np.diff(np.append(self.starts, len(anchors)))
        self.anchors = anchors[self.starts].view(np.int64)
        self.joined = b" ".join(self.words)
        ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, n) + 1)
        self._from, self._to = np.concatenate(([0], ends[:-1])), ends - 1

    def digests(self, starts: np.ndarray, counts: np.ndarray | int) -> list[bytes]:
        """128-bit digests of the words under `counts` windows from each start on."""
        a, b, text, digest = self._from[starts].tolist(), self._to[starts + counts + self.width - 2].tolist(), self.joined, xxhash.xxh3_128_digest
        return [digest(text[i:j]) for i, j in zip(a, b, strict=True)]


def _stretch_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            ids, starts, counts, anchors, digests = [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                w = Windows(text.as_py(), hashes, width)
                if len(w.starts):
                    ids.append(np.full(len(w.starts), doc_id, np.int64))
                    starts.append(w.starts)
                    counts.append(w.counts)
                    anchors.append(w.anchors)
                    digests += w.digests(w.starts, w.counts)
            if ids:
                join = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind))
                yield pa.RecordBatch.from_arrays([join(ids, np.int64), join(starts, np.int32), join(counts, np.int32), join(anchors, np.int64), pa.array(digests, pa.binary())], ["doc_id", "start", "windows", "anchor", "digest"])

    return run


def stretches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, start, windows, anchor, digest) of all documents (doc_id, text)."""
    return docs.where("doc_id IS NOT NULL").mapInArrow(_stretch_batches(width), "doc_id long, start int, windows int, anchor long, digest binary")


def _window_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for doc_id, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("wanted"), strict=True):
                w = Windows(text.as_py(), hashes, width)
                asked = wanted.as_py()
                at = np.concatenate([np.arange(s["start"], s["start"] + s["windows"]) for s in asked])
                own = np.concatenate([np.full(s["windows"], s["start"]) for s in asked])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), doc_id)), pa.array(own.astype(np.int32)), pa.array((at - own).astype(np.int32)), pa.array(w.digests(at, 1), pa.binary())], ["doc_id", "start", "step", "window"])

    return run


class FingerprintLog:
    """The index: immutable runs of stretches (anchor, digest, doc_id, start, windows), sorted by fingerprint.

    Batches are appended in order of their ids; append() returns the ranges of windows of the batch
    that an earlier document has.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, width: int = WIDTH, fanout: int = 4):
        self.spark, self.width, self.fanout = spark, width, fanout
        self.path = path or storage.new_folder(spark, "fingerprint-log")
        self.runs: list[str] = []
        self.written = 0

    def _write(self, df: DataFrame, label: str) -> tuple[DataFrame, str]:
        self.written += 1
        path = f"{self.path}/{label}-{self.written:06d}"
        return storage.write_table(df, path), path

    def append(self, texts: DataFrame, batch: DataFrame) -> DataFrame:
        """texts: all documents indexed so far and the batch (doc_id, text). -> (doc_id, start, step, windows) of the batch."""
        found, run = self._write(stretches(batch, self.width).sortWithinPartitions("anchor", "digest"), "run")
        pool = found.withColumn("new", F.lit(1))
        if self.runs:
            pool = pool.unionByName(self.spark.read.parquet(*self.runs).withColumn("new", F.lit(0)))
        # An anchor that stands once can't repeat anything; most do, and go no further.
        busy = pool.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("new").alias("fresh")).where("n > 1 AND fresh = 1")
        live, _ = self._write(pool.join(busy.select("anchor"), "anchor", "left_semi"), "live")
        storage.release(self.spark)

        first = live.groupBy("anchor", "digest").agg(F.min("doc_id").alias("first_doc"))
        whole = live.where("new = 1").join(first, ["anchor", "digest"]).where("doc_id > first_doc").select("doc_id", "start", F.lit(0).alias("step"), "windows")

        # Where an anchor has several digests, single windows decide, read in the first document of each.
        several = first.groupBy("anchor").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("anchor")
        unsure = first.join(several, "anchor", "left_semi")
        places = live.join(unsure, ["anchor", "digest"]).where("doc_id = first_doc")
        wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias("wanted"))  # a document's own stretches
        read = texts.join(wanted, "doc_id").select("doc_id", "text", "wanted")
        windows, _ = self._write(read.mapInArrow(_window_batches(self.width), "doc_id long, start int, step int, window binary"), "windows")
        storage.release(self.spark)
        first_window = windows.groupBy("window").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc")
        single = windows.join(first_window, "window").where("doc_id > first_doc").select("doc_id", "start", "step", F.lit(1).alias("windows"))
        low = batch.agg(F.min("doc_id")).first()[0]
        ranges, _ = self._write(whole.unionByName(single.where(F.col("doc_id") >= F.lit(low))), "ranges")
        self.runs.append(run)
        if len(self.runs) >= self.fanout:
            self.compact()
        storage.release(self.spark)
        return ranges

    def compact(self) -> None:
        """Merges the runs into one sorted run that holds, for each fingerprint, its smallest document."""
        if len(self.runs) > 1:
            rows = self.spark.read.parquet(*self.runs)
            least = rows.groupBy("anchor", "digest").agg(F.min(F.struct("doc_id", "start")).alias("at"), F.first("windows").alias("windows"))
            merged = least.select("at.doc_id", "at.start", "windows", "anchor", "digest").sortWithinPartitions("anchor", "digest")
            old, self.runs = self.runs, [self._write(merged, "run")[1]]
            for run in old:
                storage.remove_folder(self.spark, run)


def _covered(ranges: list[dict], width: int, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for r in ranges:
        edge[r["start"] + r["step"]] += 1
        edge[r["start"] + r["step"] + r["windows"] + width - 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def _result_batches(width: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digests, kept_texts = [], [], [], []
            for text, ranges in zip(batch.column("text"), batch.column("ranges"), strict=True):
                words = (text.as_py() or "").encode().split()
                gone = 0
                if ranges.is_valid:
                    covered = _covered(ranges.as_py(), width, len(words))
                    gone = int(covered.sum())
                    kept = b" ".join([words[i] for i in np.flatnonzero(~covered)])
                else:
                    kept = b" ".join(words)
                total.append(len(words))
                removed.append(gone)
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept.decode())
            arrays = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                arrays, names = [*arrays, pa.array(kept_texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, parts: int = 2, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text", fanout: int = 4) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256[, kept_text].

    The documents enter the index in `parts` batches by range of the id; `fanout` runs are compacted into one.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    log = FingerprintLog(spark, width=width, fanout=fanout)
    ranges = None
    for batch in id_ranges(texts.where("doc_id IS NOT NULL"), "doc_id", parts):
        part = log.append(texts, batch)
        ranges = part if ranges is None else ranges.unionByName(part)
    by_doc = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("start", "step", "windows")).alias("ranges"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return texts.join(by_doc, "doc_id", "left").select("doc_id", "text", "ranges").mapInArrow(_result_batches(width, with_text), schema)
