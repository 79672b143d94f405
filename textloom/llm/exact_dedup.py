"""Exact deduplication with a log-structured merge index of digests. DataFrame functions only.

Texts are equal when they are identical once every space, tab, line feed, vertical tab, form feed
and carriage return is deleted. Each batch is a memtable: its digests are grouped and flushed as one
immutable run, sorted by digest. Compaction merges runs and keeps, for each digest, the best identifier: most
code points in the original text, then smallest id. Digests held by several documents are hits. A filter, a bitmap of
the hits' hashes made when all runs are merged, decides which texts are read again and shuffled: those that may be hits, to be compared byte by byte
before documents count as equal. All others are known to be single.

A filter has FILTER_BITS bits at most, whatever the corpus, so it may be broadcast; a fuller one lets more
texts through and drops none. A digest that many rows hold is one row of a broadcast table as well: at
most BIG_GROUPS digests can each be held by more than that share of all rows. So no hot digest meets
its rows in one task.

Defined results: a null text is an empty text, and empty texts are equal to each other. A null id
loses a tie against any other. Rows that repeat an id are judged one by one; of rows that tie in
length and id, one stays in without_copies, and all are marked as kept in exact_duplicates, which goes
by id. An empty table gives an empty table. Columns other than the id and the text are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage

WHITE_SPACE = " \t\n\x0b\f\r"
#: Bits of a filter: 16 for each digest, 64 MB at most.
BITS_PER_DIGEST, FILTER_BITS = 16, 1 << 29
#: Digests that more than 1 / BIG_GROUPS of all rows hold; there can't be more of them than this.
BIG_GROUPS = 1_000


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for char in WHITE_SPACE:
        out = F.replace(out, F.lit(char), F.lit(""))  # several times as fast as translate
    return out


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def rank_of(doc_id: Column, text: Column) -> Column:
    """Orders the documents of a digest; the best comes first."""
    return F.struct((-F.char_length(F.coalesce(text, F.lit("")))).alias("less"), doc_id.isNull().alias("no_id"), doc_id.alias("keep_id"))


class Filter:
    """A bitmap of hashes: may_hold is true for every digest put in, and for few others."""

    def __init__(self, digests: DataFrame, count: int, folder: str):
        self.bits = max(1 << 15, min(FILTER_BITS, 1 << (BITS_PER_DIGEST * max(count, 1) - 1).bit_length()))
        place = self._place(F.col("digest"))
        chunks = digests.select(F.bitmap_bucket_number(place).alias("chunk"), F.bitmap_bit_position(place).alias("bit")).groupBy("chunk")
        self.chunks = storage.write_table(chunks.agg(F.bitmap_construct_agg("bit").alias("bitmap")), folder)  # of 4 kB each

    def _place(self, digest: Column) -> Column:
        return F.pmod(F.xxhash64(digest), F.lit(self.bits)) + 1

    def split(self, df: DataFrame) -> DataFrame:
        """df, which has a column digest, with the column may_hold. No row of df moves."""
        place = self._place(F.col("digest"))
        bit = F.bitmap_bit_position(place)
        byte = F.conv(F.hex(F.substr("bitmap", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        held = F.call_function("shiftright", byte, F.pmod(bit, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1
        chunks = F.broadcast(self.chunks)  # self.bits bits, FILTER_BITS at most
        joined = df.withColumn("chunk", F.bitmap_bucket_number(place)).join(chunks, "chunk", "left")
        return joined.select(*df.columns, F.coalesce(held, F.lit(False)).alias("may_hold"))


class DigestLog:
    """A log-structured index from digest to (best rank, copies)."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4):
        self.spark, self.path, self.fanout = spark, path or storage.new_folder(spark, "digest-log"), fanout
        self.runs: list[str] = []
        self.flushed = 0

    def _write_run(self, grouped: DataFrame) -> None:
        run = f"{self.path}/run-{self.flushed:06d}"
        self.flushed += 1
        storage.write_table(grouped.sortWithinPartitions("digest"), run)
        self.runs.append(run)

    def append(self, entries: DataFrame) -> None:
        """Flushes one memtable: rows (digest, rank), rank ordering the documents of a digest."""
        self._write_run(entries.groupBy("digest").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("copies")))
        if len(self.runs) >= self.fanout:
            self.compact()

    def read(self) -> DataFrame:
        """The index as it stands: one row for each digest over all runs."""
        rows = self.spark.read.parquet(*self.runs)
        return rows if len(self.runs) == 1 else rows.groupBy("digest").agg(F.min("rank").alias("rank"), F.sum("copies").alias("copies"))

    def compact(self) -> None:
        old = self.runs
        if len(old) > 1:
            merged = self.read()
            self.runs = []
            self._write_run(merged)
            for run in old:
                storage.remove_folder(self.spark, run)

    def hits(self) -> tuple[DataFrame, int, int]:
        """The digests that several rows hold, how many these are, and how many rows there are."""
        index = self.read()
        found, rows = index.agg(F.count_if(F.col("copies") > 1), F.coalesce(F.sum("copies"), F.lit(0))).first()
        return index.where("copies > 1"), found, rows


def id_batch(docs: DataFrame, id_col: str, count: int) -> tuple[Column, int]:
    """The number of the range of the id that a row is in, nulls in the first, and how many ranges there are."""
    low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
    if count < 2 or low is None or high <= low:
        return F.lit(0), 1
    edges = [low + (high - low + 1) * i // count for i in range(1, count)]
    return F.coalesce(sum((F.col(id_col) >= F.lit(edge)).cast("int") for edge in edges), F.lit(0)), count


def id_ranges(docs: DataFrame, id_col: str, count: int) -> list[DataFrame]:
    """docs cut into ranges of the id; together they hold every row once."""
    batch, n = id_batch(docs, id_col, count)
    return [docs.where(batch == i) for i in range(n)] if n > 1 else [docs]


class _Index:
    """The log over all documents (doc_id, text), its hits and their filter, after byte verification."""

    def __init__(self, texts: DataFrame, flushes: int):
        spark = texts.sparkSession
        folder = storage.new_folder(spark, "exact-dedup")
        log = DigestLog(spark, f"{folder}/log")
        batch, parts = id_batch(texts, "doc_id", flushes)
        rows = texts.select("doc_id", digest_of(F.col("text")).alias("digest"), rank_of(F.col("doc_id"), F.col("text")).alias("rank"), batch.alias("batch"))
        rows.write.options(compression="zstd").partitionBy("batch").parquet(f"{folder}/entries")  # texts are read and digested once for all batches
        entries = spark.read.schema(rows.schema).parquet(f"{folder}/entries")
        for i in range(parts):
            log.append(entries.where(F.col("batch") == i).select("digest", "rank"))
        log.compact()
        self.index = log.read()
        self.entries = entries.select("doc_id", "digest", "rank")
        self.hits, found, rows = log.hits()
        self.filter = Filter(self.hits, found, f"{folder}/filter")
        # A digest that more than this many rows hold can't be one of more than BIG_GROUPS.
        self.big = rows // BIG_GROUPS + 1

        again = texts.select("doc_id", normalised(F.col("text")).alias("norm"), rank_of(F.col("doc_id"), F.col("text")).alias("rank"))
        again = self.filter.split(again.withColumn("digest", F.unhex(F.sha2("norm", 256)))).where("may_hold")
        self.verified = again.groupBy("digest", "norm").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("copies"))  # copies meet before the shuffle
        several = self.verified.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
        self.unequal = storage.write_table(several, f"{folder}/unequal")
        self.any_unequal = not self.unequal.isEmpty()
        self.members = again


def join_groups(rows: DataFrame, groups: DataFrame, how: str, most: int) -> DataFrame:
    """rows joined with groups (digest, copies, ...) by digest: with those of more than `most` copies by broadcast, with the others in a shuffle. most: at least 1 / BIG_GROUPS of all rows."""
    big = groups.where(F.col("copies") > most)
    is_big = F.broadcast(big.select("digest"))  # BIG_GROUPS rows at most
    met = rows.join(F.broadcast(big), "digest")
    return met.unionByName(rows.join(is_big, "digest", "left_anti").join(groups.where(F.col("copies") <= most), "digest", how))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", flushes: int = 4) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    index = _Index(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), flushes)
    groups = index.index.withColumnRenamed("rank", "best")
    result = join_groups(index.entries.select("digest", "doc_id"), groups, "inner", index.big)
    if index.any_unequal:  # one digest, different bytes: those documents are grouped by the bytes
        apart = index.members.join(index.unequal, "digest", "left_semi").select("digest", "norm", "doc_id")
        apart = apart.join(index.verified.withColumnRenamed("rank", "best"), ["digest", "norm"]).select("digest", "doc_id", "best", "copies")
        result = result.join(index.unequal, "digest", "left_anti").unionByName(apart)
    return result.select(
        "doc_id",
        F.col("best.keep_id").alias("keep_id"),
        F.col("copies").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("best.keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", flushes: int = 4) -> DataFrame:
    """One row of docs for each text, all columns. Rows are judged one by one, whatever their ids: a null id, an id of several rows, and a repeated row are all right. Only texts that may have copies are shuffled."""
    id_, text = F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    index = _Index(rows.select(id_.alias("doc_id"), text.alias("text")), flushes)
    keyed = index.filter.split(rows.select("row", digest_of(text).alias("digest"), rank_of(id_, text).alias("rank")))
    groups = index.hits.select("digest", F.col("rank").alias("best"), "copies")
    held = join_groups(keyed.where("may_hold").select("row", "digest", "rank"), groups, "left", index.big)
    if index.any_unequal:
        by_bytes = index.verified.select("digest", F.col("norm").alias("n"), F.col("rank").alias("best"), "copies")
        apart = keyed.where("may_hold").select("row", "digest", "rank").join(index.unequal, "digest", "left_semi").withColumn("n", normalised(text)).join(by_bytes, ["digest", "n"])
        held = held.join(index.unequal, "digest", "left_anti").withColumn("n", F.lit("")).unionByName(apart.select(*held.columns, "n"))
    else:
        held = held.withColumn("n", F.lit(""))
    single = held.where("copies IS NULL").select("row")
    # Rows that tie in all of the rank: one of them stays. Most ties meet before the shuffle.
    best = held.where(F.col("rank") == F.col("best")).groupBy("digest", "n").agg(F.first("row").alias("row"))
    kept = keyed.where("NOT may_hold").select("row").unionByName(single).unionByName(best.select("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
