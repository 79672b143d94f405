"""A table that a stream upserts: batch-numbered versions of its buckets, and manifests that name the current ones.

Rows go to buckets by their keys. A batch rewrites the buckets that it touches, under its own number, and then publishes a
manifest, which says for each bucket which batch wrote it last. A manifest appears by one rename, so readers see all of a
batch or nothing. A batch that is replayed finds its manifest, or a later one, and changes nothing; one that was cut off
before it overwrites what it left. Of rows with equal keys the one with the greatest `order` stays, so the outcome doesn't
depend on how rows were dealt into batches.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


class UpsertedTable:
    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str], order: list[str], buckets: int = 16, first_wins: bool = False):
        """first_wins: rows whose keys are known already are skipped, whatever their order."""
        self.spark, self.folder, self.schema, self.keys, self.order, self.buckets, self.first_wins = spark, folder.rstrip("/"), schema, keys, order, buckets, first_wins
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self) -> tuple[int, dict[str, int]]:
        """The last published batch and each bucket's version; -1 before the first."""
        if not self._files.exists(self._path(f"{self.folder}/manifests")):
            return -1, {}
        found = [f.getPath().getName() for f in self._files.listStatus(self._path(f"{self.folder}/manifests"))]
        numbers = [int(n[:-5]) for n in found if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return -1, {}
        stream = self._files.open(self._path(f"{self.folder}/manifests/{max(numbers):020d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return max(numbers), json.loads(text)

    def _publish(self, batch_id: int, versions: dict[str, int]) -> None:
        draft, final = (self._path(f"{self.folder}/manifests/{batch_id:020d}{end}") for end in (".draft", ".json"))
        stream = self._files.create(draft, True)
        stream.write(json.dumps(versions).encode())
        stream.close()
        if not self._files.rename(draft, final):
            raise RuntimeError(f"{final} was published by another run")

    def _read(self, versions: dict[str, int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/v{v}/_bucket={b}" for b, v in sorted(versions.items())])

    def read(self) -> DataFrame:
        """The table as of the last published batch."""
        return self._read(self._manifest()[1])

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch. Rows with a null key are skipped."""
        done, versions = self._manifest()
        if batch_id <= done:
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        names = self.schema.names
        new = batch.select(*[F.col(c).cast(self.schema[c].dataType).alias(c) for c in names]).dropna(subset=self.keys)
        new = new.withColumns({"_bucket": bucket, "_old": F.lit(0)}).persist()
        try:
            touched = {str(r[0]) for r in new.select("_bucket").distinct().collect()}  # `buckets` numbers at most
            held = self._read({b: v for b, v in versions.items() if b in touched}).withColumns({"_bucket": bucket, "_old": F.lit(1)})
            rank = F.struct(*([F.col("_old")] if self.first_wins else []), *self.order, *names)
            merged = held.unionByName(new).groupBy(*self.keys, "_bucket").agg(F.max_by(F.struct(*names), rank).alias("r"))
            # A bucket is a folder, written by as many tasks as its rows fill.
            merged.select("r.*", "_bucket").repartition("_bucket", F.pmod(F.hash(*self.keys), F.lit(8))).write.partitionBy("_bucket").mode("overwrite").parquet(f"{self.folder}/v{batch_id}")
        finally:
            new.unpersist()
        self._publish(batch_id, versions | {b: batch_id for b in touched})

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Starts a query that upserts all that the stream has now."""
        return stream.writeStream.foreachBatch(self.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
