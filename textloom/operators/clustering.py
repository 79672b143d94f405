"""Topic discovery over vectors: clusters of reduced vectors, a sweep of settings, and a tree of topic profiles."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import density, spectral, stages

#: Profiles that the tree may have; it holds their distances on the driver.
MOST_PROFILES = 2_000


def clustered(vectors: DataFrame, id_col: str, v_col: str, least: int, least_near: int = 5, k: int = 15, dims: int = 5) -> DataFrame:
    """vectors with column topic: density clusters of `least` rows and more over `dims` coordinates from the graph of k neighbours by cosine; -1 for the rest, and for vectors that take no part."""
    low = spectral.reduced(vectors, id_col, v_col, dims, k)
    found = density.labels(low, least, least_near, k).withColumnRenamed("id", id_col)
    return vectors.join(found, id_col, "left").withColumn("topic", F.coalesce("topic", F.lit(-1).cast("long")))


def fingerprint(rows: DataFrame) -> str:
    """The same for tables of equal columns and equal rows, whatever their order: their number, and sums of two hashes of each."""
    names = sorted(rows.columns)
    sums = [F.sum(F.xxhash64(F.lit(seed), F.to_json(F.struct(*[F.col(c) for c in names]), {"ignoreNullFields": "false"})).cast("decimal(38,0)")) for seed in (1, 2)]
    found = rows.agg(F.count(F.lit(1)), *sums).first()
    return hashlib.sha256(json.dumps([sorted(rows.dtypes), [str(x) for x in found]]).encode()).hexdigest()


def swept(rows: DataFrame, settings: dict[str, dict], fit: Callable[..., DataFrame], folder: str | None = None, at_once: int = 1) -> dict[str, DataFrame]:
    """fit(rows, **setting) for each named setting, `at_once` of them at a time. A run is kept under the digest of its setting, fit's name and the rows' fingerprint: the same run is read again, by whatever name, and any change of these makes a new one."""
    spark: SparkSession = rows.sparkSession
    folder, own, runs = folder or f"{stages.shared_folder(spark)}/sweeps", fingerprint(rows), {}
    paths = {n: f"{folder}/" + hashlib.sha256(json.dumps([own, f"{fit.__module__}.{fit.__qualname__}", s], sort_keys=True).encode()).hexdigest() for n, s in settings.items()}
    for name, path in paths.items():
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            runs.setdefault(path, settings[name])

    def run(path: str) -> None:
        fit(rows, **runs[path]).write.mode("overwrite").parquet(path)

    with ThreadPoolExecutor(at_once) as pool:  # steps of few tasks leave cores to the other runs
        for done in [pool.submit(inheritable_thread_target(spark)(run), path) for path in runs]:
            done.result()
    return {n: spark.read.parquet(path) for n, path in paths.items()}


def combined_report(reports: dict[str, DataFrame], titles: dict[str, str]) -> DataFrame:
    """The reports under each other, with columns corpus and title (the name itself where it has none)."""
    out = None
    for name, df in reports.items():
        one = df.select(F.lit(name).alias("corpus"), F.lit(titles.get(name, name)).alias("title"), *df.columns)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def profile_distances(t: DataFrame, groups: list) -> DataFrame:
    """(a, b, distance), a < b: cosine distances of the topics' shares over the groups."""
    c = t.where("topic <> -1").groupBy("topic").agg(*[F.count_if(F.col("industry") == g).alias(f"g{i}") for i, g in enumerate(groups)])
    p = c.select("topic", F.array(*[F.col(f"g{i}").cast("double") for i in range(len(groups))]).alias("p")).where(F.exists("p", lambda x: x > 0))
    length = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y))
    unit = p.select("topic", F.transform("p", lambda x: x / length(F.col("p"))).alias("u"))
    a, b = unit.select(F.col("topic").alias("a"), F.col("u").alias("x")), unit.select(F.col("topic").alias("b"), F.col("u").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z)
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (1 - dot).alias("distance"))  # topics by topics: a small table


def average_linkage(distances: DataFrame) -> list[tuple[int, int, float, int]]:
    """Merges (first, second, distance, size) of the nearest clusters by mean distance; a cluster is named by its smallest topic."""
    topics = sorted({r[0] for r in distances.select(F.explode(F.array("a", "b"))).distinct().limit(MOST_PROFILES + 1).collect()})
    if len(topics) > MOST_PROFILES:
        raise ValueError(f"more than {MOST_PROFILES} profiles")
    at = {t: i for i, t in enumerate(topics)}
    d = np.full((len(topics), len(topics)), np.inf)
    for a, b, x in distances.select("a", "b", "distance").collect():  # MOST_PROFILES squared at most
        d[at[a], at[b]] = d[at[b], at[a]] = x
    size, merges = np.ones(len(topics)), []
    for _ in range(len(topics) - 1):
        i, j = sorted(divmod(int(np.argmin(d)), len(d)))  # the first of equals
        merges.append((topics[i], topics[j], float(d[i, j]), int(size[i] + size[j])))
        joined = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = joined, joined
        d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
        size[i] += size[j]
    return merges
