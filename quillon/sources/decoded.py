"""Decoded blobs kept by content: what was decoded once is read, not decoded again.

A store is a folder with two tables.  ``rows`` holds the decoded rows, ``index`` what happened
to each key: stored (with its size), used, evicted.  A key is the hash of a blob's name and of the
decoder's name, version and parameters.  Both are appended in runs; rows of a run count only
once its index is written, so a run that broke off leaves nothing that is read.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.notes import cache_key
from ..session import stage

INDEX = "key string, run string, event string, at long, size long"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def new_run() -> str:
    return "r" + uuid.uuid4().hex  # never read as a number


def events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index") if exists(spark, f"{path}/index") else spark.createDataFrame([], INDEX)


def record(rows: DataFrame, path: str, event: str) -> None:
    """Append an event for each row (key, run, size)."""
    at = F.lit(time.time_ns() // 1000).cast("long")
    rows.select("key", "run", F.lit(event).alias("event"), at.alias("at"), F.col("size").cast("long").alias("size")).write.mode("append").parquet(f"{path}/index")


def live(spark: SparkSession, path: str) -> DataFrame:
    """(key, run, size, last_access) of what is stored; of a key that two runs stored the newer one."""
    per = events(spark, path).groupBy("key").agg(
        F.max(F.when(F.col("event") == "stored", F.struct("at", "run", "size"))).alias("s"),
        F.max(F.when(F.col("event") == "evicted", F.col("at"))).alias("gone"),
        F.max("at").alias("last_access"),
    )
    return per.filter("s is not null and (gone is null or gone < s.at)").select("key", "s.run", "s.size", "last_access")


def through(spark: SparkSession, path: str, blobs: DataFrame, decode: Callable[[DataFrame], DataFrame], version: str) -> DataFrame:
    """The decoded rows of distinct ``blobs`` (blob_sha, content), decoded only where the store has none under this version.

    ``decode`` takes blobs and gives rows with blob_sha.  A null blob_sha is left out.
    """
    wanted = blobs.filter("blob_sha is not null").dropDuplicates(["blob_sha"]).withColumn("key", cache_key("blob_sha", F.lit(version)))
    known = stage(live(spark, path))
    used = stage(wanted.select("key").join(known, "key"))
    run = new_run()
    fresh = stage(wanted.join(known, "key", "left_anti").select("key", "blob_sha", "content"))
    if not fresh.isEmpty():
        keyed = fresh.select("blob_sha", "key")
        decode(fresh.select("blob_sha", "content")).join(keyed, "blob_sha").withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{path}/rows")
        record(fresh.select("key", F.lit(run).alias("run"), F.octet_length("content").alias("size")), path, "stored")
    if not used.isEmpty():
        record(used, path, "used")
    held = used.select("key", "run").unionByName(fresh.select("key", F.lit(run).alias("run")))
    columns = decode(fresh.select("blob_sha", "content")).schema
    if not exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], columns)
    # only the runs asked for are listed: a store has one a call that decoded something
    stored = spark.read.parquet(f"{path}/rows")
    return stored.join(held, ["run", "key"], "left_semi").select(*columns.names)


def evict(spark: SparkSession, path: str, budget: int) -> DataFrame:
    """Let the keys used last, whose content fits ``budget`` bytes, stay; (key, size) of those that go. Of one call's keys the smaller stay.

    The running sum is taken over calls (a row each), then over a call's 4,096 ranges of keys, then
    within a range, so that no task orders all keys.
    """
    own = live(spark, path).withColumn("range", F.substring("key", 1, 3))
    ranges = own.groupBy("last_access", "range").agg(F.sum("size").alias("n"))
    calls = ranges.groupBy("last_access").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    calls = calls.select("last_access", before(Window.orderBy(F.desc("last_access"))).alias("_newer"))
    ranges = ranges.select("last_access", "range", before(Window.partitionBy("last_access").orderBy("range")).alias("_lower")).join(calls, "last_access")
    within = F.sum("size").over(Window.partitionBy("last_access", "range").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    gone = stage(own.join(ranges, ["last_access", "range"]).withColumn("_n", F.col("_newer") + F.col("_lower") + within).filter(F.col("_n") > budget).select("key", "run", "size"))
    if not gone.isEmpty():
        record(gone, path, "evicted")
    return gone.select("key", "size")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write what is live to a new store, without evicted rows and past events."""
    own = stage(live(spark, path))
    if own.isEmpty():
        return
    run = new_run()
    rows = spark.read.parquet(f"{path}/rows").join(own.select("run", "key"), ["run", "key"], "left_semi")
    rows.withColumn("run", F.lit(run)).write.partitionBy("run").parquet(f"{target}/rows")
    own.select("key", F.lit(run).alias("run"), F.lit("stored").alias("event"), F.col("last_access").alias("at"), "size").write.parquet(f"{target}/index")
