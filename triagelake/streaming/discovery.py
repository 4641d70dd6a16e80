"""A tree of Markdown files followed by a ledger of content hashes.

A scan lists the tree (paths, times and sizes; contents are not read), reads the files
that are new or whose time or size differs, and compares hashes: files are added, changed,
renamed (a new path with the content of one that is gone) or deleted.  The files, the log
of changes and the scan's number are one publish, so each change is told once, also where
a scan is interrupted or comes again.  As a stream, scans follow a clock: a deletion alone
makes no file for a file source to see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from triagelake.sources.snapshots import SnapshotStore
from triagelake.sources.tables import relative_path

FILES = "source_path string, category string, sha256 string, n_bytes long, modified timestamp, text string"
CHANGES = "scan long, source_path string, change string, old_path string, sha256 string"
#: So many changed files are read by their paths; beyond, the tree is read once.
BY_PATH = 1000


def create_tables(store: SnapshotStore, buckets: int = 16) -> None:
    with store.publish() as p:
        p.create("files", FILES, ["source_path"], buckets)
        p.create("changes", CHANGES, ["scan", "source_path"], buckets)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, source_path, category (the first folder), modified and n_bytes of every ``*.md``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    named = found.select("path", relative_path(root).alias("source_path"), F.col("modificationTime").alias("modified"), F.col("length").alias("n_bytes"))
    return named.withColumn("category", F.split("source_path", "/")[0])


def contents(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (of ``listing``) with sha256 of the bytes and text."""
    reader = spark.read.format("binaryFile")
    some = [r["path"] for r in wanted.select("path").limit(BY_PATH + 1).collect()]
    if not some:
        return wanted.withColumns({"sha256": F.lit(""), "text": F.lit("")})
    if len(some) <= BY_PATH:
        read = reader.load([f"{p}" for p in some])
    else:
        read = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    read = read.select("path", F.sha2("content", 256).alias("sha256"), F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("text"))
    return wanted.join(read, "path")


def scan(store: SnapshotStore, root: str, number: int, stream: str = "tree") -> bool:
    """One scan; False if the ledger has its number."""
    if store.last_batch(stream) >= number:
        return False
    spark = store.spark
    with store.publish() as p:
        known = p.read("files")
        now = listing(spark, root)
        same = known.select("source_path", "modified", "n_bytes")
        read = contents(spark, root, now.join(same, ["source_path", "modified", "n_bytes"], "left_anti")).persist()
        gone = known.join(now.select("source_path"), "source_path", "left_anti").select("source_path", "sha256")
        before = known.select("source_path", F.col("sha256").alias("old_sha"))
        fresh = read.select("source_path", "sha256").join(before, "source_path", "left")
        # of several equal files that came and went, the n-th new path takes the n-th old one
        nth = lambda by: F.row_number().over(Window.partitionBy("sha256").orderBy(by))
        left = gone.withColumn("nth", nth("source_path")).withColumnRenamed("source_path", "old_path")
        came = fresh.filter("old_sha is null").select("source_path", "sha256").withColumn("nth", nth("source_path")).join(left, ["sha256", "nth"], "left")
        moved = came.filter("old_path is not null").select("old_path")
        told = came.select("source_path", F.when(F.col("old_path").isNull(), "added").otherwise("renamed").alias("change"), "old_path", "sha256")
        none = F.lit(None).cast("string").alias("old_path")
        told = told.unionByName(fresh.filter("old_sha <> sha256").select("source_path", F.lit("changed").alias("change"), none, "sha256"))
        lost = gone.join(moved.select(F.col("old_path").alias("source_path")), "source_path", "left_anti")
        told = told.unionByName(lost.select("source_path", F.lit("deleted").alias("change"), none, "sha256"))
        changes = told.withColumn("scan", F.lit(number).cast("long")).persist()
        p.upsert("changes", changes)
        p.upsert("files", read, gone)
        p.record_batch(stream, number)
    read.unpersist()
    changes.unpersist()
    return True


def folders(files: DataFrame) -> DataFrame:
    """The first folders as a dimension: category, n_files, n_bytes and the last change."""
    return files.groupBy("category").agg(F.count("*").alias("n_files"), F.sum("n_bytes").alias("n_bytes"), F.max("modified").alias("modified"))


def follow(store: SnapshotStore, root: str, checkpoint: str, every: str = "1 minute", stream: str = "tree") -> StreamingQuery:
    """Scans at every tick of a clock; batch n of the query is scan n."""
    clock = store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    step = lambda df, number: scan(store, root, number, stream)
    return clock.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
