"""Tables, Markdown trees and manifests as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relative_path(root: str) -> Column:
    """``path`` of the binary file source below ``root``, without its escapes."""
    base = root.rstrip("/").split("://")[-1] + "/"
    relative = F.regexp_replace(F.substring_index("path", base, -1), "^/+", "")
    return F.url_decode(F.replace(relative, F.lit("+"), F.lit("%2B")))


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """source_path (relative), category (first folder), sha256 of the raw bytes,
    n_bytes and text (UTF-8, without a byte order mark) of every ``*.md`` below root."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    )
    return files.select(
        relative_path(root).alias("source_path"),
        F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("n_bytes"),
        F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("text"),
    ).withColumn("category", F.split("source_path", "/")[0])


def in_categories(files: DataFrame, categories: list[str] | None) -> DataFrame:
    return files if not categories else files.filter(F.col("category").isin(categories))


def smallest_per_category(files: DataFrame, least_bytes: int = 300) -> DataFrame:
    """The smallest file of each category with that many bytes, ties to the first path."""
    w = Window.partitionBy("category").orderBy("n_bytes", "source_path")
    return files.filter(F.col("n_bytes") >= least_bytes).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose (path, hash) the manifest does not have as indexed."""
    done = manifest.filter("status = 'indexed'").select("source_path", "sha256")
    return files.join(done, ["source_path", "sha256"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows replace ``old`` ones with the same keys (null-safe)."""
    n = new.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return old.join(n, condition, "left_anti").unionByName(new, allowMissingColumns=True)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
