"""Reproducible shuffle into shards by a Feistel permutation [native].

Rows get global numbers 0 .. n-1: buckets dealt by a hash of (id, checksum,
size), a row number within each bucket, and the running count of the buckets
before.  A Feistel network permutes the square of side ceil(sqrt(n)); a number
that leaves 0 .. n-1 walks on along its cycle until it is back inside, so the
result is a permutation of exactly the n rows.  Place p goes to shard p mod s
and slot p div s: shards' row counts are at most one apart (law ``rows``), slots
have no gaps, and both follow from a row's number, n and the seed alone.

A null text counts as empty.  Null and repeated ids are rows like any other;
rows alike in id, checksum and size are interchangeable.  Other columns have no
effect.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.llm.common import stage_table, utf8

PRIME = 2147483629  # the largest prime below 2**31 but two: squares fit in 63 bits


def round_keys(seed: int, rounds: int = 6) -> list[int]:
    keys, x = [], seed % PRIME
    for i in range(rounds):
        x = (x * 48271 + 12345 + i) % PRIME
        keys.append(x)
    return keys


def feistel_sql(x: str, side: int, seed: int) -> str:
    """SQL of one pass over the square 0 .. side*side-1."""
    keys = ", ".join(f"{k}L" for k in round_keys(seed))
    u = f"((s.r + k) % {PRIME}L)"
    mixed = f"(({u} * {u} % {PRIME}L + k) % {PRIME}L) * {u} % {PRIME}L"
    return (
        f"aggregate(array({keys}), named_struct('l', {x} div {side}L, 'r', {x} % {side}L), "
        f"(s, k) -> named_struct('l', s.r, 'r', (s.l + {mixed}) % {side}L), s -> s.l * {side}L + s.r)"
    )


def permuted_sql(x: str, n: int, seed: int) -> str:
    """SQL of the permuted place of number ``x`` among 0 .. n-1.  A walk outside
    has at most as many steps as the square has numbers beyond n."""
    side = max(1, math.isqrt(n - 1) + 1)
    first = feistel_sql(x, side, seed)
    beyond = side * side - n
    if not beyond:
        return first
    again = feistel_sql("p", side, seed)
    return (
        f"element_at(transform(array({first}), f -> if(f < {n}L, f, "
        f"aggregate(sequence(1, {beyond}), f, (p, i) -> if(p < {n}L, p, {again})))), 1)"
    )


def permute(x: int, n: int, seed: int) -> int:
    """The same place, computed for one number."""
    side = max(1, math.isqrt(n - 1) + 1)
    while True:
        left, right = divmod(x, side)
        for k in round_keys(seed):
            u = (right + k) % PRIME
            left, right = right, (left + (u * u % PRIME + k) % PRIME * u % PRIME) % side
        x = left * side + right
        if x < n:
            return x


def number_rows(df: DataFrame, keys: list[str], n: int, per_bucket: int = 200_000) -> DataFrame:
    """``row_number`` from 0, each row's own, in an order that only ``keys`` decide."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-n // per_bucket))))
    dealt = df.withColumn("bucket", bucket)
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    before = dealt.groupBy("bucket").count().select("bucket", F.coalesce(F.sum("count").over(running), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy(*keys))
    return dealt.withColumn("nth", within).join(before, "bucket").withColumn("row_number", F.col("before") + F.col("nth") - 1).drop("bucket", "nth", "before")


def assign_shards(df: DataFrame, n_shards: int = 24, seed: int = 20240607, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 8), text_crc32, row_number,
    place, law, shard, slot and grown_shard (null: the law is ``rows``)."""
    raw = utf8(text)
    sized = df.select(F.col(key).alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    sized = stage_table(df.sparkSession, sized, "shard-rows")
    n = sized.count()
    place = F.expr(permuted_sql("row_number", n, seed)) if n else F.col("row_number")
    return (
        number_rows(sized, ["doc_id", "text_crc32", "size"], n)
        .withColumn("place", place)
        .withColumns({
            "law": F.lit("rows"),
            "shard": (F.col("place") % n_shards).cast("int"),
            "slot": F.floor(F.col("place") / F.lit(n_shards)).cast("long"),
            "grown_shard": F.lit(None).cast("int"),
        })
    )


def write_shards(df: DataFrame, folder: str, n_shards: int = 24, seed: int = 20240607, key: str = "doc_id", text: str = "text") -> None:
    """The texts by shard, in slot order within each file."""
    raw = utf8(text)
    placed = assign_shards(df, n_shards, seed, key, text).select("doc_id", "size", "text_crc32", "shard", "slot")
    keys = ["doc_id", "size", "text_crc32", "nth_alike"]
    alike = F.row_number().over(Window.partitionBy("doc_id", "size", "text_crc32").orderBy("slot"))
    texts = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    texts = texts.withColumn("nth_alike", F.row_number().over(Window.partitionBy("doc_id", "size", "text_crc32").orderBy("text")))
    placed = placed.withColumn("nth_alike", alike).withColumnRenamed("doc_id", "placed_id")
    on = (placed["placed_id"].eqNullSafe(texts["doc_id"])) & (placed["size"] == texts["size"]) & (placed["text_crc32"] == texts["text_crc32"]) & (placed["nth_alike"] == texts["nth_alike"])
    joined = texts.join(placed, on).select(texts["doc_id"], texts["text"], placed["shard"], placed["slot"])
    joined.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
