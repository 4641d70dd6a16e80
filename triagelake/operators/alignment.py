"""Stores held against their source: differences by ranges, repair by version, samples of
both sides, totals of a comparison, chained links, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# ---- differences by ranges of key hashes ---------------------------------------

def leaf_of(key: str, leaves: int) -> Column:
    """The range of a key's hash, 0 .. leaves - 1; a null key has one, too."""
    return F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(leaves)).cast("int")


def range_digests(keys: DataFrame, key: str, leaves: int = 4096) -> DataFrame:
    """leaf, n, XOR and sum of key hashes (a XOR alone forgets keys that occur twice): at most ``leaves`` rows, combined before the
    shuffle.  A store may keep them: rows that come or go change one row each."""
    return keys.groupBy(leaf_of(key, leaves).alias("leaf")).agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64(F.col(key))).alias("a"), F.sum(F.xxhash64(F.lit(11), F.col(key)).cast("decimal(20,0)")).alias("b"))


def differing_leaves(one: DataFrame, other: DataFrame) -> DataFrame:
    """leaf of the ranges whose digests are not alike, and those that one side lacks."""
    o = other.select("leaf", *[F.col(c).alias(f"_{c}") for c in ("n", "a", "b")])
    alike = F.col("n").eqNullSafe(F.col("_n")) & F.col("a").eqNullSafe(F.col("_a")) & F.col("b").eqNullSafe(F.col("_b"))
    return one.join(o, "leaf", "full").filter(~alike).select("leaf")


def range_diff(expected: DataFrame, actual: DataFrame, key: str, leaves: int = 4096, digests: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """key and state (``missing``: only expected, ``extra``: only actual).

    Only keys in ranges with different digests are shuffled and compared; equal stores
    shuffle digests alone.  Sets of keys are compared: where only one side repeats keys, a range is
    read in vain.  A difference is overlooked where n, XOR and sum of 64-bit hashes all agree by
    chance.  ``digests``: those that the stores keep, in place of reading all keys."""
    a, b = digests or (range_digests(expected, key, leaves), range_digests(actual, key, leaves))
    ranges = F.broadcast(differing_leaves(a, b))  # at most ``leaves`` rows
    seen = [side.select(key).withColumn("leaf", leaf_of(key, leaves)).join(ranges, "leaf", "left_semi").select(key, F.lit(bit).alias("side"))
            for side, bit in ((expected, 1), (actual, 2))]
    sides = seen[0].unionByName(seen[1]).groupBy(key).agg(F.bit_or("side").alias("side"))
    return sides.filter("side < 3").select(key, F.when(F.col("side") == 1, "missing").otherwise("extra").alias("state"))


def repair_by_version(missing: DataFrame, chunks: DataFrame, batch: str | None = None, items_a_job: int = 10_000) -> DataFrame:
    """missing: id; chunks: id, chunk_no, document_id, version_id.  Jobs of each version's
    missing chunks by chunk_no: document_id, version_id, part, idempotency_key, total_items.

    A version of more than ``items_a_job`` of them has several jobs (part 0, 1, ...), so no
    job's list is unbounded; ids that no chunk has give none."""
    found = chunks.select("id", "chunk_no", "document_id", "version_id").join(missing.select("id").distinct(), "id", "left_semi")
    nth = F.row_number().over(Window.partitionBy("version_id").orderBy("chunk_no", "id"))
    parted = found.withColumn("nth", nth).withColumn("part", F.floor((F.col("nth") - 1) / F.lit(items_a_job)))
    listed = F.array_sort(F.collect_list(F.struct("nth", F.col("id").cast("string").alias("id"))))
    jobs = parted.groupBy("document_id", "version_id", "part").agg(listed.alias("_ids"))
    name = F.concat(F.lit(f"repair:{batch or 'default'}:"), F.array_join(F.transform("_ids", lambda x: x["id"]), ":"))
    return jobs.select("document_id", "version_id", "part", F.sha2(name, 256).alias("idempotency_key"), F.size("_ids").cast("long").alias("total_items"))


# ---- samples of both sides -----------------------------------------------------

def sampled_keys(sides: list[DataFrame], key: str, k: int, seed: str = "42") -> DataFrame:
    """The k distinct non-null keys of all sides with the smallest hashes: every side asked with
    one seed samples the same keys."""
    names = [s.select(F.col(key).alias("_key")).filter("_key is not null").distinct() for s in sides]
    every = names[0]
    for n in names[1:]:
        every = every.unionByName(n)
    hashed = F.sha2(F.concat(F.col("_key").cast("string"), F.lit(":" + seed)), 256)
    return every.distinct().orderBy(hashed, "_key").limit(k)


def wilson(bad: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a rate of which a sample of n saw ``bad``; 0 and 1 where n is 0."""
    p, zz = bad / n, z * z
    middle, width = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return (
        F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (middle - width) / (1 + zz / n))),
        F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), (middle + width) / (1 + zz / n))),
    )


def alignment(rows: DataFrame, points: DataFrame, key: str, value: str, k: int = 200, seed: str = "42") -> DataFrame:
    """rows: one for each key; points: any number.  Of the same sampled keys, both ways:
    direction, checked, missing (the other side has no such key), mismatched (another
    value: of a row, any of its points), rate of both with its bounds.

    ``points_to_rows`` counts points, ``rows_to_points`` rows.  Values are compared
    null-safe.  A side without sampled keys has 0 checked and the bounds 0 and 1."""
    keys = F.broadcast(sampled_keys([rows, points], key, k, seed))  # k rows
    r = rows.select(F.col(key).alias("_key"), F.col(value).alias("_row")).join(keys, "_key", "left_semi").withColumn("_r", F.lit(1))
    p = points.select(F.col(key).alias("_key"), F.col(value).alias("_point")).join(keys, "_key", "left_semi")
    both = p.withColumn("_p", F.lit(1)).join(r, "_key", "full")
    wrong = F.col("_p").isNotNull() & F.col("_r").isNotNull() & ~F.col("_row").eqNullSafe(F.col("_point"))
    a_key = both.groupBy("_key").agg(F.count("_r").alias("r"), F.count("_p").alias("p"), F.count_if(wrong).alias("w"))
    sums = a_key.agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("c1"), F.coalesce(F.sum(F.when(F.col("r") == 0, F.col("p"))), F.lit(0)).alias("m1"), F.coalesce(F.sum("w"), F.lit(0)).alias("w1"),
        F.count_if(F.col("r") > 0).alias("c2"), F.count_if((F.col("r") > 0) & (F.col("p") == 0)).alias("m2"), F.count_if(F.col("w") > 0).alias("w2"))
    ways = F.array(*[
        F.struct(F.lit(name).alias("direction"), F.col(f"c{i}").alias("checked"), F.col(f"m{i}").alias("missing"), F.col(f"w{i}").alias("mismatched"))
        for i, name in ((1, "points_to_rows"), (2, "rows_to_points"))])
    out = sums.select(F.inline(ways))
    bad = F.col("missing") + F.col("mismatched")
    low, high = wilson(bad.cast("double"), F.nullif("checked", F.lit(0)).cast("double"))
    return out.withColumns({
        "rate": F.when(F.col("checked") > 0, bad / F.col("checked")), "low": F.coalesce(low, F.lit(0.0)), "high": F.coalesce(high, F.lit(1.0))})


# ---- comparison totals, links, files, reports ------------------------------------

def comparison_totals(compared: DataFrame) -> DataFrame:
    """compared: as ``quality.compare_snapshots`` returns.  One row of totals."""
    both_empty = F.col("was_empty") & F.col("is_empty")
    return compared.agg(
        F.count("*").alias("pairs"), F.count_if(F.col("same_top")).alias("same_top"), F.count_if(F.col("overlaps")).alias("overlapping"),
        F.count_if(F.col("was_empty") != F.col("is_empty")).alias("changed"), F.count_if(both_empty).alias("empty_in_both"))


def linked_points(points: DataFrame, cases: DataFrame, orders: DataFrame) -> DataFrame:
    """points: point_id, content; cases: place, body_sha256, source_case_id (of one hash the
    last place counts); orders: source_case_id, work_order_id (one each).  Adds to each
    point the case of its content's hash, that case's order, and ``matched``: both are
    there (an empty id is none; unmatched points have neither)."""
    by_hash = cases.groupBy("body_sha256").agg(F.max_by("source_case_id", "place").alias("_case"))
    known = orders.filter("source_case_id is not null").select(F.col("source_case_id").alias("_case"), F.col("work_order_id").alias("_order"))
    sha = F.sha2(F.encode(F.coalesce("content", F.lit("")), "UTF-8"), 256)
    joined = points.withColumn("_sha", sha).join(by_hash, F.col("_sha") == F.col("body_sha256"), "left").join(known, "_case", "left")
    matched = F.coalesce((F.col("_case") != "") & (F.col("_order").cast("string") != ""), F.lit(False))
    return joined.select(
        *points.columns, F.when(matched, F.col("_case")).alias("source_case_id"), F.when(matched, F.col("_order")).alias("work_order_id"), matched.alias("matched"))


def first_files(files: DataFrame, n: int | None) -> DataFrame:
    """All files in the order of their paths, or the first n (0 and None: no limit)."""
    ordered = files.orderBy("source_path")
    return ordered.limit(n) if n else ordered


def known_or_error(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``asked`` as it is; an error names a key that is not in ``known``.  Of no keys, none."""
    k = known.select(F.col(key).alias("_known")).distinct()
    looked = asked.join(k, F.col(key) == F.col("_known"), "left")
    unknown = F.raise_error(F.concat(F.lit("unknown id: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return looked.withColumn(key, F.when(F.col("_known").isNotNull(), F.col(key)).otherwise(unknown.cast(asked.schema[key].dataType))).select(asked.columns)


def write_report(report: DataFrame, path: str) -> None:
    """The rows of a report (a bounded table: totals, sample lists) as JSON lines in one file,
    nulls kept, text as it is."""
    report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)
