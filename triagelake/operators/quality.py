"""Batch data quality: case files, name matching, duplicates, reports, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.text import squeeze, strip
from triagelake.operators import multi_match

# Fixed value: what garbled text looks like.
GARBLED = "[ꎬ�]|锟斤拷|烫烫烫"


def field(body: Column, name: str) -> Column:
    """The value of the last 【name】 block, without rule lines at its end."""
    blocks = F.regexp_extract_all(body, F.lit(rf"【\s*{name}\s*】\s*\n([\s\S]*?)(?=\n\s*【|\z)"), F.lit(1))
    lines = F.transform(F.split(strip(F.coalesce(F.get(F.reverse(blocks), 0), F.lit(""))), "\n"), strip)
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"(?:(?:^|\n)[-—–_]+)+\z", ""))


def parse_cases(files: DataFrame) -> DataFrame:
    """files: source_path, text.  A row for each case file: its fields, ids from its
    name and hashes, and the issues found, in a fixed order."""
    name = F.substring_index("source_path", "/", -1)
    folder = F.regexp_replace(F.element_at(F.split("source_path", "/"), -2), "__拆分", "")
    pattern = r"^(\d{5})_(.+)__([0-9a-f]{10})\.md$"
    body = strip(F.substr("text", F.locate("\n## ", F.col("text")) + 1))
    df = files.filter(name.rlike(pattern) & F.col("text").contains("\n## ")).withColumns({
        "request_type": folder,
        "seq": F.regexp_extract(name, pattern, 1).cast("int"),
        "_title": F.regexp_extract(name, pattern, 2),
        "_hash": F.regexp_extract(name, pattern, 3),
        "full_body": body,
        "file_sha256": F.sha2(F.encode("text", "UTF-8"), 256),
    })
    b = F.col("full_body")
    df = df.withColumns({
        "_type": field(b, "诉求类型"), "_time": field(b, "留言时间"),
        "content": field(b, "事项内容"), "actual_department_raw": F.nullif(field(b, "实际承办单位"), F.lit("")),
        "_heading": strip(F.regexp_extract(b, r"\A## ([^\n]*)\n", 1)),
        "body_sha256": F.sha2(F.encode(b, "UTF-8"), 256),
    })
    found = F.regexp_extract("_time", r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(?::\d{2})?", 0)
    at = F.coalesce(F.try_to_timestamp(found, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(found, F.lit("yyyy-MM-dd HH:mm")))
    df = df.withColumn("event_time", F.when(found != "", at))
    issue = F.array_compact(F.array(
        F.when((F.col("_type") != "") & (F.col("_type") != F.col("request_type")), F.concat(F.lit("request_type mismatch: folder="), "request_type", F.lit(" field="), "_type")),
        F.when((found != "") & at.isNull(), F.concat(F.lit("unparsable message time: '"), "_time", F.lit("'"))),
        F.when((found == "") & (F.col("_time") != ""), F.concat(F.lit("missing/odd message time text: '"), F.left("_time", F.lit(50)), F.lit("'"))),
        F.when(F.col("content") == "", "empty 事项内容"),
        F.when(F.length("content") > 50000, "事项内容 too long"),
        F.when(F.col("actual_department_raw").isNull(), "missing 实际承办单位"),
        F.when(F.length("_title") > 300, "title exceeds 300 chars"),
        F.when(~F.col("file_sha256").startswith(F.col("_hash")), F.concat(F.lit("file name hash mismatch: name="), "_hash", F.lit(" sha256="), F.left("file_sha256", F.lit(10)))),
    ))
    return df.select(
        "source_path", "request_type", "seq", F.coalesce(F.nullif("_heading", F.lit("")), "_title").alias("title"),
        F.concat(F.lit("HC-"), "request_type", F.lit("-"), "_hash").alias("source_case_id"),
        "content", "event_time", "actual_department_raw", "full_body", "file_sha256", "body_sha256", issue.alias("issues"),
    )


def tiered_match(df: DataFrame, raw: str, names: DataFrame, rewrites: list[Column]) -> DataFrame:
    """names: name, id.  Adds ``matched_id``: of the name without white space, else of
    the first of ``rewrites`` (expressions of ``_norm``; null: not tried) that is known."""
    out = df.withColumn("_norm", F.nullif(squeeze(F.coalesce(F.col(raw), F.lit(""))), F.lit("")))
    tiers = [F.col("_norm"), *rewrites]
    for i, expression in enumerate(tiers):
        side = names.select(F.col("name").alias(f"_n{i}"), F.col("id").alias(f"_m{i}"))
        out = out.withColumn(f"_t{i}", expression).join(side, F.col(f"_t{i}") == F.col(f"_n{i}"), "left")
    drop = ["_norm", *[f"_{x}{i}" for i in range(len(tiers)) for x in "tnm"]]
    return out.withColumn("matched_id", F.coalesce(*[f"_m{i}" for i in range(len(tiers))])).drop(*drop)


def department_rewrites() -> list[Column]:
    norm = F.col("_norm")
    street = F.regexp_extract(norm, r"^(?:广州市)?白云区人民政府?[-—](.+)$", 1)
    return [
        F.when(norm.startswith("广州市"), F.substr(norm, F.lit(4))),
        F.when(street != "", F.concat(F.lit("广州市白云区人民政府-"), street)),
    ]


def duplicates(df: DataFrame, key: Column, order: Column) -> DataFrame:
    """k, n and the first row's order value of every key that occurs more than once."""
    return df.groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1")


def containment_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """left: lid, lname; right: rid, rname.  For each left name the right one that
    equals it, contains it or lies in it: equal first, then the longest, then by
    name and id.  Both ways by automata, so each name is read once for each part of
    the others, and short names are no hot keys."""
    left, right = left.filter(F.length("lname") > 0), right.filter(F.length("rname") > 0)
    texts, names = left.select(F.col("lid").alias("tid"), F.col("lname").alias("tname")), right.select(F.col("rid").alias("pid"), F.col("rname").alias("pname"))
    inside = multi_match.longest_pattern(texts, names).select(F.col("tid").alias("lid"), F.col("pid").alias("rid"), F.col("pname").alias("rname"))
    texts, names = right.select(F.col("rid").alias("tid"), F.col("rname").alias("tname")), left.select(F.col("lid").alias("pid"), F.col("lname").alias("pname"))
    around = multi_match.longest_text(names, texts).select(F.col("pid").alias("lid"), F.col("tid").alias("rid"), F.col("tname").alias("rname"))
    # the equal one need not be the longest: it is joined by itself
    same = left.join(right, F.col("lname") == F.col("rname")).groupBy("lid").agg(F.min(F.struct("rname", "rid")).alias("m")).select("lid", F.col("m.rid").alias("rid"), F.col("m.rname").alias("rname"))
    pairs = inside.withColumn("e", F.lit(True)).unionByName(around.withColumn("e", F.lit(True))).unionByName(same.withColumn("e", F.lit(False)))
    order = F.struct("e", (-F.length("rname")).alias("n"), "rname", "rid")
    best = pairs.groupBy("lid").agg(F.min(order).alias("m"))
    return best.select("lid", F.col("m.rid").alias("rid"), F.col("m.rname").alias("rname"), (~F.col("m.e")).alias("is_exact"))


def compare_snapshots(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Both: keys, pos, cid.  For each key: same_top, overlaps, was_empty, is_empty."""
    def side(df: DataFrame, x: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.array_compact(F.collect_set("cid")).alias(f"ids_{x}"), F.min(F.when(F.col("cid").isNotNull(), F.struct("pos", "cid"))).alias(f"top_{x}"))

    both = side(before, "a").join(side(after, "b"), keys, "full")
    empty = F.array().cast("array<bigint>")
    a, b = F.coalesce("ids_a", empty), F.coalesce("ids_b", empty)
    return both.select(
        *keys, F.coalesce(F.col("top_a.cid") == F.col("top_b.cid"), F.lit(False)).alias("same_top"),
        F.arrays_overlap(a, b).alias("overlaps"), (F.size(a) == 0).alias("was_empty"), (F.size(b) == 0).alias("is_empty"),
    )


def consistency(expected: DataFrame, vectors: DataFrame, lexical: DataFrame, key: str) -> DataFrame:
    """key and state: what each store lacks or has beyond the expected keys."""
    def only(a: DataFrame, b: DataFrame, state: str) -> DataFrame:
        return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("state", F.lit(state))

    return (
        only(expected, vectors, "missing_vector").unionByName(only(vectors, expected, "extra_vector"))
        .unionByName(only(expected, lexical, "missing_lexical")).unionByName(only(lexical, expected, "extra_lexical"))
    )


def repair_jobs(missing: DataFrame, by: list[str], key: str, batch: str, ids_a_job: int = 1000) -> DataFrame:
    """Jobs over the groups' missing keys, each of one range of ``ids_a_job`` keys (so
    none is unbounded), with an idempotency key from them; key: a number."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_set(key)), lambda x: x.cast("string")), ",")
    ranged = missing.withColumn("first_key", F.floor(F.col(key) / F.lit(ids_a_job)) * ids_a_job)
    jobs = ranged.groupBy(*by, "first_key").agg(ids.alias("_ids"), F.countDistinct(key).alias("n_items"))
    return jobs.withColumn("idempotency_key", F.sha2(F.concat(F.lit(f"repair:{batch}:"), "_ids"), 256)).drop("_ids")
