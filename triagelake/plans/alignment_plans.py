"""Stores against their source, samples of both sides, totals and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.operators import alignment, quality
from triagelake.plans.registry import Registry
from triagelake.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.query


@query("""
    SELECT o_orderkey AS key, 'missing' AS state FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R') UNION ALL
    SELECT DISTINCT l_orderkey, 'extra' FROM lineitem WHERE l_returnflag <> 'R' AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)
""")
def store_range_diff(spark, d):
    """Orders against those that have lines which did not come back."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    lines = table(spark, d, "lineitem").filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("key")).distinct()
    return alignment.range_diff(orders, lines, "key")


@query("""
    SELECT o_custkey AS document_id, l_orderkey AS version_id, sha256('repair:b7:' || string_agg((l_orderkey * 10 + l_linenumber)::VARCHAR, ':' ORDER BY l_linenumber, l_orderkey)) AS idempotency_key,
           count(*) AS total_items
    FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R') JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
""")
def repair_by_version(spark, d):
    """Jobs for the lines that came back, by order."""
    lines = table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    owners = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("document_id"))
    chunks = lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).select("id", F.col("l_linenumber").alias("chunk_no"), "document_id", F.col("l_orderkey").alias("version_id")).distinct()
    return alignment.repair_by_version(lines.filter("l_returnflag = 'R'"), chunks, "b7").drop("part")


@query("""
    WITH k AS (SELECT key FROM (SELECT o_orderkey AS key FROM orders UNION SELECT l_orderkey FROM lineitem) ORDER BY sha256(key || ':42'), key LIMIT 200),
         p AS (SELECT key, count(l_orderkey) AS p, count(DISTINCT o_orderkey) AS r, count(*) FILTER (l_linestatus <> o_orderstatus) AS w
               FROM k LEFT JOIN lineitem ON l_orderkey = key LEFT JOIN orders ON o_orderkey = key GROUP BY key),
         t AS (SELECT 'points_to_rows' AS direction, CAST(sum(p) AS BIGINT) AS checked, CAST(coalesce(sum(p) FILTER (r = 0), 0) AS BIGINT) AS missing, CAST(sum(w) AS BIGINT) AS mismatched FROM p
               UNION ALL SELECT 'rows_to_points', count(*) FILTER (r > 0), count(*) FILTER (r > 0 AND p = 0), count(*) FILTER (w > 0) FROM p),
         q AS (SELECT *, (missing + mismatched) / checked::DOUBLE AS rate, checked::DOUBLE AS n FROM t)
    SELECT direction, checked, missing, mismatched, round(rate, 6) AS rate,
           round((rate + 3.8416 / (2 * n) - 1.96 * sqrt(rate * (1 - rate) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low,
           round((rate + 3.8416 / (2 * n) + 1.96 * sqrt(rate * (1 - rate) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM q
""")
def alignment_sample(spark, d):
    """Do lines have the status of their order, and orders such lines, by the same 200 orders."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    points = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linestatus").alias("status"))
    got = alignment.alignment(rows, points, "key", "status", k=200)
    return got.select("direction", "checked", "missing", "mismatched", *[F.round(c, 6).alias(c) for c in ("rate", "low", "high")])


@query("""
    WITH b AS (SELECT o_custkey AS k, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS ids FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
         a AS (SELECT o_custkey AS k, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS ids FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY ALL),
         m AS (SELECT b.ids AS x, a.ids AS y FROM b FULL JOIN a USING (k))
    SELECT count(*) AS pairs, count(*) FILTER (x[1] = y[1]) AS same_top, count(*) FILTER (list_has_any(x, y)) AS overlapping,
           count(*) FILTER ((x IS NULL) <> (y IS NULL)) AS changed, count(*) FILTER (x IS NULL AND y IS NULL) AS empty_in_both FROM m
""")
def baseline_totals(spark, d):
    """Each customer's orders in two orders and selections, compared."""
    o = table(spark, d, "orders")
    before = o.filter("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderdate").alias("pos"), F.col("o_orderkey").alias("cid"))
    after = o.filter("o_orderpriority <> '1-URGENT'").select("o_custkey", (-F.col("o_totalprice")).alias("pos"), F.col("o_orderkey").alias("cid"))
    return alignment.comparison_totals(quality.compare_snapshots(before, after, ["o_custkey"]))


@query("""
    WITH c AS (SELECT sha256(text) AS h, arg_max('HC-' || doc_id, doc_id) AS source_case_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY text),
         o AS (SELECT 'HC-' || doc_id AS source_case_id, 'wo-' || doc_id AS work_order_id FROM labels WHERE quality = 1)
    SELECT doc_id AS point_id, CASE WHEN work_order_id IS NOT NULL THEN c.source_case_id END AS source_case_id, work_order_id, work_order_id IS NOT NULL AS matched
    FROM documents d LEFT JOIN c ON sha256(d.text) = c.h LEFT JOIN o ON o.source_case_id = c.source_case_id
""")
def hash_link_chain(spark, d):
    """Documents by the hash of their text to a labelled one, and from there to its order."""
    docs, labels = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels")
    case = F.concat(F.lit("HC-"), F.col("doc_id").cast("string"))
    cases = docs.join(labels.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("place"), F.sha2("text", 256).alias("body_sha256"), case.alias("source_case_id"))
    orders = labels.filter("quality = 1").select(case.alias("source_case_id"), F.concat(F.lit("wo-"), F.col("doc_id").cast("string")).alias("work_order_id"))
    return alignment.linked_points(docs.select(F.col("doc_id").alias("point_id"), F.col("text").alias("content")), cases, orders).drop("content")


@query("SELECT format('{:08d}.md', doc_id) AS source_path, sha256(text) AS sha256 FROM documents ORDER BY source_path LIMIT 25")
def first_files(spark, d):
    files = table(spark, d, "documents").select(F.format_string("%08d.md", "doc_id").alias("source_path"), F.sha2("text", 256).alias("sha256"))
    return alignment.first_files(files, 25)
