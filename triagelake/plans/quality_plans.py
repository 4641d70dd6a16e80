"""Duplicates, matching, reports, consistency and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.operators import masters, quality
from triagelake.plans.registry import Registry
from triagelake.sources.tables import changed_files, table

REGISTRY = Registry()
query = REGISTRY.query


@query("SELECT sha256(text) AS k, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return quality.duplicates(table(spark, d, "documents"), F.sha2("text", 256), F.col("doc_id"))


@query("""
    WITH u AS (SELECT sha256(text) AS h, min(doc_id) AS doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY text HAVING count(*) = 1)
    SELECT d.doc_id, u.doc_id AS matched_id FROM documents d LEFT JOIN u ON sha256(d.text) = u.h
""")
def unique_hash_match(spark, d):
    """Every document to the labelled one with its hash, only where it is the only one."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    labelled = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    unique = labelled.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("matched_id")).filter("n = 1")
    return docs.join(unique, "h", "left").select("doc_id", "matched_id")


@query("""
    SELECT c_custkey, coalesce(a.n_nationkey, b.n_nationkey, e.n_nationkey) AS matched_id
    FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' NATION' || '_' || (c_custkey % 30) WHEN 1 THEN 'X-NATION_' || (c_custkey % 30) WHEN 2 THEN 'nation_' || (c_custkey % 30) ELSE '' END AS raw FROM customer) c
    LEFT JOIN nation a ON a.n_name = nullif(replace(raw, ' ', ''), '')
    LEFT JOIN nation b ON starts_with(replace(raw, ' ', ''), 'X-') AND b.n_name = substr(replace(raw, ' ', ''), 3)
    LEFT JOIN nation e ON regexp_matches(raw, '^[a-z]+_[0-9]+$') AND e.n_name = upper(raw)
""")
def tiered_name_match(spark, d):
    """Exact, then without a prefix, then rewritten."""
    n = (F.col("c_custkey") % 30).cast("string")
    kind = F.col("c_custkey") % 4
    raw = F.when(kind == 0, F.concat(F.lit(" NATION_"), n)).when(kind == 1, F.concat(F.lit("X-NATION_"), n)).when(kind == 2, F.concat(F.lit("nation_"), n)).otherwise("")
    names = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))
    norm = F.col("_norm")
    rewrites = [F.when(norm.startswith("X-"), F.substr(norm, F.lit(3))), F.when(norm.rlike("^[a-z]+_[0-9]+$"), F.upper(norm))]
    got = quality.tiered_match(table(spark, d, "customer").select("c_custkey", raw.alias("raw")), "raw", names, rewrites)
    return got.select("c_custkey", "matched_id")


@query("""
    WITH l AS (SELECT p_partkey AS lid, p_name AS lname FROM part), r AS (SELECT DISTINCT lower(p_type) AS rname FROM part UNION SELECT DISTINCT lower(p_brand) FROM part UNION SELECT lower(s_name) FROM supplier),
         m AS (SELECT lid, lname, rname FROM l JOIN r ON contains(lname, rname) OR contains(rname, lname))
    SELECT lid, arg_min(rname, (rname <> lname, -length(rname), rname)) AS rname FROM m GROUP BY lid
""")
def containment_match(spark, d):
    """All part names against all types, brands and suppliers' names."""
    p = table(spark, d, "part")
    left = p.select(F.col("p_partkey").alias("lid"), F.col("p_name").alias("lname"))
    names = p.select(F.lower("p_type")).union(p.select(F.lower("p_brand"))).union(table(spark, d, "supplier").select(F.lower("s_name"))).distinct().toDF("rname")
    got = quality.containment_match(left, names.withColumn("rid", F.col("rname")))
    return got.select("lid", "rname")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def type_counts_topn(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("""
    SELECT count(*) AS parsed, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, CAST(sum(n_chars) AS BIGINT) AS chars,
           count(*) FILTER (l.doc_id IS NOT NULL) AS mapped, count(*) FILTER (l.doc_id IS NULL) AS unmapped,
           string_agg(DISTINCT lang, ',' ORDER BY lang) AS lang_list FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)
""")
def import_report(spark, d):
    known = table(spark, d, "labels").select("doc_id").distinct().withColumn("hit", F.lit(True))
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").join(known, "doc_id", "left")
    return docs.agg(
        F.count("*").alias("parsed"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"), F.sum("n_chars").alias("chars"),
        F.count_if(F.col("hit").isNotNull()).alias("mapped"), F.count_if(F.col("hit").isNull()).alias("unmapped"),
        F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("lang_list"))


@query("SELECT event_type, min(ts) AS first_at, max(ts) AS last_at, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def event_time_range(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.countDistinct("user_id").alias("users"))


@query("""
    SELECT lang, count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(CASE WHEN length(text) = 0 THEN 0 ELSE ceil(greatest(length(text) - 120, 1) / 780.0::DOUBLE) END) AS BIGINT) AS chunks,
           count(*) FILTER (regexp_matches(text, '[ꎬ\\x{FFFD}]|锟斤拷|烫烫烫')) AS garbled, count(*) FILTER (length(trim(text)) = 0) AS empty
    FROM documents GROUP BY lang
""")
def quality_report(spark, d):
    n = F.length("text")
    chunks = F.when(n == 0, 0).otherwise(F.ceil(F.greatest(n - 120, F.lit(1)) / F.lit(780.0)))
    return table(spark, d, "documents").groupBy("lang").agg(
        F.count("*").alias("files"), F.sum(n).alias("chars"), F.sum(chunks).alias("chunks"),
        F.count_if(F.col("text").rlike(quality.GARBLED)).alias("garbled"), F.count_if(F.length(F.trim("text")) == 0).alias("empty"))


@query("""
    WITH e AS (SELECT doc_id FROM documents WHERE lang <> 'es'), v AS (SELECT doc_id FROM labels), x AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)
    SELECT doc_id, 'missing_vector' AS state FROM e WHERE doc_id NOT IN (SELECT doc_id FROM v) UNION ALL
    SELECT doc_id, 'extra_vector' FROM v WHERE doc_id NOT IN (SELECT doc_id FROM e) UNION ALL
    SELECT doc_id, 'missing_lexical' FROM e WHERE doc_id NOT IN (SELECT doc_id FROM x) UNION ALL
    SELECT doc_id, 'extra_lexical' FROM x WHERE doc_id NOT IN (SELECT doc_id FROM e)
""")
def consistency_diff(spark, d):
    docs = table(spark, d, "documents")
    return quality.consistency(docs.filter("lang <> 'es'"), table(spark, d, "labels"), docs.filter("doc_id % 3 <> 0"), "doc_id")


@query("""
    SELECT source, CAST(floor(doc_id / 1000) * 1000 AS BIGINT) AS first_key, sha256('repair:b1:' || string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS idempotency_key, count(*) AS n_items
    FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL
""")
def repair_jobs(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").select("doc_id")
    jobs = quality.repair_jobs(docs.join(labels, "doc_id", "left_anti"), ["source"], "doc_id", "b1")
    return jobs.select("source", "first_key", "idempotency_key", "n_items")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 OR lang = 'fr'")
def incremental_skip(spark, d):
    """Files whose hash the manifest has as indexed are skipped; failed ones are not."""
    files = table(spark, d, "documents").select("doc_id", "lang", F.format_string("%d.md", "doc_id").alias("source_path"), F.sha2("text", 256).alias("sha256"))
    status = F.when(F.col("lang") == "fr", "failed").otherwise("indexed")
    manifest = files.filter("doc_id % 3 = 0").select("source_path", "sha256", status.alias("status"))
    return changed_files(files, manifest).select("doc_id")


@query("""
    SELECT source, count(*) AS total, count(l.doc_id) AS matched, round(count(l.doc_id) / CAST(count(*) AS DOUBLE), 6) AS coverage,
           bool_and(l.quality IS NULL OR l.quality = 1) AS all_good
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source
""")
def coverage_ratio(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "quality", F.lit(1).alias("hit"))
    rows = table(spark, d, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    return rows.groupBy("source").agg(
        F.count("*").alias("total"), F.count("hit").alias("matched"), F.round(F.count("hit") / F.count("*"), 6).alias("coverage"),
        F.bool_and(F.col("quality").isNull() | (F.col("quality") == 1)).alias("all_good"))


@query("""
    WITH a AS (SELECT s_suppkey, s_name, s_nationkey FROM supplier), m AS (SELECT n_name || '-' || s_name AS name, 'supplier' AS src FROM a JOIN nation ON n_nationkey = s_nationkey
         UNION ALL SELECT n_name || '-' || c_name, 'customer' FROM customer JOIN nation ON n_nationkey = c_nationkey
         UNION ALL SELECT n_name, 'nation' FROM nation UNION ALL SELECT n_name, 'master' FROM nation)
    SELECT name, string_agg(DISTINCT src, ',' ORDER BY src) AS sources FROM m GROUP BY name
""")
def department_master(spark, d):
    """Names from several sources, each with its sorted distinct sources."""
    n = table(spark, d, "nation")
    s = table(spark, d, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(F.concat_ws("-", "n_name", "s_name").alias("name"), F.lit("supplier").alias("src"))
    c = table(spark, d, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.concat_ws("-", "n_name", "c_name"), F.lit("customer"))
    rows = s.union(c).union(n.select("n_name", F.lit("nation"))).union(n.select("n_name", F.lit("master")))
    return rows.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("sources"))


@query("""
    WITH n AS (SELECT doc_id, source || ['__拆分', '_行政处罚', '_行政许可__拆分', '_行政检查_行政确认', '', '_x'][doc_id % 6 + 1] AS name FROM documents)
    SELECT doc_id, regexp_replace(name, '(__拆分|_行政处罚|_行政许可|_行政强制|_行政检查|_行政确认|_行政裁决|_其他行政权力)$', '') AS one,
           regexp_replace(regexp_replace(name, '__拆分$', ''), '(__拆分|_行政处罚|_行政许可|_行政强制|_行政检查|_行政确认|_行政裁决|_其他行政权力)$', '') AS nested
    FROM n
""")
def suffix_strip(spark, d):
    """Names of assets by both rules: one ending off, or the outer one and then another."""
    endings = F.array(*[F.lit(x) for x in ("__拆分", "_行政处罚", "_行政许可__拆分", "_行政检查_行政确认", "", "_x")])
    named = table(spark, d, "documents").select("doc_id", F.concat("source", F.get(endings, (F.col("doc_id") % 6).cast("int"))).alias("name"))
    return named.select("doc_id", masters.without_one(F.col("name")).alias("one"), masters.without_nested(F.col("name")).alias("nested"))
