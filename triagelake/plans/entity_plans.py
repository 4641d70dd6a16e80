"""Listing, history, visibility and lifecycle queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from triagelake.operators import entities, lifecycle
from triagelake.plans.registry import Registry
from triagelake.sources.tables import latest, table, upsert

REGISTRY = Registry()
query = REGISTRY.query


@query("""
    SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate,
           (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT') AS total
    FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT'
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20
""")
def list_orders_page(spark, d):
    """Second page of filtered orders, newest first, with the filter's total."""
    rows = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "P", "deleted").otherwise(F.col("o_orderstatus")))
    rows = entities.equals(entities.visible(rows), o_orderpriority="1-URGENT", o_clerk=None)
    total = rows.agg(F.count("*").alias("total"))
    got = entities.page(rows, [F.desc("o_orderdate"), F.col("o_orderkey")], 2, 20)
    return got.crossJoin(F.broadcast(total)).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "total")  # total: one row


@query("SELECT doc_id, source FROM documents WHERE text ILIKE '%th_ther%' OR source ILIKE '%th_ther%'")
def keyword_search(spark, d):
    return entities.keyword(table(spark, d, "documents"), "th_ther", ["text", "source"]).select("doc_id", "source")


@query("""
    SELECT o_custkey, o_orderkey, CAST(rn AS BIGINT) AS rn FROM (
        SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders
    ) WHERE rn <= 3
""")
def history_latest_per_customer(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    rows = table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).filter("rn <= 3")
    return rows.select("o_custkey", "o_orderkey", F.col("rn").cast("long"))


@query("""
    SELECT conv_id, count(*) AS n_turns, string_agg(role || ':' || length(text), ',' ORDER BY turn, role, text) AS thread
    FROM conversations GROUP BY conv_id
""")
def conversation_thread(spark, d):
    part = F.struct("turn", "role", "text")
    rows = F.array_sort(F.collect_list(part))
    joined = F.array_join(F.transform(rows, lambda r: F.concat(r["role"], F.lit(":"), F.length(r["text"]).cast("string"))), ",")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), joined.alias("thread"))


@query("""
    SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'deleted' ELSE 'new' END AS status
    FROM documents d LEFT JOIN labels l USING (doc_id) WHERE CASE WHEN l.toxic = 1 THEN 'deleted' ELSE 'new' END <> 'deleted'
""")
def soft_delete_view(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit("new").alias("status"))
    gone = table(spark, d, "labels").filter("toxic = 1").select("doc_id")
    return entities.visible(entities.soft_delete(docs, gone, "doc_id"))


@query("""
    SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l USING (doc_id)
    WHERE d.lang = 'en' AND (l.quality = 0) IS DISTINCT FROM TRUE AND (l.toxic = 1) IS DISTINCT FROM TRUE
""")
def metadata_filter_nullsafe(spark, d):
    from triagelake.operators.retrieval import searchable

    flags = table(spark, d, "labels").select("doc_id", (F.col("quality") != 0).alias("active"), (F.col("toxic") == 1).alias("document_header"))
    docs = table(spark, d, "documents").filter("lang = 'en'").select("doc_id", "lang")
    return docs.join(flags, "doc_id", "left").filter(searchable()).select("doc_id", "lang")


@query("""
    SELECT o.o_orderkey, coalesce(c.c_name, '') AS customer, coalesce(n.n_name, '') AS nation, coalesce(r.r_name, '') AS region
    FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
    WHERE o.o_orderstatus = 'P'
""")
def three_way_left_enrich(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'P'")
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return (
        o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
        .select("o_orderkey", *[F.coalesce(a, F.lit("")).alias(b) for a, b in (("c_name", "customer"), ("n_name", "nation"), ("r_name", "region"))])
    )


@query("""
    WITH v AS (SELECT o_orderkey AS id, o_custkey AS document_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_no FROM orders),
         cur AS (SELECT document_id, max(version_no) AS current_version_no FROM v GROUP BY 1)
    SELECT v.document_id, v.id AS version_id, l.l_linenumber FROM v JOIN cur USING (document_id) JOIN lineitem l ON l.l_orderkey = v.id
    WHERE cur.current_version_no = v.version_no
""")
def current_version_join(spark, d):
    """Chunks (line items) of each document's (customer's) current version (order)."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    versions = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), F.row_number().over(w).alias("version_no"))
    documents = versions.groupBy(F.col("document_id").alias("id")).agg(F.max("version_no").alias("current_version_no"), F.lit("").alias("title"))
    chunks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_version_id"), "l_linenumber")
    got = lifecycle.visible_chunks(chunks, versions, documents)
    return got.select("document_id", F.col("document_version_id").alias("version_id"), "l_linenumber")


@query("""
    SELECT 'order' AS kind, o_orderkey AS id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal >= 0)
    UNION ALL SELECT 'document' AS kind, doc_id AS id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def orphan_reference_check(spark, d):
    a = entities.missing_references(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer").filter("c_acctbal >= 0"), "c_custkey")
    b = entities.missing_references(table(spark, d, "documents"), "doc_id", table(spark, d, "labels"), "doc_id")
    return a.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id")).unionByName(b.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id")))


@query("""
    WITH b AS (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text)
    SELECT doc_id FROM b WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)
""")
def idempotent_import(spark, d):
    """All documents into a store that has the even ones: by content hash, once each."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return entities.insert_new(docs.filter("doc_id % 2 = 0"), docs, "sha256", [F.col("doc_id")]).select("doc_id")


@query("""
    WITH j AS (SELECT event_id AS id, ts AS created_at, CASE WHEN event_type = 'view' THEN 'pending' WHEN event_type = 'click' THEN 'running' ELSE 'succeeded' END AS status,
                      ts + INTERVAL 5 MINUTE AS lease_until FROM events)
    SELECT id, status AS was, TIMESTAMP '2024-01-15 00:05:00' AS lease_until FROM j
    WHERE status = 'pending' OR (status = 'running' AND lease_until < TIMESTAMP '2024-01-15 00:00:00')
    ORDER BY created_at, id LIMIT 25
""")
def claim_jobs(spark, d):
    kind = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "running").otherwise("succeeded")
    jobs = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), kind.alias("status"), kind.alias("was"),
        (F.col("ts") + F.expr("INTERVAL 5 MINUTE")).alias("lease_until"), F.lit(0).alias("attempt_count"), F.lit(None).cast("timestamp_ntz").alias("started_at"),
    )
    return lifecycle.claim(jobs, F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"), "w1", n=25).select("id", "was", "lease_until")


@query("""
    WITH i AS (SELECT user_id AS job_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type IN ('click','view') THEN 'succeeded' ELSE 'pending' END AS status FROM events)
    SELECT job_id, count(*) FILTER (status = 'succeeded') AS processed_items, count(*) FILTER (status = 'failed') AS failed_items,
           CASE WHEN job_id % 7 = 0 THEN 'canceled' WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed' ELSE 'succeeded' END AS status
    FROM i GROUP BY job_id
""")
def job_outcomes(spark, d):
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type").isin("click", "view"), "succeeded").otherwise("pending")
    items = e.select(F.col("user_id").alias("job_id"), status.alias("status"))
    jobs = e.select(F.col("user_id").alias("id")).distinct().withColumns({
        "status": F.lit("running"), "cancel_requested": F.col("id") % 7 == 0, "processed_items": F.lit(0).cast("long"), "failed_items": F.lit(0).cast("long")})
    done = lifecycle.finish(jobs, items)
    return done.select(F.col("id").alias("job_id"), "processed_items", "failed_items", "status")


@query("""
    WITH v AS (SELECT o_orderkey AS id, o_custkey AS document_id, CASE WHEN o_orderstatus = 'O' THEN 'published' ELSE 'draft' END AS status FROM orders),
         p AS (SELECT o_custkey AS document_id, max(o_orderkey) AS version_id FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1)
    SELECT v.id, v.document_id, CASE WHEN p.document_id IS NULL THEN v.status WHEN v.id = p.version_id THEN 'published'
           WHEN v.status = 'published' THEN 'superseded' ELSE v.status END AS status
    FROM v LEFT JOIN p USING (document_id)
""")
def publish_versions(spark, d):
    o = table(spark, d, "orders")
    versions = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), F.when(F.col("o_orderstatus") == "O", "published").otherwise("draft").alias("status"))
    publish = o.filter("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("document_id")).agg(F.max("o_orderkey").alias("version_id"))
    return lifecycle.activate(versions, publish)


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
           CASE WHEN c_custkey % 3 = 1 THEN 'SET' ELSE c_mktsegment END AS c_mktsegment FROM customer
""")
def partial_update(spark, d):
    """Unset and null differ: every third balance is set to null, others keep theirs."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    fields = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("c_acctbal"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("c_mktsegment"))).otherwise(F.array().cast("array<string>"))
    updates = c.select("c_custkey", fields.alias("set_fields"), F.lit(None).cast("double").alias("c_acctbal"), F.lit("SET").alias("c_mktsegment"))
    return entities.partial_update(c, updates, "c_custkey")


@query("""
    SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'new' ELSE p_brand END AS brand FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 5 = 0
""")
def upsert_rows(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    new = p.filter("id % 5 = 0").withColumn("brand", F.lit("new"))
    return upsert(p.filter("id % 2 = 0"), new, ["id"])


@query("""
    WITH t AS (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id),
         s AS (SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id % 72 AS INTEGER)) END AS last_at,
                      CASE WHEN conv_id % 4 = 0 THEN 'archived' ELSE 'active' END AS status FROM t)
    SELECT conv_id, status, CASE WHEN last_at IS NULL OR last_at >= TIMESTAMP '2024-01-03' THEN 'Today' WHEN last_at >= TIMESTAMP '2024-01-02' THEN 'Yesterday' ELSE 'Earlier' END AS bucket,
           row_number() OVER (PARTITION BY status ORDER BY last_at DESC NULLS FIRST, conv_id) AS place
    FROM s
""")
def recency_buckets(spark, d):
    t = table(spark, d, "conversations").select("conv_id").distinct()
    last = F.when(F.col("conv_id") % 5 != 0, F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id % 72 as int), 0, 0)"))
    t = t.withColumns({"last_at": last, "status": F.when(F.col("conv_id") % 4 == 0, "archived").otherwise("active")})
    t = t.withColumn("bucket", entities.recency(F.col("last_at"), F.expr("TIMESTAMP_NTZ '2024-01-03 00:00:00'")))
    # numbers within (status, instant), and the instants' counts before: no status is one group
    w = Window.partitionBy("status", "last_at").orderBy("conv_id")
    before = Window.partitionBy("status").orderBy(F.desc_nulls_first("last_at")).rowsBetween(Window.unboundedPreceding, -1)
    counts = t.groupBy("status", "last_at").count().select(
        F.col("status").alias("s"), F.col("last_at").alias("l"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    rows = t.withColumn("nth", F.row_number().over(w)).join(counts, (F.col("status") == F.col("s")) & F.col("last_at").eqNullSafe(F.col("l")))
    return rows.select("conv_id", "status", "bucket", (F.col("before") + F.col("nth")).alias("place"))


@query("SELECT o_orderkey FROM orders ORDER BY sha256(o_orderkey || ':42'), o_orderkey LIMIT 50")
def seeded_sample(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return o.orderBy(F.sha2(F.concat(F.col("o_orderkey").cast("string"), F.lit(":42")), 256), "o_orderkey").limit(50)


@query("""
    SELECT lang, arg_min(doc_id, (n_chars, doc_id)) AS doc_id, min(n_chars) AS n_chars FROM documents WHERE n_chars >= 300 GROUP BY lang
""")
def smallest_per_category(spark, d):
    from triagelake.sources.tables import smallest_per_category as smallest

    files = table(spark, d, "documents").select("doc_id", F.col("lang").alias("category"), F.col("n_chars").alias("n_bytes"), F.format_string("%020d", "doc_id").alias("source_path"))
    return smallest(files, 300).select(F.col("category").alias("lang"), "doc_id", F.col("n_bytes").alias("n_chars"))


@query("""
    SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type
""")
def latest_field_fold(spark, d):
    """The last value of each field of each session."""
    from triagelake.streaming.fields import fold_events

    e = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("field"), "value", F.struct("ts", "event_id").alias("seq"))
    return fold_events(e).select(F.col("session").alias("user_id"), F.col("field").alias("event_type"), "value")


@query("""
    SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey
    GROUP BY c_custkey HAVING count(o_orderkey) > 0
""")
def relationship_counts(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "n_orders")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_version(spark, d):
    return latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")
