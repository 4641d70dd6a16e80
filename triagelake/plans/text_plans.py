"""Chunking, extraction and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.functions import text as T
from triagelake.operators import chunking, rules
from triagelake.plans.registry import Registry
from triagelake.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.query


@query("""
    SELECT doc_id, CAST(o AS BIGINT) AS ordinal, CAST(o * 780 AS BIGINT) AS start, least(o * 780 + 900, length(text)) AS "end",
           sha256(substr(text, o * 780 + 1, 900)) AS piece_sha256
    FROM (SELECT *, unnest(range(0, length(text) // 780 + 1)) AS o FROM documents) WHERE o * 780 < greatest(length(text) - 120, 1) AND length(text) > 0
""")
def chunk_fixed_overlap(spark, d):
    got = chunking.fixed_chunks(table(spark, d, "documents"), "doc_id", "text")
    return got.select("doc_id", "ordinal", "start", "end", F.sha2("piece", 256).alias("piece_sha256"))


FRONT = "'(?s)^---\\s*\\n(.*?)\\n---\\s*\\n'"
TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
STOP = """CASE WHEN {a} + 900 >= length(s) THEN length(s)
              WHEN regexp_matches(substr(s, {a} + 451, 450), '[。；\\n]') THEN {a} + 900 - length(regexp_extract(substr(s, {a} + 451, 450), '[^。；\\n]*$'))
              ELSE {a} + 900 END"""


@query(f"""
    WITH RECURSIVE d AS (
        SELECT source || '/' || doc_id || '.md' AS source_path, doc_id, lang AS category, sha256(text) AS sha256, text, length(regexp_extract(text, {FRONT}, 0)) AS shift FROM documents
    ), b AS (SELECT *, substr(text, shift + 1) AS body FROM d),
    l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM b),
    p AS (SELECT doc_id, n, line, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(line) - 1 AS BIGINT) AS pos FROM l),
    h AS (SELECT doc_id, pos FROM p WHERE n = 1 OR regexp_matches(line, '^(#{{1,6}}\\s+.+|[一二三四五六七八九十]+、.+|（[一二三四五六七八九十]+）.+)$')),
    e AS (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM h),
    t AS (SELECT b.*, pos, {TRIM.format("substr(body, pos + 1, coalesce(upto, length(body)) - pos)")} AS s FROM e JOIN b USING (doc_id)),
    c AS (
        SELECT doc_id, pos, s, CAST(0 AS BIGINT) AS a, CAST({STOP.format(a="0")} AS BIGINT) AS z FROM t WHERE s <> ''
        UNION ALL
        SELECT doc_id, pos, s, greatest(a + 1, z - 120), CAST({STOP.format(a="greatest(a + 1, z - 120)")} AS BIGINT) FROM c WHERE z < length(s)
    ), o AS (
        SELECT b.*, c.pos + b.shift + a AS start, c.pos + b.shift + z AS "end", substr(regexp_extract(s, '^[^\\n]*'), 1, 160) AS section, substr(s, a + 1, z - a) AS piece,
               row_number() OVER (PARTITION BY doc_id ORDER BY c.pos, a) - 1 AS ordinal, regexp_extract({TRIM.format("body")}, '^[^\\n]*') AS first_line
        FROM c JOIN b USING (doc_id)
    ), n AS (SELECT *, coalesce(nullif({TRIM.format("regexp_replace(first_line, '^#+', '')")}, ''), doc_id::VARCHAR) AS title FROM o)
    SELECT sha256(source_path || ':' || start || ':' || "end" || ':' || sha256) AS chunk_id, left(sha256(source_path), 32) AS document_id, category, title, source_path, sha256,
           ordinal, start, "end", section, md5('文件：' || title || chr(10) || '类别：' || category || chr(10) || '章节：' || section || chr(10) || {TRIM.format("piece")}) AS content_md5
    FROM n
""")
def chunk_documents(spark, d):
    """Sections, cuts at marks and hash ids, with the prefixed content's MD5."""
    docs = table(spark, d, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("source_path"), F.col("lang").alias("category"), "text")
    got = chunking.chunk_documents(docs)
    return got.withColumn("content_md5", F.md5("content")).withColumn("ordinal", F.col("ordinal").cast("long")).drop("content", "metadata")


@query("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
         p AS (SELECT doc_id, n, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(line) - 1 AS start FROM l)
    SELECT doc_id, n AS ordinal, CAST(start AS BIGINT) AS start, CAST(lead(start) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS next_start, length(line) AS n_chars FROM p
""")
def chunk_lines(spark, d):
    """Boundaries of lines, each with the next: adjacent pairs, within the row."""
    sizes = F.transform(F.split("text", "\n"), lambda x: F.length(x).cast("long"))
    docs = T.hold(table(spark, d, "documents"), ["doc_id"], sizes=sizes).select("doc_id", "sizes", T.starts_of("sizes").alias("starts"))
    pairs = F.zip_with("starts", "sizes", lambda s, n: F.struct(s.alias("start"), n.alias("n_chars")))
    lines = docs.select("doc_id", "starts", F.posexplode(pairs).alias("n", "p"))
    return lines.select("doc_id", (F.col("n") + 1).cast("long").alias("ordinal"), "p.start", F.get("starts", F.col("n") + 1).alias("next_start"), "p.n_chars")


@query("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
    SELECT doc_id, n AS ordinal, last_value(CASE WHEN length(line) < 60 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS heading FROM l
""")
def heading_restore(spark, d):
    """The nearest heading (here: a short line) at or before each line, within the row."""
    docs = T.hold(table(spark, d, "documents"), ["doc_id"], lines=F.split("text", "\n"))
    marked = docs.select("doc_id", "lines", T.last_true(F.transform("lines", lambda x: F.length(x) < 60)).alias("at"))
    headings = F.transform("at", lambda i: F.when(i >= 0, F.get("lines", i)))
    return marked.select("doc_id", F.posexplode(headings).alias("n", "heading")).select("doc_id", (F.col("n") + 1).cast("long").alias("ordinal"), "heading")


@query("""
    WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])', '\\1' || chr(1), 'g'), chr(1))) AS sentence,
                      generate_subscripts(string_split(regexp_replace(text, '([.!?])', '\\1' || chr(1), 'g'), chr(1)), 1) AS n FROM documents)
    SELECT doc_id, count(*) FILTER (sentence <> '') AS n_sentences,
           coalesce(md5(string_agg(sentence, '' ORDER BY n) FILTER (NOT contains(sentence, 'the ') AND NOT contains(sentence, 'de '))), md5('')) AS kept_md5
    FROM s GROUP BY doc_id
""")
def sentence_filter(spark, d):
    """Sentences that hold a needle go; the others keep their marks and order."""
    parts = F.split("text", r"(?<=[.!?])")
    rows = table(spark, d, "documents").select("doc_id", F.inline(F.array(F.struct(parts.alias("s")))))
    kept = F.filter("s", lambda x: ~T.contains_any(x, ["the ", "de "]))
    return rows.select("doc_id", F.size(F.filter("s", lambda x: x != "")).cast("long").alias("n_sentences"), F.md5(F.array_join(kept, "")).alias("kept_md5"))


@query("""
    SELECT doc_id, CASE WHEN contains(t, 'thethe') THEN 'thethe' WHEN contains(t, 'andthe') THEN 'andthe' WHEN contains(t, 'ofthe') THEN 'ofthe' END AS explicit_district,
           CASE WHEN contains(t, 'thethe') THEN FALSE WHEN contains(t, 'andthe') OR contains(t, 'ofthe') THEN TRUE ELSE contains(t, 'queles') END AS outside_default_jurisdiction
    FROM (SELECT doc_id, regexp_replace(text, '[\\s\\x{3000}\\x{00A0}]+', '', 'g') AS t FROM documents)
""")
def jurisdiction_context(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    got = rules.case_context(docs, "text", ["thethe", "andthe", "ofthe"], "thethe", ["queles"])
    return got.select("doc_id", "explicit_district", "outside_default_jurisdiction")


@query("""
    WITH s AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'needs_fact_check' ELSE 'supported' END AS status, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE (doc_id % 100) / 100.0::DOUBLE END AS c, toxic FROM labels),
    a AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'needs_fact_check' ELSE status END AS status, CASE WHEN toxic = 1 THEN least(coalesce(c, 0.6::DOUBLE), 0.6::DOUBLE) ELSE c END AS c FROM s)
    SELECT doc_id, status, CASE WHEN status = 'needs_fact_check' THEN least(coalesce(c, 0.7::DOUBLE), 0.7::DOUBLE) ELSE c END AS confidence FROM a
""")
def confidence_caps(spark, d):
    rows = table(spark, d, "labels").select(
        "doc_id", "toxic", F.when(F.col("quality") == 0, "needs_fact_check").otherwise("supported").alias("status"),
        F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 100) / F.lit(100.0)).alias("confidence"))
    c, s = F.col("confidence"), F.col("status")
    rows = rows.withColumns({"status": F.when(F.col("toxic") == 1, "needs_fact_check").otherwise(s), "confidence": F.when(F.col("toxic") == 1, rules.capped(c, 0.6)).otherwise(c)})
    return rows.select("doc_id", "status", F.when(s == "needs_fact_check", rules.capped(c, 0.7)).otherwise(c).alias("confidence"))


@query("SELECT q.item_id, d.doc_id FROM benchmark q JOIN documents d ON contains(d.text, q.text) WHERE length(trim(q.text)) >= 8")
def quote_verification(spark, d):
    """Whole quotes found in whole texts: both sides meet on the quotes' first eight
    characters, ids alone pass that join, and the texts of those that met are compared."""
    q = table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote")).filter(F.length(F.trim("quote")) >= 8)
    heads = q.select("item_id", F.left("quote", F.lit(8)).alias("g"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    grams = T.hold(docs, ["doc_id"], grams=F.array_distinct(T.windows(F.col("text"), 8)))
    met = grams.select("doc_id", F.explode("grams").alias("g")).join(heads, "g").select("doc_id", "item_id").distinct()
    return met.join(docs, "doc_id").join(q, "item_id").filter(F.col("text").contains(F.col("quote"))).select("item_id", "doc_id").distinct()


STRIPPED = "regexp_replace(text, '^[\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+|[\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+$', '', 'g')"


@query(f"""
    WITH p AS (SELECT *, {STRIPPED} AS q FROM conversations),
         f AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, role) AS first_turn FROM p WHERE q <> ''),
         u AS (SELECT conv_id, role, first_turn, q, min(turn) AS t FROM f GROUP BY ALL),
         g AS (SELECT conv_id, role, first_turn, string_agg('- ' || q, chr(10) ORDER BY t, q) AS body FROM u GROUP BY ALL),
         s AS (SELECT conv_id, string_agg('“' || role || '”负责：' || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY first_turn, role) AS summary FROM g GROUP BY conv_id)
    SELECT conv_id, summary FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN s USING (conv_id)
""")
def grouped_distinct_summary(spark, d):
    part = F.struct("turn", "role", F.col("text").alias("quote"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("items"))
    items = F.transform("items", lambda i: F.struct(i["role"].alias("source"), i["quote"].alias("quote")))
    return rows.select("conv_id", T.grouped_summary(items).alias("summary"))


@query("""
    SELECT conv_id, coalesce(string_agg(CASE WHEN role = 'user' THEN length(text)::VARCHAR END, ',' ORDER BY turn, text), '') AS user_lengths,
           max(CASE WHEN role = 'system' THEN text END) IS NOT NULL AS has_system
    FROM conversations GROUP BY conv_id
""")
def role_array_extract(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("xs"))
    user = F.transform(F.filter("xs", lambda x: x["role"] == "user"), lambda x: F.length(x["text"]).cast("string"))
    return rows.select("conv_id", F.array_join(user, ",").alias("user_lengths"), F.exists("xs", lambda x: x["role"] == "system").alias("has_system"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_props_extract(spark, d):
    rows = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rows.filter("k is not null")


@query("""
    SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host,
           regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, nullif(regexp_extract(url, '[?]([^#]*)', 1), '') AS query_string FROM pages
""")
def url_parts(spark, d):
    def part(p: str):
        return F.regexp_extract("url", p, 1)

    return table(spark, d, "pages").select(
        "page_id", part("^([a-z]+)://").alias("scheme"), part("://([^/?#]*)").alias("host"), part("://[^/?#]*([^?#]*)").alias("path"),
        F.nullif(part(r"[?]([^#]*)"), F.lit("")).alias("query_string"))


@query("""
    SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a ')) AS n_links FROM pages
""")
def html_title(spark, d):
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a ")).cast("long").alias("n_links"))


@query("SELECT doc_id, regexp_replace(substr(sha256(text), 1, 32), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5') AS point_id, sha1(text) AS sha1 FROM documents")
def hash_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", T.uuid_of_hash(F.col("text")).alias("point_id"), F.sha1("text").alias("sha1"))


@query("""
    WITH b AS (SELECT doc_id, sha256(text) AS h FROM documents),
         v AS (SELECT doc_id, list_transform(range(0, 32), lambda i: CAST(16 * (strpos('0123456789abcdef', h[2 * i + 1]) - 1) + strpos('0123456789abcdef', h[2 * i + 2]) - 1 AS DOUBLE) - 127.5) AS x FROM b)
    SELECT doc_id, round(x[1] / sqrt(list_dot_product(x, x)), 6) AS first, round(x[32] / sqrt(list_dot_product(x, x)), 6) AS last FROM v
""")
def hash_embedding(spark, d):
    """The deterministic stand-in for an embedding model."""
    rows = table(spark, d, "documents").select("doc_id", T.hash_vector(F.col("text")).alias("v"))
    return rows.select("doc_id", F.round(F.get("v", 0), 6).alias("first"), F.round(F.get("v", 31), 6).alias("last"))


@query("""
    SELECT doc_id, 'T' || doc_id AS title, '["' || lang || '","' || source || '"]' AS tags, CASE doc_id % 2 WHEN 0 THEN '{"k":' || doc_id || '}' ELSE '' END AS more,
           length('---\ntitle: T' || doc_id || ' # note\ntags:\n- ' || lang || '\n- ' || source || '\nmore:\n' || CASE doc_id % 2 WHEN 0 THEN '  k: ' || doc_id || '\n' ELSE '' END || '---\n') AS shift
    FROM documents WHERE doc_id % 5 <> 0
    UNION ALL SELECT doc_id, NULL, NULL, NULL, 0 FROM documents WHERE doc_id % 5 = 0
""")
def front_matter_blocks(spark, d):
    """Lists and maps in front matter; a block that is no YAML stays text."""
    n = F.col("doc_id").cast("string")
    good = F.concat(F.lit("---\ntitle: T"), n, F.lit(" # note\ntags:\n- "), "lang", F.lit("\n- "), "source", F.lit("\nmore:\n"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  k: "), n, F.lit("\n"))).otherwise(""), F.lit("---\n"))
    front = F.when(F.col("doc_id") % 5 != 0, good).otherwise(F.lit("---\na: b: c\n---\n"))
    docs = table(spark, d, "documents").select("doc_id", chunking.read_front(F.concat(front, F.coalesce("text", F.lit("")))).alias("front"))
    values = T.hold(docs, ["doc_id", "front"], m=chunking.front_matter(F.col("front")))
    field = lambda k: F.try_element_at("m", F.lit(k)).alias(k)
    return values.select("doc_id", field("title"), field("tags"), field("more"), F.col("front.length").cast("long").alias("shift"))
