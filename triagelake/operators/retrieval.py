"""Hybrid retrieval: exact cosine and trigram BM25, fused by reciprocal ranks.

Ids and ranks alone pass through ranking; contents are joined at the end.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions.text import contains_any, first_filled, hold, squeeze, strip, windows
from triagelake.operators.dense_blocks import block_top_k

RRF = 60

# Needles of a query and the expansion they add, in this order.
EXPANSIONS = [
    (["占道", "店外经营", "摆放桌椅"], "占用城市道路 广场等公共场所 违法经营 店外摆放桌椅 城市管理综合执法机关 行政处罚权"),
    (["噪声", "扰民", "喧哗"], "餐饮场所 噪声排放 商业噪声 食客喧哗 监督管理 行政处罚"),
    (["油烟", "烟道", "异味"], "餐饮场所 油烟排放 专用烟道 大气污染 生态环境 行政处罚"),
    (["电梯", "特种设备"], "住宅电梯 故障 隐患 特种设备安全 使用管理人 市场监督管理"),
    (["维修资金", "专项维修资金"], "住宅专项维修资金 申请列支 审核 备案 住房建设"),
    (["物业", "物业公司"], "物业服务企业 物业管理 监督管理 住房建设"),
    (["个人信息", "身份证", "手机号码"], "个人信息 泄露 身份证号码 手机号码 网络安全 删除 监管 处罚"),
    (["违停", "乱停放", "停车", "机动车"], "机动车停放 道路交通安全 公安机关交通管理部门 属地道路 交通秩序"),
    (["消防通道", "疏散通道", "消防车通道"], "占用 堵塞 封闭 消防车通道 消防救援 监督检查 行政处罚"),
    (["违法建设", "违建", "私搭", "加建", "搭建"], "违法建设 规划许可 查处 拆除 城市管理综合执法 镇街"),
    (["水质", "供水", "自来水", "停水", "水压"], "供水水质 城镇供水 水务部门 监督管理 供水企业"),
    (["路灯", "照明", "灯不亮"], "城市道路照明 路灯 产权 维护 管养单位 设施移交"),
    (["积水", "水浸", "内涝", "下穿隧道"], "道路积水 城市内涝 排水防涝 交通管制 应急处置 水务"),
    (["垃圾", "保洁", "清扫", "异味"], "物业服务 保洁义务 环境卫生 镇街监督 住房建设"),
    (["食品", "发霉", "食堂", "呕吐", "腹泻"], "食品安全 学校 幼儿园 市场监督管理 留样 供货凭证 应急处置"),
    (["学位", "入学", "招生", "公办小学", "适龄儿童"], "白云区教育局 义务教育 公办学校 招生计划 学位安排 教育公平 主管部门 职责"),
    (["噪声", "扰民", "喇叭", "施工机械"], "中华人民共和国噪声污染防治法 现行 商业经营 高音喇叭 建筑施工 职责 行政处罚"),
]
# Fixed value: the title of a law that is no longer in force.
REPEALED = "中华人民共和国环境噪声污染防治法"
# Fixed value: the text of a request for which nothing was found.
NOTHING_FOUND = "（本次未召回任何可用证据）"
# The category whose chunks get their heading back, and the fields of a record's metadata.
DUTIES = "01_机构职责"
RECORD_FIELDS = (
    "chunk_id document_id category source_path section start end sha256 knowledge_type work_order_id source_case_id document_header"
).split()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def searchable() -> Column:
    """Not switched off and no document header; a missing flag passes."""
    return ~F.col("active").eqNullSafe(False) & ~F.col("document_header").eqNullSafe(True)


def dense_scores(queries: DataFrame, corpus: DataFrame, by: list[str] | None = None, salts: int | None = None) -> DataFrame:
    """query_id, by, cid and score (cosine) of every pair, made once by an equality join
    on a salt, so either side may be large (as many salts as the session has shuffle
    partitions); lengths are computed before the pairs are made."""
    by = by or []
    salts = salts or int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = hold(corpus.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(salts)).cast("int")), ["cid", *by, "salt", "v"], v_len=F.sqrt(dot(F.col("v"), F.col("v"))))
    spread = hold(queries, ["query_id", "q"], q_len=F.sqrt(dot(F.col("q"), F.col("q")))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, "salt").select("query_id", *by, "cid", F.round(dot(F.col("q"), F.col("v")) / (F.col("q_len") * F.col("v_len")), 6).alias("score"))


def dense_top_k(queries: DataFrame, corpus: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """queries: query_id, q (vector); corpus: cid, v.  query_id, by, cid, score and 1-based
    rank of the k most similar (cosine), for each of ``by`` (columns of corpus).  Blocks of
    queries meet blocks of rows, and only each block's k best are ranked."""
    scored = block_top_k(queries, corpus, k, by)
    w = Window.partitionBy("query_id", *(by or [])).orderBy(F.desc("score"), "cid")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def trigrams(text: Column) -> Column:
    """All three-character windows, in lower case: the tokens of the lexical index."""
    return F.coalesce(windows(F.lower(text), 3), F.array().cast("array<string>"))


def postings(corpus: DataFrame, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(cid, term, tf) and (cid, dl: number of tokens) of corpus (cid, text)."""
    places = hold(corpus, ["cid"], terms=trigrams(F.col(text))).select("cid", F.explode("terms").alias("term"))
    size = F.greatest(F.length(F.lower(F.col(text))) - 2, F.lit(0)).cast("long")
    return places.groupBy("cid", "term").agg(F.count("*").alias("tf")), corpus.select("cid", F.coalesce(size, F.lit(0)).alias("dl"))


def term_hits(corpus: DataFrame, terms: DataFrame, text: str = "content", keep: list[str] | None = None, width: int = 12) -> DataFrame:
    """(cid, keep, term, tf): how often each lower-case term of three characters or more
    occurs in each text, as a phrase of trigrams and so anywhere in a word.

    A place of a text (``width`` characters from there) meets the pieces that begin with
    its trigram.  A term of ``width`` characters or fewer is one piece; a longer one has
    pieces one behind the other and one at its end, and stands where all of them do."""
    keep = ["cid", *(keep or [])]
    known = terms.select("term").distinct().filter(F.length("term") >= 3)
    last = F.greatest(F.length("term") - width, F.lit(0))
    offsets = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(width)), F.array(last)))
    parts = known.select("term", F.size(offsets).alias("n"), F.explode(offsets).alias("at"))
    parts = parts.withColumn("part", F.substr("term", F.col("at") + 1, F.lit(width))).withColumn("gram", F.left("part", F.lit(3)))
    held = hold(corpus, keep, all=windows(F.lower(F.col(text)), width, 3))
    places = held.select(*keep, F.posexplode("all").alias("place", "w")).withColumn("gram", F.left("w", F.lit(3)))
    start = F.when(F.col("n") > 1, F.col("place") - F.col("at"))
    met = places.join(parts, "gram").filter(F.col("w").startswith(F.col("part")))
    met = met.groupBy(*keep, "term", "n", start.alias("start")).agg(F.count("*").alias("parts"))
    hits = F.when(F.col("n") == 1, F.col("parts")).when(F.col("n") == F.col("parts"), 1).otherwise(0)
    return met.groupBy(*keep, "term").agg(F.sum(hits).alias("tf")).filter("tf > 0")


def index_upsert(chunks: DataFrame, tf: DataFrame, dl: DataFrame, new: DataFrame, text: str = "content") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index (chunks, postings, sizes) with ``new`` chunks in place of those of their
    ids: only new texts are read, of the old index the rows of these ids go."""
    ids = new.select("cid").distinct()
    made = postings(new, text)
    kept = [t.join(ids, "cid", "left_anti") for t in (chunks, tf, dl)]
    return tuple(a.unionByName(b) for a, b in zip(kept, (new, *made)))


def index_delete(chunks: DataFrame, tf: DataFrame, dl: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index without the chunks of ``documents`` (document_id, version_id; a null
    version: of all of its versions)."""
    d = documents.select(F.col("document_id").alias("_doc"), F.col("version_id").alias("_ver")).distinct()
    hit = (F.col("document_id") == F.col("_doc")) & (F.col("_ver").isNull() | (F.col("version_id") == F.col("_ver")))
    kept = chunks.join(d, hit, "left_anti")
    ids = chunks.join(d, hit, "left_semi").select("cid").distinct()
    return kept, tf.join(ids, "cid", "left_anti"), dl.join(ids, "cid", "left_anti")


def weighted_top_k(query_terms: DataFrame, tf: DataFrame, dl: DataFrame, weights: dict[str, float], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """As ``bm25_top_k`` over several columns: tf (cid, field, term, tf), dl (cid, dl) of
    all fields together.  The k best are chosen with all fields alike; ``score`` counts a
    hit by the weight of its field."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("field")], F.lit(0.0))
    rows = tf.groupBy("cid", "term").agg(F.sum("tf").cast("double").alias("tf"), F.sum(F.col("tf") * weight).alias("heavy"))
    plain = _parts(query_terms, rows, dl, ["tf", "heavy"], k1, b).groupBy("query_id", "cid").agg(
        F.round(F.sum("part_tf"), 6).alias("plain"), F.round(F.sum("part_heavy"), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("plain"), "cid")
    return plain.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _parts(query_terms: DataFrame, tf: DataFrame, dl: DataFrame, counts: list[str], k1: float, b: float) -> DataFrame:
    """Of each query, text and term the term's share of the score, for each of ``counts``.
    The corpus statistics are one row, and document frequencies are taken for the
    queries' terms alone."""
    stats = dl.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    wanted = tf.join(query_terms.select("term").distinct(), "term")
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    share = {f"part_{c}": weight * F.col(c) * (k1 + 1) / (F.col(c) + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))) for c in counts}
    return query_terms.join(wanted, "term").join(df, "term").join(dl, "cid").crossJoin(F.broadcast(stats)).withColumns(share)  # stats: one row


def bm25_top_k(query_terms: DataFrame, tf: DataFrame, dl: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_terms: (query_id, term), distinct; tf: of ``term_hits`` or ``postings``.
    query_id, cid, score, rank."""
    scored = _parts(query_terms, tf, dl, ["tf"], k1, b).groupBy("query_id", "cid").agg(F.round(F.sum("part_tf"), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "cid")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fuse(ranked: DataFrame, by: list[str]) -> DataFrame:
    """ranked: by, sub (sub-query number), src (0 dense, 1 lexical), cid, rank, score.

    rrf, best dense and lexical scores, the place of first sight, and the best
    place (local rank, sub) within a sub-query's own list (by its summed share).  Rows without
    a key go."""
    share = F.lit(1.0) / (RRF + F.col("rank"))
    top = [F.max(F.when(F.col("src") == i, F.col("score"))).alias(name) for i, name in enumerate(("dense", "lexical"))]
    local = ranked.groupBy(*by, "sub", "cid").agg(F.sum(share).alias("own"), F.min(F.struct("src", "rank")).alias("seen"), *top)
    w = Window.partitionBy(*by, "sub").orderBy(F.desc(F.round("own", 12)), "seen", "cid")
    keyed = reduce(and_, [F.col(c).isNotNull() for c in [*by, "cid"]])
    # one use of the lists, which are searches: used twice, each would be made twice
    return local.filter(keyed).withColumn("local_rank", F.row_number().over(w)).groupBy(*by, "cid").agg(
        F.round(F.sum("own"), 9).alias("rrf"),
        F.coalesce(F.max("dense"), F.lit(0.0)).alias("dense"),
        F.coalesce(F.max("lexical"), F.lit(0.0)).alias("lexical"),
        F.min(F.when(F.col("local_rank") <= 2, F.struct("local_rank", "sub"))).alias("round"),
        F.min(F.struct(F.col("sub"), F.col("seen.src").alias("src"), F.col("seen.rank").alias("rank"))).alias("first_seen"),
    )


def cover_and_fill(fused: DataFrame, by: list[str], candidates: int, top_k: int, threshold: float = 0.0, score: Column | None = None) -> DataFrame:
    """The first of every sub-query, then the second, then by rrf; cut to the
    candidates, those below the threshold out, then the first top_k."""
    order = [F.col("round").isNull(), F.col("round.local_rank"), F.col("round.sub"), F.desc("rrf"), F.col("first_seen"), F.col("cid")]
    w = Window.partitionBy(*by).orderBy(*order)
    cut = fused.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= candidates)
    cut = cut.withColumn("score", F.col("dense") if score is None else score).filter(F.col("score") >= threshold)
    again = Window.partitionBy(*by).orderBy("pos" if score is None else F.desc("score"), "pos")
    return cut.withColumn("final_rank", F.row_number().over(again)).filter(F.col("final_rank") <= top_k)


def expand_queries(df: DataFrame, rules: list[tuple[list[str], str]], query: str = "query", cap: int = 8,
                   splitter: str = "[，,；;。！？!?]|同时|以及|并且|分别", least: int = 6) -> DataFrame:
    """Adds ``subqueries``: the query, the expansions whose needles it holds (in the
    rules' order), its fragments of ``least`` characters or more; distinct, capped."""
    q = F.col(query)
    expanded = [F.when(contains_any(q, needles), F.lit(text)) for needles, text in rules]
    fragments = F.filter(F.transform(F.split(q, splitter), strip), lambda p: F.length(p) >= least)
    parts = F.concat(F.array(strip(q)), F.array(*expanded) if expanded else F.array().cast("array<string>"), fragments)
    return df.withColumn("subqueries", F.slice(F.array_distinct(F.filter(parts, lambda x: x.isNotNull() & (x != ""))), 1, cap))


def evidence_pack(records: DataFrame, by: list[str], top_k: int, quota: int = 1) -> DataFrame:
    """records: by, evidence_id, arrival, group_no (place of the group in the
    request), score.  Each evidence once, at its best score; where more than
    ``top_k`` are left, first the best of each group in the request's order, then
    the best of the rest.  Tasks keep one row an evidence before the shuffle, and
    only the first ``top_k`` of a group, and of all, are ranked."""
    others = [c for c in records.columns if c not in (*by, "evidence_id")]
    first = F.min_by(F.struct(*others), F.struct((-F.col("score")).alias("s"), "arrival")).alias("_first")
    unique = records.groupBy(*by, "evidence_id").agg(first).select(*by, "evidence_id", "_first.*")
    n = unique.groupBy(*by).agg(F.count("*").alias("_n"))
    ranked = Window.partitionBy(*by, "group_no").orderBy(F.desc("score"), "arrival")
    # of a group no more than the first max(top_k, quota) can get in
    heads = unique.withColumn("_g", F.row_number().over(ranked)).filter(F.col("_g") <= max(top_k, quota)).join(n, by)
    chosen = (F.col("_n") > top_k) & (F.col("_g") <= quota)
    order = Window.partitionBy(*by).orderBy(
        F.desc(chosen), F.when(chosen, F.col("group_no")), F.desc("score"), "arrival"
    )
    return heads.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= top_k).select(*records.columns, "pos")


def normalise_records(records: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Raw records (group, arrival: place in the group's answer from 0, chunk_id, point_id,
    content, title, source_title, score as text; if there: category, document_id,
    source_case_id, case_id, source_record_id, work_order_id) as evidence.

    Records with blank content go, and the places of the others stay; ids and titles by
    fallback, scores that are no number 0.  ``external_id`` and ``source_id``: the first
    case id, else the chunk's or document's."""
    def text(name: str) -> Column:
        return F.nullif(F.col(name).cast("string"), F.lit("")) if name in records.columns else F.lit(None).cast("string")

    kinds = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    point = F.coalesce(text("chunk_id"), text("point_id"), F.concat(F.lit("result-"), F.col("arrival").cast("string")))
    case = F.coalesce(text("source_case_id"), text("case_id"), text("source_record_id"))
    filled = records.filter(squeeze(F.coalesce("content", F.lit(""))) != "")
    return filled.select(
        "group", "arrival", "content", point.alias("evidence_id"), F.concat("group", F.lit(":"), point).alias("full_id"),
        F.coalesce(text("source_title"), text("title"), text("category")).alias("document_title"), text("document_id").alias("document_id"),
        F.coalesce(F.expr("try_cast(score AS double)"), F.lit(0.0)).alias("score"),
        F.coalesce(kinds[F.col("group")], F.lit("other")).alias("source_type"),
        F.coalesce(case, point).alias("external_id"), F.coalesce(case, text("document_id"), point).alias("source_id"),
        case.alias("case_id"), text("work_order_id").alias("work_order_id"),
    )


def in_force(title: Column) -> Column:
    """Titles of repealed laws are out; null titles pass."""
    return ~F.coalesce(title.contains(REPEALED), F.lit(False))


def with_heading(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """chunks: source_path, category, start, content; sources: source_path, text.  Chunks
    of the duties' category get the nearest ``## `` heading before their start in front,
    if they do not hold it.  Only these chunks meet the texts."""
    mine = F.col("category").eqNullSafe(DUTIES)
    wanted = chunks.filter(mine).select("source_path").distinct()
    headings = F.regexp_extract_all(F.left("text", F.greatest(F.coalesce("start", F.lit(0)), F.lit(0))), F.lit(r"(?md)^##\s+(.+?)\s*$"), F.lit(1))
    texts = sources.join(wanted, "source_path", "left_semi").select("source_path", "text")
    held = chunks.filter(mine).join(texts, "source_path", "left").withColumn("_head", strip(F.get(F.reverse(headings), 0)))
    add = (F.col("_head") != "") & ~F.col("content").contains(F.col("_head"))
    content = F.when(add, F.concat(F.lit("【所属部门（原文标题）】\n"), "_head", F.lit("\n\n"), "content")).otherwise(F.col("content"))
    return held.withColumn("content", content).select(chunks.columns).unionByName(chunks.filter(~mine))


def as_records(rows: DataFrame, by: list[str]) -> DataFrame:
    """Ranked rows (by, rank, title, content, score, fields of the payload) as records: content
    under evidence numbers E1, E2, ..., a numbered title and the metadata as a map."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy("rank"))
    fields = [c for c in RECORD_FIELDS if c in rows.columns]
    numbered = rows.withColumn("evidence_id", F.concat(F.lit("E"), n.cast("string")))
    pairs = [F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in fields]
    pairs += [F.struct(F.lit("evidence_id").alias("k"), F.col("evidence_id").alias("v")), F.struct(F.lit("source_title").alias("k"), F.col("title").alias("v"))]
    return numbered.select(
        *by, "rank", "evidence_id", "score",
        F.concat(F.lit("【证据ID："), "evidence_id", F.lit("】\n【文件名："), "title", F.lit("】\n【以下为知识库原文，引用时必须逐字复制】\n"), "content").alias("content"),
        F.concat(F.lit("["), "evidence_id", F.lit("] "), "title").alias("title"),
        F.map_from_entries(F.array(*pairs)).alias("metadata"),
    )


def evidence_text(evidence: DataFrame, by: list[str], groups: DataFrame | None = None) -> DataFrame:
    """``groups``: all groups (by); those without evidence get ``NOTHING_FOUND``.  evidence: by, pos, evidence_id, document_title, source_title, knowledge_base_id,
    content, source_type, source_case_id, case_id.  One text of each group for a model:
    numbered blocks, without the marks that the records' contents carry."""
    case = first_filled(F.col("source_case_id"), F.col("case_id"))
    extra = F.array_compact(F.array(
        F.when(F.col("source_type") != "", F.concat(F.lit("类型="), "source_type")), F.when(case.isNotNull(), F.concat(F.lit("历史工单号="), case))))
    plain = F.regexp_replace(F.regexp_replace("content", r"(?U)【证据ID：\s*E\d+\s*】\s*", ""), r"(?U)【文件名：[^】]*】\s*", "")
    head = F.when(F.size(extra) > 0, F.concat(F.lit("（"), F.array_join(extra, "，"), F.lit("）"))).otherwise("")
    name = first_filled(F.col("document_title"), F.col("source_title"), F.col("knowledge_base_id"))
    block = F.concat(F.lit("["), "evidence_id", F.lit("] "), head, F.lit("\n标题："), name, F.lit("\n原文："), plain)
    parts = evidence.select(*by, F.struct("pos", block.alias("block")).alias("part"))
    # a pack has at most top_k blocks
    packed = parts.groupBy(*by).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    said = packed.select(*by, F.array_join(F.transform("parts", lambda x: x["block"]), "\n\n").alias("text"))
    if groups is None:
        return said
    return groups.select(*by).distinct().join(said, by, "left").withColumn("text", F.coalesce("text", F.lit(NOTHING_FOUND)))
