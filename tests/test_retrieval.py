"""Retrieval, chunking and sources against plain loops."""

import math

from pyspark.sql import functions as F

from triagelake.functions.text import hash_vector, trigram_terms, windows
from triagelake.operators import chunking, entities, retrieval
from triagelake.sources import tables


def test_bm25(spark):
    docs = [(1, "abc abd"), (2, "abcabc"), (3, "xyz"), (4, "")]
    corpus = spark.createDataFrame(docs, "cid long, content string")
    tf, dl = retrieval.postings(corpus)
    terms = spark.createDataFrame([(7, "abc"), (7, "xyz")], "query_id long, term string")
    hits = {(r.cid, r.term): r.tf for r in retrieval.term_hits(corpus, spark.createDataFrame([("abc",), ("bcab",), ("xyz",)], "term string")).collect()}
    assert hits == {(1, "abc"): 1, (2, "abc"): 2, (2, "bcab"): 1, (3, "xyz"): 1}
    got = {r.cid: r.score for r in retrieval.bm25_top_k(terms, tf, dl, 10).collect()}
    grams = {i: [t[j : j + 3] for j in range(len(t) - 2)] for i, t in docs}
    avg = sum(map(len, grams.values())) / 4
    for cid, g in grams.items():
        score = 0.0
        for t in ("abc", "xyz"):
            n = sum(t in x for x in grams.values())
            idf = math.log((4 - n + 0.5) / (n + 0.5))
            if f := g.count(t):
                score += (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(g) / avg))
        assert (cid in got) == (score > 0) and math.isclose(got.get(cid, 0), score, abs_tol=1e-6)


def test_terms(spark):
    rows = [("ab \"abcd\" 　xyz",), ("ab",), ("",)]
    got = [r.t for r in spark.createDataFrame(rows, "q string").select(trigram_terms(F.col("q")).alias("t")).collect()]
    assert got[0][:2] == ["abcd", "xyz"]
    assert got[0][2:] == list(dict.fromkeys(t for i in range(0, 11, 2) if (t := 'ab  abcd  　xyz'[i : i + 3]) not in ("abcd", "xyz")))
    assert got[1:] == [[], []]


def test_cuts_cover_the_text():
    text = ("x" * 300 + "。") * 9 + "y" * 2000
    spans = list(chunking.cut_positions(text))
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= 900 for a, b in spans) and all(c == max(a + 1, b - 120) for (a, b), (c, _) in zip(spans, spans[1:]))
    assert text[spans[0][1] - 1] == "。" and list(chunking.cut_positions("")) == []


def test_closed_form_equals_the_loop(spark):
    rows = [(n, "z" * n) for n in (0, 1, 119, 120, 121, 899, 900, 901, 1680, 1681, 5000)]
    got = {}
    for r in chunking.fixed_chunks(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect():
        got.setdefault(r.k, []).append((r.start, r.end))
    assert {k: sorted(v) for k, v in got.items()} == {n: list(chunking.cut_positions(t)) for n, t in rows if n}


def test_quota_applies_only_beyond_top_k(spark):
    rows = [(1, f"e{i}", i, i % 3, 1.0 - i / 10) for i in range(6)] + [(1, "e0", 9, 0, 0.1)]
    df = spark.createDataFrame(rows, "q int, evidence_id string, arrival int, group_no int, score double")
    few = retrieval.evidence_pack(df, ["q"], 6).orderBy("pos").collect()
    assert [r.evidence_id for r in few] == [f"e{i}" for i in range(6)]
    skew = spark.createDataFrame([(1, f"e{i}", i, int(i > 3), 1.0 - i / 10) for i in range(6)], df.schema)
    assert [r.evidence_id for r in retrieval.evidence_pack(skew, ["q"], 3).orderBy("pos").collect()] == ["e0", "e4", "e1"]


def test_records(spark):
    rows = [("g", 0, "c4", None, " 　", "t", "", "1"), ("g", 1, "c1", None, "text", "", "src", "0.8"), ("g", 2, "", "p2", "more", "t", "", "x"), ("g", 3, None, "", "third", None, None, None)]
    df = spark.createDataFrame(rows, "group string, arrival int, chunk_id string, point_id string, content string, title string, source_title string, score string")
    got = retrieval.normalise_records(df, {"g": "policy"}).orderBy("arrival").collect()
    assert [(r.evidence_id, r.document_title, r.score, r.source_type) for r in got] == [("c1", "src", 0.8, "policy"), ("p2", "t", 0.0, "policy"), ("result-3", None, 0.0, "policy")]


def test_markdown_tree(spark, tmp_path):
    (tmp_path / "01_甲" / "sub").mkdir(parents=True)
    (tmp_path / "01_甲" / "sub" / "a b.md").write_bytes("﻿# 标题".encode())
    (tmp_path / "02").mkdir()
    (tmp_path / "02" / "c.md").write_text("x" * 400)
    (tmp_path / "02" / "d.txt").write_text("no")
    files = tables.markdown_files(spark, str(tmp_path))
    got = {r.source_path: (r.category, r.text[:4], r.n_bytes) for r in files.collect()}
    assert got == {"01_甲/sub/a b.md": ("01_甲", "# 标题", 11), "02/c.md": ("02", "xxxx", 400)}
    assert [r.source_path for r in tables.smallest_per_category(files).collect()] == ["02/c.md"]


def test_upsert_and_pages(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (None, "N"), (3, "c")], "id int, v string")
    assert sorted(map(repr, map(tuple, tables.upsert(old, new, ["id"]).collect()))) == sorted(map(repr, [(1, "a"), (2, "B"), (None, "N"), (3, "c")]))
    assert [r.id for r in entities.page(old, [F.desc("v")], 1, 2).collect()] == [None, 2]


def test_long_terms_and_fields(spark):
    """Terms longer than a piece, overlapping places, characters of two units."""
    docs = [(1, "title", "abcabcabcabcabcabcabc"), (1, "content", "x" * 40), (2, "content", "😀ab😀ab"), (3, "content", "the quick brown fox jumps over")]
    corpus = spark.createDataFrame(docs, "cid long, field string, content string")
    words = ["abc", "abcabcabcabcabcabc", "x" * 31, "ab😀", "quick brown fox jumps", "quick brown fox jumpy"]
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    got = {(r.cid, r.field, r.term): r.tf for r in retrieval.term_hits(corpus, terms, keep=["field"]).collect()}
    want = {(c, f, w): n for c, f, t in docs for w in words if (n := sum(t.startswith(w, i) for i in range(len(t))))}
    assert got == want
    for text, n, least in (("abcdef", 3, 3), ("ab", 3, 3), ("a😀b😀c", 3, 2), ("", 2, 1)):
        r = spark.createDataFrame([(text,)], "t string").select(windows(F.col("t"), n, least).alias("w")).first().w
        assert r == [text[i : i + n] for i in range(len(text) - least + 1)]


def test_text_functions_are_linear(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([("the quick " * n,)], "t string").select(retrieval.trigrams(F.col("t")).alias("a"), trigram_terms(F.col("t")).alias("b"), hash_vector(F.col("t")).alias("c"))
        took = []
        for _ in range(3):
            began = time.time()
            df.write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        return min(took)

    seconds(100)
    assert seconds(32000) < 8 * max(0.3, seconds(16000))


def test_index_lifecycle(spark):
    chunks = spark.createDataFrame([(1, 10, 1, "abcd"), (2, 10, 2, "bcde"), (3, 11, 1, "cdef")], "cid long, document_id long, version_id long, content string")
    index = (chunks, *retrieval.postings(chunks))
    new = spark.createDataFrame([(2, 10, 2, "xyz"), (4, 12, 1, "uvw")], chunks.schema)
    index = retrieval.index_upsert(*index, new)
    fresh = retrieval.postings(index[0])
    assert all(sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) for a, b in zip(index[1:], fresh))
    gone = spark.createDataFrame([(10, 1), (12, None)], "document_id long, version_id long")
    left = retrieval.index_delete(*index, gone)
    assert sorted(r.cid for r in left[0].collect()) == [2, 3] and {r.cid for r in left[1].collect()} == {2, 3} == {r.cid for r in left[2].collect()}


def test_records_headings_and_evidence_text(spark):
    text = "# 甲\n## 一局\n职责\n## 二局\n更多职责"
    rows = [("q", 1, "p.md", "01_机构职责", text.index("更多"), "更多职责", "标题", 0.5), ("q", 2, "p.md", "01_机构职责", text.index("职责"), "一局的职责", "标题", 0.4), ("q", 5, "p.md", "02", 20, "别的", "标题", 0.3), ("q", 7, "none.md", "01_机构职责", 3, "缺", "标题", 0.2)]
    chunks = spark.createDataFrame(rows, "q string, rank int, source_path string, category string, start int, content string, title string, score double")
    sources = spark.createDataFrame([("p.md", text), ("other.md", "## x\n")], "source_path string, text string")
    got = retrieval.as_records(retrieval.with_heading(chunks, sources), ["q"]).orderBy("rank").collect()
    assert [r.evidence_id for r in got] == ["E1", "E2", "E3", "E4"] and got[0].title == "[E1] 标题"
    assert "【所属部门（原文标题）】\n二局\n\n更多职责" in got[0].content and [("所属部门" in r.content) for r in got] == [True, False, False, False]
    assert got[2].metadata["category"] == "02" and got[2].metadata["source_title"] == "标题" and got[2].metadata["evidence_id"] == "E3"
    pack = spark.createDataFrame([("q", 2, "E2", None, "源", "kb", "乙", "policy", None, "7"), ("q", 1, "E1", "名", None, "kb", got[0].content, None, "", None)],
                                 "q string, pos int, evidence_id string, document_title string, source_title string, knowledge_base_id string, content string, source_type string, source_case_id string, case_id string")
    said = retrieval.evidence_text(pack, ["q"]).first().text
    assert said.startswith("[E1] \n标题：名\n原文：【以下为") and said.endswith("\n\n[E2] （类型=policy，历史工单号=7）\n标题：源\n原文：乙")
    ok = spark.createDataFrame([("中华人民共和国环境噪声污染防治法（1996）",), ("噪声污染防治法",), (None,)], "t string")
    assert ok.filter(retrieval.in_force(F.col("t"))).count() == 2


def test_expansions(spark):
    q = "夜间施工机械噪声扰民，且占道经营；同时路灯不亮没人管"
    got = retrieval.expand_queries(spark.createDataFrame([(q,), ("  x ",), ("",)], "query string"), retrieval.EXPANSIONS).collect()
    by = [text for needles, text in retrieval.EXPANSIONS if any(n in q for n in needles)]
    assert len(retrieval.EXPANSIONS) == 17 and got[0].subqueries == [q, *by, "夜间施工机械噪声扰民", "路灯不亮没人管"][:8]
    assert [r.subqueries for r in got[1:]] == [["x"], []]


def test_updates_of_one_key_and_lists(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "id int, x string, y string")
    updates = spark.createDataFrame([(1, ["x"], "u", None, 1), (1, ["x", "y"], "v", None, 2), (1, [], "w", "w", 3)], "id int, set_fields array<string>, x string, y string, seq int")
    assert sorted(map(tuple, entities.partial_update(df, updates, "id").collect())) == [(1, "v", None), (2, "c", "d")]
    rows = [([1, 2], [1, 2], True), ([1, 2], [2, 1], False), ([1], [1, 2], False), ([None], [None], True), (None, None, True), (None, [1], False)]
    lists = spark.createDataFrame(rows, "a array<int>, b array<int>, want boolean")
    assert lists.filter(entities.same_positions(F.col("a"), F.col("b")) == F.col("want")).count() == len(rows)
    assert [r.id for r in entities.with_title(df, "A", "x").collect()] == [1]


def test_case_ids_of_records(spark):
    schema = "group string, arrival int, chunk_id string, point_id string, content string, title string, source_title string, score string, category string, document_id long, source_case_id string, case_id string, source_record_id string, work_order_id long"
    rows = [("h", 0, "c", None, "x", "t", "s", "1", "k", 5, None, "77", "88", 9), ("h", 1, "c2", None, "x", None, None, "1", "k", 6, None, None, None, None), ("n", 2, None, None, "x", "t", None, "1", "k", None, None, "", None, None)]
    got = retrieval.normalise_records(spark.createDataFrame(rows, schema), {"h": "case"}).orderBy("arrival").collect()
    assert [(r.full_id, r.document_title, r.external_id, r.source_id, r.case_id, r.work_order_id, r.source_type) for r in got] == [
        ("h:c", "s", "77", "77", "77", "9", "case"), ("h:c2", "k", "c2", "6", None, None, "case"), ("n:result-2", "t", "result-2", "result-2", None, None, "other")]


def test_groups_without_evidence(spark):
    schema = "q string, pos int, evidence_id string, document_title string, source_title string, knowledge_base_id string, content string, source_type string, source_case_id string, case_id string"
    pack = spark.createDataFrame([("a", 1, "E1", "t", None, "kb", "x", None, None, None)], schema)
    got = {r.q: r.text for r in retrieval.evidence_text(pack, ["q"], spark.createDataFrame([("a",), ("b",)], "q string")).collect()}
    assert got["b"] == retrieval.NOTHING_FOUND and got["a"].startswith("[E1]")


def test_titles_threads_and_references(spark):
    import datetime as dt

    today = dt.datetime(2024, 1, 3)
    rows = [(1, "50% off", today), (2, "5000 off", None), (3, None, today - dt.timedelta(hours=1)), (4, "New chat", today - dt.timedelta(days=3)), (5, "a_b", today + dt.timedelta(hours=1))]
    df = spark.createDataFrame(rows, "place int, title string, last_at timestamp")
    find = lambda word: sorted(r.place for r in entities.with_title(df, word).collect())
    assert find("50%") == [1] and find(" OFF ") == [1, 2] and find("new chat") == [3, 4] and find("_") == [5] and find("") == [1, 2, 3, 4, 5] == find(None)
    got = [(r.place, r.bucket) for r in entities.threads(df, None, F.lit(today)).collect()]
    assert got == [(2, "Today"), (5, "Today"), (1, "Today"), (3, "Yesterday"), (4, "Earlier")]
    assert [(r.place, r.bucket) for r in entities.threads(df.filter("place = 2 or last_at is null"), "off", F.lit(today)).collect()] == [(2, None)]
    refs = spark.createDataFrame([(1, 10, "a1"), (2, 10, None), (3, 10, "a2"), (4, 11, "a9"), (5, 99, "a1"), (6, 10, "")], "id int, work_order_id int, analysis_id string")
    orders, analyses = spark.createDataFrame([(10,), (11,)], "id int"), spark.createDataFrame([("a1", 10), ("a2", 11)], "id string, work_order_id int")
    good, bad = entities.owned_references(refs, "work_order_id", "analysis_id", orders, "id", analyses, "id", "work_order_id")
    assert sorted(r.id for r in good.collect()) == [1, 2, 6]
    assert {r.id: r.reason for r in bad.collect()} == {3: "target belongs to another owner", 4: "target not found", 5: "owner not found"}
    rows, missing = entities.known_ids(spark.createDataFrame([(4, 0), (9, 1), (1, 2)], "place int, n int").select(F.col("place").alias("k"), F.col("n").alias("place")), "k", df.select(F.col("place").alias("k"), "title"))
    assert [r.k for r in rows.collect()] == [4, 1] and [r.k for r in missing.collect()] == [9]


def test_batches_are_cut_by_bytes():
    """Python makes dictionaries of no more than about a slice of texts at once."""
    import pyarrow as pa

    texts = ["x" * n for n in (10, 0, 500, 3000, 5, 5)] + [None, "é" * 700, "y"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], names=["k", "body"])
    parts = list(chunking.slices(batch, "body", 1000))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(9)) and len(parts) == 3
    assert all(sum(len((t or "").encode()) for t in p.column("body").to_pylist()[:-1]) < 1000 for p in parts)
    assert list(chunking.slices(batch.slice(0, 0), "body")) == []
