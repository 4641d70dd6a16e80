"""Search by two passes over the texts, against plain counting and the stored index."""

import math
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
from test_lexical_index import plain
from triagelake.operators import lexical_index, lexical_scan, retrieval


def check(spark, docs, queries, k, weights=None, kind="long", **how):
    names = sorted({f for fields in docs.values() for f in fields})
    corpus = spark.createDataFrame([(c, *(fields.get(f) for f in names)) for c, fields in docs.items()], f"cid {kind}, " + ", ".join(f"{f} string" for f in names)).repartition(3)
    terms = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query_id long, term string")
    got = sorted(tuple(r) for r in lexical_scan.scan(corpus, {f: f for f in names}, terms, k, weights, **how).collect())
    want = sorted(plain(docs, queries, k, weights))
    assert [(q, c, n) for q, c, _, _, n in got] == [(q, c, n) for q, c, _, _, n in want]
    assert all(math.isclose(x, y, abs_tol=2e-6) for g, w in zip(got, want) for x, y in zip(g[2:4], w[2:4]))


def test_scan_equals_counting(spark):
    rnd = random.Random(4)
    pool = ["abc", "abcabc", "xyz ", "城市管理", "😀ab😀", "the quick brown fox", "İx", "ab"]
    docs = {i: {"title": rnd.choice(pool), "content": " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9)))} for i in range(60)}
    docs[60], docs[61], docs[62] = {"content": None}, {"content": ""}, {"content": docs[3]["content"], "title": docs[3]["title"]}
    queries = {1: ["abc", "bca", "quick brown"], 2: ["城市管", "管理 "], 3: ["😀ab", "ab😀 "], 4: ["nowhere"], 5: ["the quick brown fox", "abcabcabc", "cab"], 6: ["bca", "xyz", "fox"]}
    for k in (1, 5, 100):
        check(spark, docs, queries, k, query_group=2)
    check(spark, docs, queries, 5, {"title": 2.0, "content": 1.0})
    check(spark, {f"id{c:03}": t for c, t in docs.items()}, queries, 5, kind="string")


def test_counts_with_small_tables_and_slices(monkeypatch):
    """Overlaps, terms that are parts of each other, pieces of one text, no table of all keys, few places at once."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("aab") for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    names = sorted({"".join(rnd.choice("aab") for _ in range(n)) for n in (3, 3, 3, 4, 4, 5, 6, 7, 8, 9, 10, 14) for _ in range(4)})
    whose = np.array([i // 2 for i in range(40)])
    want = [[sum(t.startswith(w, i) for t in texts[2 * d : 2 * d + 2] for i in range(len(t))) for d in range(20)] for w in names]
    for dense, places in ((1 << 24, 1 << 21), (0, 7)):
        monkeypatch.setattr(lexical_scan, "DENSE", dense)
        monkeypatch.setattr(lexical_scan, "PLACES", places)
        assert lexical_scan.Terms(names).counts([lexical_scan.code_points(t) for t in texts], whose, 20).tolist() == want


def test_rows_of_one_id_are_one_text_and_rows_without_id_go(spark):
    rows = [(1, "needle one"), (2, "other words"), (1, "needle two"), (None, "needle"), (3, "needle"), (4, None)]
    corpus = spark.createDataFrame(rows, "cid long, content string")
    terms = spark.createDataFrame([(7, "needle"), (7, "two"), (8, "nothing")], "query_id long, term string")
    got = [tuple(r) for r in lexical_scan.scan(corpus, {"": "content"}, terms, 5).collect()]
    index = lexical_index.search(lexical_index.build_index(corpus), terms, 5)
    assert sorted(got) == sorted(tuple(r) for r in index.collect()) and {r[1] for r in got} == {1, 3}


def test_empty_corpus_and_empty_queries(spark):
    none = spark.createDataFrame([], "cid long, content string")
    some = spark.createDataFrame([(1, "abcd"), (None, "abcd")], none.schema)
    terms = spark.createDataFrame([(1, "abc"), (2, None)], "query_id long, term string")
    assert lexical_scan.scan(none, {"": "content"}, terms, 3).collect() == []
    assert lexical_scan.scan(some, {"": "content"}, terms.limit(0), 3).collect() == []
    assert [r.cid for r in lexical_scan.scan(some, {"": "content"}, terms, 3).collect()] == [1]


def test_slices_lose_nothing():
    texts = [["a" * 700_000, "b"], [], ["c" * 3_000_000], ["d"], [None], ["e" * 400_000]] * 2
    rows = [[{"field": "f", "content": t} for t in row] for row in texts]
    whole = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.struct([("field", pa.string()), ("content", pa.string())])))], names=["parts"])
    for batch, want in ((whole, rows), (whole.slice(3, 6), rows[3:9])):
        for most in (1, 2, 100):
            parts = list(lexical_scan.slices(iter([batch]), most))
            assert [r for p in parts for r in p.column("parts").to_pylist()] == want and max(map(len, parts)) <= most
            assert all(len(p) == 1 or sum(len(x["content"] or "") for r in p.column("parts").to_pylist()[:-1] for x in r) < lexical_scan.SLICE_BYTES for p in parts)


def test_ties_of_tasks_go_to_smaller_ids(spark):
    docs = {i: {"content": "same words"} for i in range(300)}
    docs[300] = {"content": "another text of its own"}
    check(spark, docs, {1: ["same", "words"]}, 7)
    check(spark, {f"{i}": t for i, t in docs.items()}, {1: ["same", "words"]}, 7, kind="string")


def shuffled_mb(spark, df):
    """MB that the exchanges of a finished query wrote."""
    total, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
            continue
        metric = node.metrics().get("shuffleBytesWritten")
        total += metric.get().value() if metric.isDefined() else 0
        if "QueryStage" in node.getClass().getSimpleName():
            left.append(node.plan())
        left += [node.children().apply(i) for i in range(node.children().size())]
    return total / 1e6


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd, folder = random.Random(6), tmp_path_factory.mktemp("tables")
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    spark.createDataFrame([(i, "s", " ".join(rnd.choice(words) for _ in range(60))) for i in range(3000)], "doc_id long, source string, text string").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, " ".join(rnd.choice(words) for _ in range(20))) for i in range(20)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, i % 3, [rnd.random() for _ in range(4)]) for i in range(400)], "vec_id long, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize(("name", "rows"), [("bm25_topk", 200), ("bm25_weighted", 200), ("hybrid_search", 48), ("hybrid_search_by_category", 144)])
def test_no_text_or_posting_is_shuffled_or_written(spark, tables, name, rows):
    """What the lexical queries stage and shuffle grows with tasks, not with texts (the stored index wrote
    every place of every trigram, and shuffled texts and hits)."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.rglob("*.parquet"))
    got = __spark_entry__.queries()[name](spark, tables)
    assert len(got.collect()) == rows
    assert shuffled_mb(spark, got) < 0.3
    assert sum(f.stat().st_size for f in set(shared.rglob("*.parquet")) - before if f.is_file()) < 300_000


@pytest.mark.parametrize("name", ["hybrid_search", "hybrid_search_by_category"])
def test_each_search_of_a_hybrid_query_is_made_once(spark, tables, name):
    """One ranking of texts and one of vectors (the fusion used both lists twice, and each was made twice)."""
    got = __spark_entry__.queries()[name](spark, tables)
    got.collect()
    made, left = [], [got._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
            continue
        made += [kind] if "Arrow" in kind else []
        left += [node.plan()] if "QueryStage" in kind else []
        left += [node.children().apply(i) for i in range(node.children().size())]
    assert len(made) == 2, made


def test_fusion_of_several_lists(spark):
    """Shares of all sub-queries are summed, scores are the best of each kind, and rows without a key go."""
    rows = [(1, "a", 0, 0, 10, 1, 0.9), (1, "a", 0, 1, 10, 3, 7.0), (1, "a", 1, 0, 10, 2, 0.95), (1, "a", 1, 0, 11, 1, 0.99), (1, None, 0, 0, 10, 1, 0.5), (1, "a", 0, 0, None, 2, 0.5)]
    ranked = spark.createDataFrame(rows, "query_id long, label string, sub int, src int, cid long, rank int, score double")
    got = {r.cid: (r.label, r.rrf, r.dense, r.lexical, tuple(r.round), tuple(r.first_seen)) for r in retrieval.fuse(ranked, ["query_id", "label"]).collect()}
    assert got == {10: ("a", round(1 / 61 + 1 / 63 + 1 / 62, 9), 0.95, 7.0, (1, 0), (0, 0, 1)), 11: ("a", round(1 / 61, 9), 0.99, 0.0, (1, 1), (1, 0, 1))}
