"""The stored index against plain counting."""

import math
import random

from pyspark.sql import functions as F

from triagelake.operators import lexical_index as lex
from triagelake.operators import retrieval
from triagelake.sources.staging import shared_path


def plain(docs, queries, k, weights=None, k1=1.2, b=0.75):
    """docs: {cid: {field: text}}; queries: {query: terms}.  (query, cid, plain, score, rank)."""
    texts = {c: {f: (t or "").lower() for f, t in fields.items()} for c, fields in docs.items()}
    size = {c: sum(max(0, len(t) - 2) for t in fields.values()) for c, fields in texts.items()}
    mean, out = sum(size.values()) / len(size), []
    times = lambda w, t: sum(t.startswith(w, i) for i in range(len(t)))
    for q, terms in queries.items():
        totals = {}
        for w in terms:
            tf = {c: {f: times(w, t) for f, t in fields.items()} for c, fields in texts.items()}
            tf = {c: fields for c, fields in tf.items() if sum(fields.values())}
            idf = math.log((len(docs) - len(tf) + 0.5) / (len(tf) + 0.5))
            idf = idf if idf > 0 else 1e-6
            for c, fields in tf.items():
                norm = k1 * (1 - b + b * size[c] / mean)
                a, h = sum(fields.values()), sum(n * (weights or {}).get(f, 0 if weights else 1) for f, n in fields.items())
                one = totals.setdefault(c, [0.0, 0.0])
                one[0] += idf * a * (k1 + 1) / (a + norm)
                one[1] += idf * h * (k1 + 1) / (h + norm)
        best = sorted(totals.items(), key=lambda x: (-round(x[1][0], 6), x[0]))[:k]
        out += [(q, c, round(p, 6), round(h, 6), n + 1) for n, (c, (p, h)) in enumerate(best)]
    return out


def check(spark, docs, queries, k, weights=None, kind="long", **how):
    rows = [(c, f, t) for c, fields in docs.items() for f, t in fields.items()]
    corpus = spark.createDataFrame(rows, f"cid {kind}, field string, content string").repartition(3)
    index = lex.build_index(corpus, field="field", block_docs=how.pop("block_docs", 7))
    terms = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query_id long, term string")
    path = shared_path(spark, "index")
    index.write(path)
    got = sorted(tuple(r) for r in lex.search(lex.LexicalIndex.read(spark, path), terms, k, weights, **how).collect())
    want = sorted(plain(docs, queries, k, weights))
    assert [(q, c, n) for q, c, _, _, n in got] == [(q, c, n) for q, c, _, _, n in want]
    assert all(math.isclose(x, y, abs_tol=2e-6) for g, w in zip(got, want) for x, y in zip(g[2:4], w[2:4]))


def test_search_equals_counting(spark):
    rnd = random.Random(4)
    pool = ["abc", "abcabc", "xyz ", "城市管理", "😀ab😀", "the quick brown fox", "İx", "ab"]
    docs = {i: {"title": rnd.choice(pool), "content": " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9)))} for i in range(60)}
    docs[60], docs[61], docs[62] = {"content": None}, {"content": ""}, {"content": docs[3]["content"], "title": docs[3]["title"]}
    queries = {1: ["abc", "bca", "quick brown"], 2: ["城市管", "管理 "], 3: ["😀ab", "ab😀 "], 4: ["nowhere"], 5: ["the quick brown fox", "abcabcabc", "cab"], 6: ["bca", "xyz", "fox"]}
    for k in (1, 5, 100):
        check(spark, docs, queries, k, query_group=2)
    check(spark, docs, queries, 5, {"title": 2.0, "content": 1.0}, block_docs=1000)
    check(spark, {f"id{c:03}": t for c, t in docs.items()}, queries, 5, kind="string")


def test_blocks_that_cannot_win_are_not_scored(spark):
    rare = {i: {"content": f"common words number {i} " + ("needle needle needle" if i % 50 == 0 else "")} for i in range(400)}
    corpus = spark.createDataFrame([(c, t["content"]) for c, t in rare.items()], "cid long, content string")
    index = lex.build_index(corpus, block_docs=10).staged()
    terms = spark.createDataFrame([(1, "needle"), (1, "common"), (1, "number 5")], "query_id long, term string")
    counts: list[int] = []
    got = [(r.cid, r.rank) for r in lex.search(index, terms, 1, skipped=counts).orderBy("rank").collect()]
    want = [(c, n) for _, c, _, _, n in plain(rare, {1: ["needle", "common", "number 5"]}, 1)]
    assert got == want and counts[1] < counts[0] / 2


def test_empty_corpus_and_empty_queries(spark):
    none = spark.createDataFrame([], "cid long, content string")
    some = spark.createDataFrame([(1, "abcd"), (None, "abcd")], none.schema)
    terms = spark.createDataFrame([(1, "abc")], "query_id long, term string")
    assert lex.search(lex.build_index(none), terms, 3).collect() == []
    assert lex.search(lex.build_index(some), terms.limit(0), 3).collect() == []
    assert [r.cid for r in lex.search(lex.build_index(some), terms, 3).collect()] == [1]


def test_postings_count_every_trigram(spark):
    texts = ["abcabc", "ab", "xabcx", None]
    corpus = spark.createDataFrame(list(enumerate(texts)), "cid long, content string")
    got = {r.gram: r.n for r in lex.build_index(corpus).postings.groupBy("gram").agg(F.sum(F.aggregate("tfs", F.lit(0), lambda a, x: a + x)).alias("n")).collect()}
    want = {}
    for t in texts:
        for i in range(len(t or "") - 2):
            want[lex.gram_key(t[i : i + 3])] = want.get(lex.gram_key(t[i : i + 3]), 0) + 1
    assert got == want


def test_totals_of_trigrams(spark):
    """Counted within tasks as from the postings: ids in several rows, null ids and texts, short
    texts, characters beyond the first plane."""
    rows = [(i % 40 if i % 7 else None, "Ab c" * (i % 5) + "𝒳ya𝒳ya" * (i % 3) + "é"[: i % 2]) for i in range(120)] + [(500, None), (501, "ab"), (502, ""), (503, "ABC abc aBC")]
    corpus = spark.createDataFrame(rows, "cid long, content string")
    pairs = {}
    for cid, text in rows:
        low = (text or "").lower()
        for i in range(len(low) - 2):
            pairs.setdefault(low[i : i + 3], []).append(cid)
    got = {r.term: (r.df, r.n) for r in lex.term_totals(corpus).collect()}
    assert got == {t: (len(set(c)), len(c)) for t, c in pairs.items()}
    one = corpus.filter("cid > 499")
    tf, _ = retrieval.postings(one)
    assert {(r.term, r.n) for r in tf.groupBy("term").agg({"tf": "sum"}).toDF("term", "n").collect()} == {(r.term, r.n) for r in lex.term_totals(one).collect()}
