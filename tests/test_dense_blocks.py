"""Cosine top-k by blocks against every pair, by Spark's own sums and in plain Python."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from test_lexical_scan import shuffled_mb
from triagelake.operators import dense_blocks, retrieval


def by_pairs(queries, corpus, k, by):
    w = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "cid")
    return retrieval.dense_scores(queries, corpus, by).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rows_of(df, columns):
    return sorted((tuple(repr(x) for x in r) for r in df.select(columns).collect()))


def test_blocks_find_what_all_pairs_find(spark, monkeypatch):
    monkeypatch.setattr(dense_blocks, "LEAST_ROWS", 100)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).round(1).tolist(), i % 4 if i % 9 else None, i // 2) for i in range(700)]
    rows += [(1000 + i, rows[3][1], 2, 500 + i) for i in range(90)]  # one vector many times
    rows += [(2000, None, 1, 2000), (2001, [1.0, None] + [0.5] * 6, 1, 2001), (2002, [1.0, 2.0], 1, 2002), (2003, [float("nan")] + [1.0] * 7, 2, 2003), (None, rows[5][1], 3, 2004)]
    corpus = spark.createDataFrame(rows, "cid long, v array<double>, label int, pair long")
    queries = corpus.filter("cid % 50 = 0 or cid > 2000").select(F.struct("cid", "label").alias("query_id"), F.col("v").alias("q"))
    for k, by in ((7, []), (3, ["label"]), (40, ["label"])):
        columns = ["query_id", *by, "cid", "score", "rank"]
        assert rows_of(retrieval.dense_top_k(queries, corpus, k, by), columns) == rows_of(by_pairs(queries, corpus, k, by), columns)
    # far fewer rows than pairs are shuffled
    assert dense_blocks.block_top_k(queries, corpus, 7).count() < queries.count() * corpus.count() / 8
    assert retrieval.dense_top_k(queries.limit(0), corpus, 3).count() == 0 and retrieval.dense_top_k(queries, corpus.limit(0), 3).count() == 0


def test_rounding_near_a_half():
    rng = np.random.default_rng(1)
    import pyarrow as pa

    v = rng.integers(-3, 4, size=(3000, 4)).astype(float) / 8
    v[np.abs(v).sum(axis=1) == 0] = 1.0
    q = np.array([[1.0, 0, 0, 0], [0.8, 0.6, 0, 0], [1e-6, 2.0, 0, 0], [1.0, 1.0, 1.0, 1.0]])
    v = np.r_[v, [[0.0000005, 1.0, 0, 0], [0.0000015, 1.0, 0, 0], [-0.0000005, 1.0, 0, 0], [-1e-9, 1, 0, 0]]]
    got = dense_blocks.Cosines(pa.chunked_array([pa.array(v.tolist())])).keys(q, np.full(4, 4))
    for a, x in zip(got, q):
        for b, y in zip(a, v):
            dot = xx = yy = 0.0
            for s, t in zip(x, y):
                dot, xx, yy = dot + s * t, xx + s * s, yy + t * t
            assert b == dense_blocks.half_up(dot / (np.sqrt(xx) * np.sqrt(yy))) and not (b == 0 and np.signbit(b))


def test_evidence_by_blocks(spark):
    """Packs from each block's best are those from all pairs, also where one group has all evidence."""
    rng = np.random.default_rng(9)
    for groups, n in ((3, 90), (1, 13), (1, 12), (4, 400)):
        rows = [(i, rng.normal(size=3).round(1).tolist(), i * 7 % groups) for i in range(n)] + [(n + i, [1.0, 0.5, 0.2], i % groups) for i in range(6)]
        corpus = spark.createDataFrame(rows, "cid long, v array<double>, group_no int").withColumn("evidence_id", F.floor(F.col("cid") / 2))
        queries = corpus.filter("cid < 4").select(F.col("cid").alias("query_id"), F.col("v").alias("q"))
        few = dense_blocks.block_top_k(queries, corpus, 13, ["group_no"], once="evidence_id").withColumnRenamed("cid", "arrival")
        every = retrieval.dense_scores(queries, corpus, ["group_no", "evidence_id"]).withColumnRenamed("cid", "arrival")
        columns = ["query_id", "evidence_id", "group_no", "score", "pos"]
        got, want = (rows_of(retrieval.evidence_pack(x.select("query_id", "group_no", "evidence_id", "arrival", "score"), ["query_id"], 12), columns) for x in (few, every))
        assert got == want


def test_many_blocks_of_a_task_and_passes_of_queries(spark, monkeypatch):
    """Small blocks, little room for what they found, several passes: the rows are those of all pairs."""
    monkeypatch.setattr(dense_blocks, "BLOCK_ROWS", 20)
    monkeypatch.setattr(dense_blocks, "LEAST_QUERIES", 5)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=6).round(1).tolist(), i % 4 if i % 9 else None) for i in range(900)]
    rows += [(1000 + i, rows[3][1], 2) for i in range(60)] + [(2000, None, 1), (2001, [1.0, None] + [0.5] * 4, 1), (2002, [float("nan")] + [1.0] * 5, 2), (None, rows[5][1], 3)]
    corpus = spark.createDataFrame(rows, "cid long, v array<double>, label int")
    queries = corpus.filter("cid % 50 = 0 or cid > 2000").select(F.struct("cid", "label").alias("query_id"), F.col("v").alias("q"))
    for state in (1 << 21, 300, 10):
        monkeypatch.setattr(dense_blocks, "STATE", state)
        for k, by in ((7, []), (3, ["label"])):
            columns = ["query_id", *by, "cid", "score", "rank"]
            assert rows_of(retrieval.dense_top_k(queries, corpus, k, by), columns) == rows_of(by_pairs(queries, corpus, k, by), columns)


def test_what_is_shuffled_grows_with_the_rows(spark, monkeypatch):
    """Eight times the rows and queries: the copies of rows and the rows found by each block grew by more."""
    monkeypatch.setattr(dense_blocks, "LEAST_ROWS", 100)
    before, made = spark.conf.get("spark.sql.shuffle.partitions"), []
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        for n in (1000, 8000):
            corpus = spark.range(n).select(F.col("id").alias("cid"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.sin(F.col("id") * 7 + i * i)).alias("v"))
            queries = corpus.filter("cid % 10 = 0").select(F.col("cid").alias("query_id"), F.col("v").alias("q"))
            found = retrieval.dense_top_k(queries, corpus, 5)
            assert found.count() == n // 10 * 5
            found.collect()
            made.append((dense_blocks.block_top_k(queries, corpus, 5).count(), shuffled_mb(spark, found)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert made[1][0] <= 8 * made[0][0] and made[1][1] < 10 * made[0][1]
