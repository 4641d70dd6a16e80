"""Exact top-k against brute force, SQL of the queries, the registry's guard."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

import corpus_pipeline
from plain_passages import clean
from test_text_operators import brute_components
from test_tokens import check_packing
from triagelake.llm import quality, queries, topk, toxicity
from triagelake.llm.common import stage_table

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


def brute_top_k(rows, k, scale):
    clean = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in clean:
        if q % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in clean if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(1, 450)]
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 16), (503, [float("inf")] * 16), (600, rows[3][1]), (601, rows[3][1]), (602, [])]
    rows += [(700, (rng.normal(size=16) * 1e6).astype(np.float32).tolist()), (None, rows[0][1])]
    schema = "vec_id long, embedding array<float>, label int, score int, rank int, q int, block int"
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], schema)
    for k in (1, 10, 1000):
        got = topk.top_k(df.repartition(3), F.col("vec_id") % 100 == 0, k=k, query_rows=3, candidate_rows=50)
        assert sorted(map(tuple, got.collect())) == brute_top_k(rows, k, 1024)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_of_huge_components(spark):
    """Sums of more than 53 bits are exact; what 64 bits cannot hold is an error."""
    rng = np.random.default_rng(6)
    schema = "vec_id long, embedding array<double>"
    rows = [(i * 50, [float(x) * 2.0**15 for x in rng.integers(-1000, 1000, 8)]) for i in range(1, 40)]
    rows += [(100 * i + 7, [float(x) for x in rng.integers(-9, 9, 8) * 2.0**20]) for i in range(6)] + [(5000, rows[3][1])]
    got = topk.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0, k=4, scale=16.0)
    clean = [(i, [math.floor(16.0 * x) for x in v]) for i, v in rows]
    want = []
    for q, a in clean:
        if q % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in clean if i != q)
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:4])]
    assert sorted(map(tuple, got.collect())) == sorted(want) and max(abs(r[3]) for r in want) > 2**56
    for huge in (1e30, 1e18):
        bad = spark.createDataFrame([(100, [huge, 1.0]), (200, [huge, 1.0])], schema)
        with pytest.raises(Exception, match="2\\*\\*62|64 bits"):
            topk.top_k(bad, F.col("vec_id") % 100 == 0, k=1, scale=1.0).collect()


def test_lists_and_slices_that_norms_rule_out():
    """Local scores taken in phases two and three: well below all where norms differ, and
    no more than all where they do not; the rows are those of brute force."""
    rng = np.random.default_rng(7)
    for spread, most in ((1.0, 0.5), (0.0, 1.0)):  # 0.38 of all where norms differ
        c = (rng.normal(size=(4096, 32)) * np.exp(spread * rng.normal(size=(4096, 1))) * 1024).astype(np.int64)
        c = c[np.argsort(-(c.astype(float) ** 2).sum(axis=1))]
        q, k = c[::100][:40], 10
        ids, q_ids = np.arange(len(c)), np.arange(len(c))[::100][:40]
        n = topk.gathered(len(c), k)
        best = {}
        for i, s in topk.phase_one(q_ids, q, ids[:n], c[:n], k, 4):
            best.setdefault(i, []).append(int(s))
        cut = np.array([sorted(best[i])[-k] for i in q_ids], float)
        done = []
        got = {(r.query_id, r.vec_id): r.score for f in topk.phases_two_and_three(q_ids, q, cut, ids, c, 4, done=done) for r in f.itertuples()}
        full = q @ c.T
        want = {(int(a), int(b)): int(full[i, b]) for i, a in enumerate(q_ids) for b in np.nonzero(full[i] >= cut[i])[0] if a != b}
        assert got == want and len(got) >= k * len(q)
        assert sum(done) <= most * 4 * len(q) * len(c), sum(done) / (4 * len(q) * len(c))


def test_queries_equal_sql(spark):
    for name, sql in queries.ORACLES.items():
        assert compare(spark, queries.QUERIES[name], sql, SF) == "", name


def test_pipeline(spark):
    """Each stage's ids and texts against plain loops over its own input (the
    toxicity stage against the scores of its model)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "line_dedup", "near_duplicates", "packing"]
    at, stages = docs, dict(corpus_pipeline.STAGES)

    def step(name):
        out = stages[name](spark, at, SF)
        assert out.dtypes == docs.dtypes
        return stage_table(spark, out, "stage")

    crf = quality.train(docs, labels)
    want = {r.doc_id for r in docs.collect() if quality.verdict(crf, r.text, 0.5)[6]}
    at = step("quality")
    assert {r.doc_id for r in at.collect()} == want

    scores = toxicity.score_documents(at, labels).collect()
    at = step("toxicity")
    assert {r.doc_id for r in at.collect()} == {r.doc_id for r in scores if r.predicted == 0}

    before = {r.doc_id: r.text for r in at.collect()}
    brute = dict(clean(sorted(before.items()), runs=True))
    at = step("line_dedup")
    rows = at.collect()
    assert {r.doc_id: r.text for r in rows} == {i: t for i, t in brute.items() if t == before[i] or t.strip()}
    assert all(r.n_chars == len(r.text) for r in rows)

    groups = {d: c for d, _, c in brute_components(at, 5, 80)}
    at = step("near_duplicates")
    assert {r.doc_id for r in at.collect()} == {d for d, c in groups.items() if d == c}

    packed = stages["packing"](spark, at, SF).collect()
    check_packing(at, packed, 1024)
    run = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert {(r.doc_id, r.doc_tokens) for r in run} == {(r.doc_id, r.doc_tokens) for r in packed} and sum(r.length for r in run) == sum(r.length for r in packed)
    assert len({key(r) for r in run}) == len(run)


def test_the_rest_works_without_this_subpackage(tmp_path):
    """A copy of the repository without the operators still offers its queries."""
    code = (
        "import sys; sys.modules['triagelake.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_search' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_the_rest_works_when_both_folders_are_deleted(tmp_path):
    """Without llm, its tests and the pipeline every other module imports and every other query is there."""
    gone = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "*.json", "*.md")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=gone)
    code = (
        "import importlib, pkgutil, triagelake, __spark_entry__ as e\n"
        "for m in pkgutil.walk_packages(triagelake.__path__, 'triagelake.'): importlib.import_module(m.name)\n"
        "q = e.queries(); assert len(q) >= 68 and not any(n.startswith('op') and n[2].isdigit() for n in q) and set(e.oracle_sql()) == set(q)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
