"""The toxicity score walked in plain Python: trees, link, isotonic curve, decision."""

import bisect
import math

import pytest

from triagelake.llm import toxicity

SF = "/root/testdata/sf0.01"


def walk(node, x):
    """The value of one regression tree."""
    while node.subtreeDepth():
        split = node.split()
        node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
    return node.prediction()


def on_curve(at, value, p):
    """Between the curve's points on the line through them, outside as its ends."""
    if p <= at[0]:
        return value[0]
    if p >= at[-1]:
        return value[-1]
    i = bisect.bisect_left(at, p)
    if at[i] == p:
        return value[i]
    return value[i - 1] + (value[i] - value[i - 1]) * (p - at[i - 1]) / (at[i] - at[i - 1])


def test_scores_by_hand(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.ToxicityModel(docs, labels)
    roots = [(t._java_obj.rootNode(), w) for t, w in zip(model.trees.trees, model.trees.treeWeights)]
    at, value = model.curve.boundaries.toArray().tolist(), model.curve.predictions.toArray().tolist()
    assert len(roots) == 15 and at == sorted(at) and value == sorted(value) and 0 <= value[0] <= value[-1] <= 1
    odd = [(-1, ""), (-2, None), (-3, " \n"), (-4, "YOU!!! you y0u " * 3000), (-5, "é" * 500)]
    rows = spark.createDataFrame(odd, "doc_id long, text string").unionByName(docs.filter("doc_id % 9 = 0").select("doc_id", "text"))
    texts = {r.doc_id: r.text for r in rows.collect()}
    got = {r.doc_id: r for r in model.score(rows, ["doc_id"]).collect()}
    assert len(got) == len(texts) > 100
    for i, text in texts.items():
        x = toxicity.features(text, model.stems)
        margin = sum(w * walk(root, x) for root, w in roots)
        p = 1 / (1 + math.exp(-2 * margin))
        score = 0.999 * on_curve(at, value, p) + 0.001 * p
        assert got[i].score == pytest.approx(score, abs=1e-9), i
        assert got[i].predicted == int(got[i].score >= 0.5) and 0 <= got[i].score <= 1


def test_one_kind_of_label_or_none(spark):
    """Without labels of both kinds every text still has a score; an empty table has none."""
    docs = spark.createDataFrame([(1, "you idiot"), (2, ""), (None, None), (2, "")], "doc_id long, text string")
    for rows in ([], [(1, 1), (2, 1)], [(None, 1), (7, None)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        got = toxicity.score_documents(docs, labels).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        assert toxicity.score_documents(docs.limit(0), labels).count() == 0
