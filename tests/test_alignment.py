"""Differences by ranges, repair by version, samples of both sides, links, reports."""

import hashlib
import json
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from triagelake.operators import alignment


def ids(spark, keys, kind="string"):
    return spark.createDataFrame([(k,) for k in keys], f"key {kind}")


def test_range_diff_equals_set_differences(spark):
    keys = [f"k{i}" for i in range(3000)]
    expected, actual = keys + [None], [k for i, k in enumerate(keys) if i % 500] + ["other", "k"]
    for leaves in (1, 7, 512):
        got = alignment.range_diff(ids(spark, expected).repartition(3), ids(spark, actual), "key", leaves)
        want = {(k, "missing") for k in set(expected) - set(actual)} | {(k, "extra") for k in set(actual) - set(expected)}
        rows = [tuple(r) for r in got.collect()]
        assert set(rows) == want and len(rows) == len(want)
    none = ids(spark, [])
    assert alignment.range_diff(none, none, "key").count() == 0
    assert alignment.range_diff(none, ids(spark, ["a"]), "key").collect() == [("a", "extra")]
    # repeated keys, an even number of which cancel in a XOR
    assert alignment.range_diff(ids(spark, ["a", "b"]), ids(spark, ["b", "b", "a"]), "key", 1).count() == 0
    assert alignment.range_diff(ids(spark, ["b", "b"]), ids(spark, ["a", "a"]), "key", 1).count() == 2


def test_only_differing_ranges_are_compared(spark):
    """Of 5,000 keys with three differences those in three of 1,024 ranges are read, by kept digests, too."""
    keys = [f"k{i}" for i in range(5000)]
    one, other = ids(spark, keys), ids(spark, keys[3:])
    digests = tuple(alignment.range_digests(x, "key", 1024) for x in (one, other))
    leaves = {r.leaf for r in alignment.differing_leaves(*digests).collect()}
    at = one.withColumn("leaf", alignment.leaf_of("key", 1024))
    assert leaves == {r.leaf for r in at.filter(F.col("key").isin(keys[:3])).collect()}
    assert at.filter(F.col("leaf").isin(list(leaves))).count() < 60
    got = alignment.range_diff(one, other, "key", 1024, digests)
    assert sorted(map(tuple, got.collect())) == [(k, "missing") for k in keys[:3]]


def test_repair_by_version(spark):
    chunks = spark.createDataFrame([(100 - i, i, 1 + i // 6, 10 + i // 3) for i in range(12)], "id long, chunk_no long, document_id long, version_id long")
    missing = spark.createDataFrame([(i,) for i in (100, 99, 98, 97, 90, 90, 5)], "id long")
    key = lambda batch, *at: hashlib.sha256(f"repair:{batch}:{':'.join(map(str, at))}".encode()).hexdigest()
    got = {(r.document_id, r.version_id, r.part): (r.idempotency_key, r.total_items) for r in alignment.repair_by_version(missing, chunks).collect()}
    assert got == {(1, 10, 0): (key("default", 100, 99, 98), 3), (1, 11, 0): (key("default", 97), 1), (2, 13, 0): (key("default", 90), 1)}
    parts = alignment.repair_by_version(missing, chunks, "b", items_a_job=2).filter("version_id = 10").orderBy("part").collect()
    assert [(r.idempotency_key, r.total_items) for r in parts] == [(key("b", 100, 99), 2), (key("b", 98), 1)]
    assert alignment.repair_by_version(missing.limit(0), chunks).count() == 0


def test_alignment_of_the_same_keys(spark):
    rows = [(i, "x" if i % 7 else None) for i in range(60)]
    points = [(i, "x") for i in range(10, 80)] + [(i, "y") for i in range(20, 25)] + [(None, "x")]
    schema = "key long, v string"
    r, p = spark.createDataFrame(rows, schema), spark.createDataFrame(points, schema)
    for k in (5, 30, 1000):
        names = sorted({i for i, _ in rows + points if i is not None}, key=lambda i: hashlib.sha256(f"{i}:42".encode()).hexdigest())[:k]
        assert [x[0] for x in alignment.sampled_keys([r, p], "key", k).collect()] == names
        value = dict(rows)
        seen = [x for x in points if x[0] in names]
        wrong = [x for x in seen if x[0] in value and value[x[0]] != x[1]]
        mine = [i for i in value if i in names]
        want = {
            "points_to_rows": (len(seen), sum(i not in value for i, _ in seen), len(wrong)),
            "rows_to_points": (len(mine), sum(all(i != j for j, _ in points) for i in mine), len({i for i, _ in wrong})),
        }
        got = {x.direction: x for x in alignment.alignment(r, p, "key", "v", k).collect()}
        for way, (n, missing, bad) in want.items():
            x = got[way]
            assert (x.checked, x.missing, x.mismatched) == (n, missing, bad)
            rate = (missing + bad) / n
            half = 1.96 * math.sqrt(rate * (1 - rate) / n + 1.96**2 / (4 * n * n))
            middle = rate + 1.96**2 / (2 * n)
            assert x.low == pytest.approx(max(0, (middle - half) / (1 + 1.96**2 / n)), abs=1e-9) and x.high == pytest.approx(min(1, (middle + half) / (1 + 1.96**2 / n)))
    empty = alignment.alignment(r.limit(0), p.limit(0), "key", "v").collect()
    assert [(x.checked, x.rate, x.low, x.high) for x in empty] == [(0, None, 0.0, 1.0)] * 2


def test_linked_points(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    cases = spark.createDataFrame([(1, sha("a"), "c1"), (2, sha("a"), "c2"), (3, sha("b"), "c3"), (4, sha(""), "c4"), (5, sha("e"), "")], "place long, body_sha256 string, source_case_id string")
    orders = spark.createDataFrame([("c2", "w2"), ("c4", "w4"), ("", "w0"), (None, "w")], "source_case_id string, work_order_id string")
    points = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z"), (5, "a"), (6, "e")], "point_id long, content string")
    got = {r.point_id: (r.source_case_id, r.work_order_id, r.matched) for r in alignment.linked_points(points, cases, orders).collect()}
    none = (None, None, False)
    assert got == {1: ("c2", "w2", True), 5: ("c2", "w2", True), 2: none, 3: ("c4", "w4", True), 4: none, 6: none}


def test_unknown_ids_files_and_reports(spark, tmp_path):
    known = ids(spark, ["a", "b"])
    assert {r.key for r in alignment.known_or_error(ids(spark, ["b", "b"]), known, "key").collect()} == {"b"}
    assert alignment.known_or_error(ids(spark, []), known, "key").count() == 0
    with pytest.raises(Exception, match="unknown id: c"):
        alignment.known_or_error(ids(spark, ["a", "c"]), known, "key").collect()
    files = spark.createDataFrame([("b.md",), ("a/z.md",), ("a/b.md",)], "source_path string")
    assert [r.source_path for r in alignment.first_files(files, 2).collect()] == ["a/b.md", "a/z.md"]
    assert alignment.first_files(files, None).count() == 3 == alignment.first_files(files, 0).count()
    report = spark.createDataFrame([(3, None, ["部门"])], "total long, first string, names array<string>")
    alignment.write_report(report, f"{tmp_path}/report")
    parts = [f for f in Path(tmp_path, "report").iterdir() if f.name.startswith("part-")]
    assert [json.loads(x) for f in parts for x in f.read_text().splitlines()] == [{"total": 3, "first": None, "names": ["部门"]}] and "部门" in parts[0].read_text()
