"""Vector cells, leases as a stream and the department master against plain loops."""

import datetime as dt
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from triagelake.operators import masters, retrieval, vector_cells
from triagelake.streaming import leases


def test_cells_find_what_a_full_search_finds(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 4
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * 0.4).astype(float).tolist(), i % 3, i % 5 == 0) for i in range(900)]
    rows += [(1000, None, 0, False), (1001, [0.0] * 16, 0, False), (1002, [float("nan")] * 16, 0, False), (1003, rows[7][1], 1, False), (1004, rows[7][1], 1, False)]
    corpus = spark.createDataFrame(rows, "cid long, v array<double>, label int, active boolean")
    queries = corpus.filter("cid % 97 = 0 and cid < 900").select(F.col("cid").alias("query_id"), F.col("v").alias("q"))
    index = vector_cells.build_cells(corpus, n_cells=16, sample_rows=400, keep=["label", "active"])
    sound = corpus.filter("cid not in (1000, 1001, 1002)")
    for where in (None, F.col("active") & (F.col("label") < 2)):
        counts: list[int] = []
        got = sorted(tuple(r) for r in vector_cells.search_cells(index, queries, 7, where, counts).select("query_id", "cid", "score", "rank").collect())
        base = sound if where is None else sound.filter(where)
        want = sorted(tuple(r) for r in retrieval.dense_top_k(queries, base.select("cid", "v"), 7).select("query_id", "cid", "score", "rank").collect())
        assert got == want and counts[1] < counts[0] / 2
    few = vector_cells.search_cells(index, queries, 5000)
    assert few.count() == queries.count() * sound.count()
    assert vector_cells.search_cells(vector_cells.build_cells(corpus.limit(0)), queries, 3).count() == 0


def test_latest_points(spark):
    rows = [(1, 1, "a", False), (1, 2, "b", False), (2, 5, "c", False), (2, 6, "d", True), (3, 1, "e", None)]
    df = spark.createDataFrame(rows, "cid int, version int, v string, deleted boolean")
    assert sorted((r.cid, r.v) for r in vector_cells.latest_points(df).collect()) == [(1, "b"), (3, "e")]


START = dt.datetime(2024, 1, 1)


def lease_events(seed: int, n: int = 520) -> list[tuple]:
    rnd, out = random.Random(seed), []
    for seq in range(n):
        kind = rnd.choice(["enqueue", "claim", "claim", "heartbeat", "heartbeat", "heartbeat", "finish", "fail", "cancel"] if rnd.random() < 0.6 else ["enqueue", "claim", "heartbeat"])
        out.append((rnd.randrange(14), START + dt.timedelta(seconds=seq * 9), seq, kind, rnd.choice(["w1", "w1", "w2"])))
    return out


def test_leases_of_a_stream_equal_a_plain_loop(spark, tmp_path):
    events, lease, attempts = lease_events(4), 120, 2
    end = START + dt.timedelta(days=1)
    want, jobs = [], {}
    for job, at, _, kind, owner in [*events, *((j, end, 10**6, "nothing", None) for j in range(14))]:
        s = jobs.setdefault(job, {"status": "none", "owner": None, "until": None, "n": 0, "cancel": False})
        say = lambda when, what, who, job=job, s=s: want.append((job, when, what, who, s["n"]))
        if s["status"] == "running" and s["until"] < at:
            s["status"] = "over" if s["n"] >= attempts else "waiting"
            say(s["until"], "exhausted" if s["status"] == "over" else "expired", s["owner"])
        held = s["status"] == "running" and s["owner"] == owner
        if kind == "enqueue" and s["status"] == "none":
            s["status"] = "waiting"
            say(at, "enqueued", owner)
        if kind == "cancel" and s["status"] != "over":
            s["cancel"] = True
            if s["status"] == "waiting":
                s["status"] = "over"
                say(at, "canceled", owner)
            else:
                say(at, "cancel requested", owner)
        if kind == "claim" and s["status"] == "waiting" and not s["cancel"]:
            s |= {"status": "running", "owner": owner, "until": at + dt.timedelta(seconds=lease), "n": s["n"] + 1}
            say(at, "claimed", owner)
        if kind in ("heartbeat", "finish", "fail"):
            if not held:
                say(at, "late", owner)
            elif kind == "heartbeat" and not s["cancel"]:
                s["until"] = at + dt.timedelta(seconds=lease)
                say(at, "renewed", owner)
            else:
                s["status"] = "over"
                say(at, {"heartbeat": "canceled", "finish": "finished", "fail": "failed"}[kind], owner)
    schema = "job_id long, at timestamp, seq long, kind string, owner string"
    last = [(99, end, 10**6, "enqueue", None)]
    for number, part in enumerate((events[:90], events[90:400], events[400:], last, [(99, end + dt.timedelta(days=1), 10**6 + 1, "claim", "w")])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{number}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    moved = leases.lease_transitions(stream, lease * 1000, attempts)
    q = moved.writeStream.format("memory").queryName("moved").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    got = [tuple(r) for r in spark.sql("select * from moved where job_id <> 99").collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {"expired", "exhausted", "late", "canceled", "renewed", "failed"} <= {r[2] for r in want}


def test_department_master(spark):
    split = f"{masters.DUTY_FOLDER}/{masters.STREETS}__拆分"
    files = spark.createDataFrame([
        ("02_权责清单/广州市白云区水务局_行政处罚__拆分/1.md", "x"), ("02_权责清单/广州市白云区水务局_行政处罚__拆分/2.md", "x"), ("02_权责清单/广州市白云区水务局.md", "x"),
        ("02_权责清单/广州市 白云区城管局_行政许可_行政检查.md", "x"), ("02_权责清单/疑似数据异常.md", "x"), ("02_权责清单/越秀区水务局.md", "x"),
        (f"{split}/a.md", "#  同和街 \n正文"), (f"{split}/b.md", "正文\n# 京溪街"), (f"{split}/c.md", "# " + "长" * 31), (f"{split}/d.md", "# 三元里街"), (f"{split}/sub/e.md", "# 深街"),
        (f"{masters.DUTY_FOLDER}/{masters.DUTY_LIST}.md", "# 题\n## 白云区教育局 \n### 三\n## " + "长" * 31),
    ], "source_path string, text string")
    got = {r.name: r.sources for r in masters.department_master(files).collect()}
    assert got == {
        "广州市白云区水务局": ["02:广州市白云区水务局.md", "02:广州市白云区水务局_行政处罚__拆分"], "广州市白云区城管局_行政许可": ["02:广州市 白云区城管局_行政许可_行政检查.md"],
        "广州市白云区人民政府-同和街": [f"01:{masters.STREETS}"], "广州市白云区人民政府-三元里街": [f"01:{masters.STREETS}"]}
    code = masters.department_master(files).filter(F.col("name") == "广州市白云区水务局").first().code
    assert code == "DEPT-" + hashlib.sha1("广州市白云区水务局".encode()).hexdigest()[:16]
    names = {r.name for r in masters.coverage_names(files).collect()}
    assert names == {"广州市白云区水务局_行政处罚", "广州市白云区水务局", "广州市白云区城管局_行政许可", "疑似数据异常", "越秀区水务局", "三元里街", "白云区教育局"}


def test_cells_keep_the_best_of_a_part(spark):
    """No row is made of each pair: of a part of a cell k rows a query are left."""
    rng = np.random.default_rng(4)
    corpus = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(600)], "cid long, v array<double>")
    queries = corpus.filter("cid < 20").select(F.col("cid").alias("query_id"), F.col("v").alias("q"))
    counts: list[int] = []
    index = vector_cells.build_cells(corpus, n_cells=4)
    vector_cells.search_cells(index, queries, 5, None, counts).count()
    assert counts[2] <= 5 * counts[1]
