"""Publishing of several tables at once, and the index worker that may die at any step."""

import collections
import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from triagelake.operators import lifecycle
from triagelake.sources.snapshots import Conflict, Publish, SnapshotStore
from triagelake.streaming import index_worker as worker

NOW = dt.datetime(2024, 1, 15, 12)


@pytest.fixture(autouse=True)
def few_tasks(spark):
    """The tables here have a handful of rows."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_publish_is_all_or_nothing(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    with store.publish() as p:
        p.create("a", "k long, v string", ["k"], buckets=4)
        p.create("b", "k long, n long", ["k"], buckets=4)
        p.upsert("a", spark.createDataFrame([(i, "old") for i in range(40)], "k long, v string"))
    rows = lambda name, **at: {tuple(r) for r in store.read(name, **at).collect()}
    assert rows("a") == {(i, "old") for i in range(40)} and rows("b") == set()
    before = store.manifest()["tables"]["a"]["parts"]
    with pytest.raises(RuntimeError):
        with store.publish() as p:
            p.upsert("a", spark.createDataFrame([(1, "new")], "k long, v string"))
            p.upsert("b", spark.createDataFrame([(1, 1)], "k long, n long"))
            assert (1, "new") in {tuple(r) for r in p.read("a").collect()}
            raise RuntimeError("lost")
    assert rows("a") == {(i, "old") for i in range(40)} and rows("b") == set() and store.versions() == [1]
    p, other = store.publish(), store.publish()
    p.upsert("a", spark.createDataFrame([(1, "new"), (None, "null key")], "k long, v string"), gone=spark.createDataFrame([(2,), (77,)], "k long"))
    p.upsert("b", spark.createDataFrame([(1, 5)], "k long, n long"))
    p.record_batch("s", 3)
    assert p.commit() == 2
    other.upsert("b", spark.createDataFrame([(1, 6)], "k long, n long"))
    with pytest.raises(Conflict):
        other.commit()
    assert rows("a") == {(i, "old") for i in range(3, 40)} | {(0, "old"), (1, "new"), (None, "null key")} and rows("b") == {(1, 5)}
    assert rows("a", version=1) == {(i, "old") for i in range(40)} and store.last_batch("s") == 3
    after = store.manifest()["tables"]["a"]["parts"]
    assert any(before[b] == after.get(b) for b in before), "buckets that a change does not meet keep their files"
    assert store.vacuum() > 0 and rows("b") == {(1, 5)} and len(rows("a")) == 40


def test_claims(spark):
    at = lambda m: NOW + dt.timedelta(minutes=m)
    rows = [
        (1, "pending", None, at(0), False, False, None, 1), (2, "running", at(-1), at(1), False, False, None, 1), (3, "running", at(9), at(2), False, False, None, 2),
        (4, "pending", None, at(3), True, False, None, 3), (5, "pending", None, at(4), False, True, None, 3), (6, "pending", None, at(5), False, False, "b", 3),
        (7, "succeeded", None, at(6), False, False, None, 4), (8, "pending", None, at(7), None, None, None, 2),
    ]
    schema = "id long, status string, lease_until timestamp, created_at timestamp, cancel_requested boolean, is_deleted boolean, batch_id string, document_id long"
    jobs = spark.createDataFrame(rows, schema).withColumns({"attempt_count": F.lit(1), "started_at": F.lit(None).cast("timestamp"), "error_summary": F.lit("old")})
    ids = lambda df: [r["id"] for r in df.orderBy("id").collect()]
    assert ids(lifecycle.claim(jobs, F.lit(NOW), "w", n=None)) == [1, 2, 8]
    assert ids(lifecycle.claim(jobs, F.lit(NOW), "w", n=None, per="document_id")) == [1]  # 8 waits for 3, which runs
    assert ids(lifecycle.claim(jobs, F.lit(NOW), "w", batch="b")) == [6]
    got = lifecycle.claim(jobs, F.lit(NOW), "w").collect()[0]
    assert (got["id"], got["status"], got["lease_owner"], got["attempt_count"], got["error_summary"]) == (1, "running", "w", 2, None)
    held = jobs.withColumn("lease_owner", F.when(F.col("id") == 3, "w").otherwise("x"))
    new = {r["id"]: r["lease_until"] for r in lifecycle.renew(held, jobs.select("id"), "w", F.lit(NOW), "INTERVAL 30 MINUTE").collect()}
    assert new[3] == at(30) and new[2] == at(-1)


def seed(spark, root: str) -> SnapshotStore:
    """Documents 1 to 4; version 10 * document + n, with two chunks each."""
    store = SnapshotStore(spark, root)
    worker.create_tables(store, buckets=1)
    docs = [(d, f"T{d}", f"x/{d}.md", "c", "draft", None, None, d == 4) for d in (1, 2, 3, 4)]
    versions = [(10 * d + n, d, n, 100 * d + n, "draft", None) for d in (1, 2, 3, 4) for n in (1, 2)]
    chunks = [(10 * v + k, v, k, f"h{k}", f"text of {v} {k}", f"s{k}") for v, *_ in versions for k in (1, 2)]
    with store.publish() as p:
        for name, rows in (("documents", docs), ("versions", versions), ("chunks", chunks)):
            p.upsert(name, spark.createDataFrame(rows, worker.TABLES[name][0]))
    return store


def request(job: int, kind: str, doc: int, ver: int | None, old: int | None = None, chunks: list[int] = (), batch: str | None = None) -> tuple:
    items = [(100 * job + i, c, f"doc:{doc}:ver:{ver}:chunk:{i}") for i, c in enumerate(chunks)]
    return job, f"key-{job}", kind, doc, ver, old, batch, NOW + dt.timedelta(seconds=job), items


BATCHES = [
    [request(1, "index_document", 1, 11, None, [111, 112]), request(2, "index_document", 2, 21, None, [211, 999]), request(3, "reindex_document", 1, 12, 11, [121, 122]),
     request(4, "index_document", 3, 31, None, [311, 312]), request(9, "index_document", 3, 32, None, [321], "b"), request(10, "index_document", 4, 41, None, [411])],
    [request(5, "delete_document", 3, None), request(1, "index_document", 1, 11, None, [111, 112]), request(6, "cancel", 0, None), request(7, "repair", 2, 21, 21, [211, 212])],
]


def state(store: SnapshotStore) -> dict:
    out = {}
    for name in worker.TABLES:
        drop = {"jobs": ["attempt_count"], "log": []}.get(name, [])
        out[name] = {str(r.asDict()) for r in store.read(name).drop(*drop, "finished_at", "started_at", "processed_at", "published_at", "lease_until").collect()}
    return out


def run(spark, root, kills: dict[str, int] = {}) -> SnapshotStore:
    """All batches; dies once at each step of ``kills``, when it comes that often, and begins that batch again."""
    store, clock, seen = seed(spark, root), [NOW], collections.Counter()

    def on_step(step: str) -> None:
        seen[step] += 1
        if seen[step] == kills.get(step):
            raise RuntimeError(step)

    for number, rows in enumerate(BATCHES):
        df = spark.createDataFrame(rows, worker.REQUEST)
        for _ in range(2 - number):  # the first batch comes twice
            for _ in range(1 + len(kills)):
                try:
                    worker.process_batch(store, df, number, now=lambda: F.lit(clock[0]), on_step=on_step)
                    break
                except RuntimeError:
                    clock[0] += dt.timedelta(minutes=6)
        clock[0] += dt.timedelta(minutes=1)
    return store


def test_worker_and_its_restarts(spark, tmp_path):
    store = run(spark, f"file://{tmp_path}/plain")
    want = state(store)
    rows = lambda name: {r[0]: r.asDict() for r in store.read(name).collect()}
    jobs, docs, versions = rows("jobs"), rows("documents"), rows("versions")
    assert {j: r["status"] for j, r in jobs.items()} == {1: "succeeded", 2: "failed", 3: "succeeded", 4: "succeeded", 5: "succeeded", 7: "succeeded", 9: "pending", 10: "succeeded"}
    assert jobs[2]["error_summary"] == "chunk not found" and jobs[2]["failed_items"] == 1 and jobs[4]["processed_items"] == 2
    assert all(r["lease_owner"] is None for j, r in jobs.items() if j != 9)
    # job 1 came again after version 12: it is published anew, as the later job says
    assert docs[1]["current_version_no"] == 1 and docs[3]["status"] == "disabled" and docs[2]["status"] == "published" and docs[4]["status"] == "draft"
    assert versions[11]["status"] == "published" and versions[12]["status"] == "superseded" and versions[21]["status"] == "published"
    lexical = {r["chunk_id"]: r for r in store.read("lexical").collect()}
    assert {c for c, r in lexical.items() if r["active"]} == {"111", "112", "121", "122", "211", "212", "411"}
    assert lexical["211"]["point_id"] == hashlib.sha256(b"kb:211").hexdigest() and lexical["211"]["title"] == "T2" and lexical["211"]["section"] == "h1"
    assert {r["chunk_id"] for r in store.read("vectors").collect()} == set(lexical)
    assert sorted(r["job_id"] for r in store.read("log").collect()) == [1, 1, 3, 4, 5, 7, 10]
    killed = run(spark, f"file://{tmp_path}/killed", {"received": 1, "claimed": 2, "write vectors": 2, "write log": 2, "finished": 3})
    assert state(killed) == want


def test_worker_as_a_stream(spark, tmp_path):
    store = seed(spark, f"file://{tmp_path}/s")
    schema = spark.createDataFrame([], worker.REQUEST).schema
    spark.createDataFrame(BATCHES[0][:2], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    for _ in range(2):
        q = worker.run_worker(stream, store, f"{tmp_path}/ck", now=lambda: F.lit(NOW))
        q.processAllAvailable()
        q.stop()
    assert store.read("jobs").count() == 2 and store.last_batch("index") == 0
