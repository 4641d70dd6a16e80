"""The index worker as a stream: jobs come, documents' chunks are indexed and published.

Each micro-batch of requests is one publish of the jobs and items with the batch's number
in the ledger, so a batch that comes again changes nothing.  Then jobs run in rounds, of
each document the first that is free.  A round is two publishes: the claim (status,
lease, attempt), and the result, which has everything in one commit: payloads in both
targets, activation of the version, deletion of the one before, statuses of items, jobs,
versions and documents, and the audit rows.  A worker that dies between the two leaves
running jobs whose lease runs out, and they are claimed again; one that dies while it
writes leaves files that no manifest lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from triagelake.functions.text import hash_vector
from triagelake.operators import lifecycle
from triagelake.sources.snapshots import Publish, SnapshotStore

JOBS = (
    "id long, idempotency_key string, job_type string, status string, document_id long, version_id long, previous_version_id long, batch_id string, "
    "cancel_requested boolean, is_deleted boolean, total_items long, processed_items long, failed_items long, attempt_count int, "
    "lease_owner string, lease_until timestamp, created_at timestamp, started_at timestamp, finished_at timestamp, error_summary string"
)
ITEMS = "id long, job_id long, document_id long, version_id long, chunk_id long, target_key string, status string, retry_count int, last_error string, processed_at timestamp"
PAYLOAD = (
    "point_id string, chunk_id string, document_id long, version_id long, ordinal long, title string, section string, content string, "
    "category string, source_path string, sha256 string, active boolean"
)
TABLES: dict[str, tuple[str, list[str]]] = {
    "jobs": (JOBS, ["id"]), "items": (ITEMS, ["id"]),
    "documents": ("id long, title string, original_rel_path string, category string, status string, current_version_no long, asset_id long, is_deleted boolean", ["id"]),
    "versions": ("id long, document_id long, version_no long, asset_id long, status string, published_at timestamp", ["id"]),
    "chunks": ("id long, document_version_id long, chunk_no long, heading string, content string, sha256 string", ["id"]),
    "lexical": (PAYLOAD, ["chunk_id"]), "vectors": (f"{PAYLOAD}, vector array<double>", ["chunk_id"]),
    "log": ("job_id long, finished_at timestamp, action string, target_type string, detail string", ["job_id", "finished_at"]),
}
#: What a stream of requests carries: a job with its items, or the wish to cancel one (job_type ``cancel``, by idempotency_key).
REQUEST = (
    "id long, idempotency_key string, job_type string, document_id long, version_id long, previous_version_id long, batch_id string, created_at timestamp, "
    "items array<struct<id: bigint, chunk_id: bigint, target_key: string>>"
)
INDEXING = ("index_document", "reindex_document", "repair")


def create_tables(store: SnapshotStore, buckets: int = 16) -> None:
    with store.publish() as p:
        for name, (schema, key) in TABLES.items():
            p.create(name, schema, key, buckets)


def receive(p: Publish, requests: DataFrame) -> None:
    """Requests into jobs and items, each key once; cancellations mark their jobs."""
    jobs = p.read("jobs")
    asked = requests.filter("job_type <> 'cancel'")
    new = asked.withColumns({
        "status": F.lit("pending"), "cancel_requested": F.lit(False), "is_deleted": F.lit(False),
        "total_items": F.coalesce(F.size("items"), F.lit(0)).cast("long"), "attempt_count": F.lit(0),
    }).drop("items")
    coming = lifecycle.enqueue(jobs, new)
    known = coming.select(F.col("id").alias("job_id"), "idempotency_key")
    lines = asked.select("idempotency_key", "document_id", "version_id", F.explode("items").alias("i")).join(known, "idempotency_key")
    items = lines.select("i.id", "job_id", "document_id", "version_id", "i.chunk_id", "i.target_key", F.lit("pending").alias("status"), F.lit(0).alias("retry_count"))
    stop = requests.filter("job_type = 'cancel'").select("idempotency_key").distinct()
    stopped = jobs.join(coming.select("id"), "id", "left_anti").join(stop, "idempotency_key", "left_semi").withColumn("cancel_requested", F.lit(True))
    also = coming.join(stop.withColumn("_stop", F.lit(True)), "idempotency_key", "left").withColumn("cancel_requested", F.coalesce("_stop", "cancel_requested"))
    p.upsert("items", lifecycle.enqueue_items(p.read("items"), items))
    p.upsert("jobs", also.select(jobs.columns).unionByName(stopped.select(jobs.columns)))


def payloads(p: Publish, mine: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Of the open items of the jobs ``mine`` what goes to the targets; an item whose
    chunk is missing, or whose text has no vector, has an error."""
    items = p.read("items").filter("status <> 'succeeded'").join(mine.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    c = p.read("chunks").select(F.col("id").alias("chunk_id"), "chunk_no", "heading", "content", F.col("sha256").alias("chunk_sha"))
    d = p.read("documents").select(F.col("id").alias("document_id"), "title", "original_rel_path", "category")
    cid = F.col("chunk_id").cast("string")
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    rows = items.join(c, "chunk_id", "left").join(d, "document_id", "left")
    rows = rows.withColumn("vector", embed(text("content"))).withColumn("known", F.col("chunk_no").isNotNull())
    error = F.when(~F.col("known"), "chunk not found").when(F.col("vector").isNull(), "no vector")
    return rows.select(
        F.col("id").alias("item_id"), "job_id", F.sha2(F.concat(F.lit("kb:"), cid), 256).alias("point_id"), cid.alias("chunk_id"), "document_id", "version_id",
        F.coalesce("chunk_no", F.lit(0)).alias("ordinal"), text("title").alias("title"), text("heading").alias("section"), text("content").alias("content"),
        text("category").alias("category"), text("original_rel_path").alias("source_path"), text("chunk_sha").alias("sha256"), "vector", error.alias("error"),
    )


def write_targets(p: Publish, good: DataFrame, jobs: DataFrame) -> None:
    """Payloads of ``good`` items, the versions of ``jobs`` (done, indexing) active, their
    earlier versions and the documents of deletion jobs gone; once for each target."""
    done = jobs.filter("done and indexing")
    shown = done.select("document_id", "version_id").distinct().withColumn("_show", F.lit(True))
    old = done.filter("previous_version_id is not null and previous_version_id <> version_id").select("document_id", F.col("previous_version_id").alias("version_id"))
    drop = old.distinct().withColumn("_drop", F.lit(True))
    removed = jobs.filter("done and job_type = 'delete_document'").select("document_id").distinct().withColumn("_remove", F.lit(True))
    for name in ("lexical", "vectors"):
        there, columns = p.read(name), p.read(name).columns
        fresh = good.withColumn("active", F.lit(False)).select(columns).dropDuplicates(["chunk_id"])
        touched = jobs.select("document_id").distinct()
        kept = there.join(touched, "document_id", "left_semi").join(fresh.select("chunk_id"), "chunk_id", "left_anti")
        marked = (
            kept.select(columns).unionByName(fresh).join(shown, ["document_id", "version_id"], "left")
            .join(drop, ["document_id", "version_id"], "left").join(removed, "document_id", "left")
        )
        gone = marked.filter("_drop or _remove").select("chunk_id")
        stay = marked.filter("_drop is null and _remove is null").withColumn("active", F.col("active") | F.coalesce("_show", F.lit(False)))
        p.upsert(name, stay.select(columns), gone)


def finish(p: Publish, jobs: DataFrame, now: Column) -> None:
    """Statuses of versions, documents and jobs, and an audit row of each job that is done."""
    shown = jobs.filter("done and indexing").select("document_id", "version_id")
    versions = p.read("versions")
    met = versions.join(shown.select("document_id"), "document_id", "left_semi")
    changed = lifecycle.activate(met, shown).join(shown.select(F.col("version_id").alias("id"), F.lit(True).alias("_now")), "id", "left")
    p.upsert("versions", changed.withColumn("published_at", F.when(F.col("_now"), now).otherwise(F.col("published_at"))).select(versions.columns))

    documents = p.read("documents")
    v = versions.select(F.col("id").alias("version_id"), F.col("version_no").alias("_no"), F.col("asset_id").alias("_asset"))
    ends = jobs.filter("done").select(F.col("document_id").alias("id"), "version_id", "indexing").join(v, "version_id", "left")
    live = F.col("indexing") & ~F.coalesce("is_deleted", F.lit(False))
    p.upsert("documents", documents.join(ends, "id").withColumns({
        "status": F.when(live, "published").when(F.col("indexing"), F.col("status")).otherwise("disabled"),
        "current_version_no": F.when(live, F.col("_no")).otherwise(F.col("current_version_no")), "asset_id": F.when(live, F.col("_asset")).otherwise(F.col("asset_id")),
    }).select(documents.columns))

    columns = p.read("jobs").columns
    none = F.lit(None)
    p.upsert("jobs", jobs.withColumns({
        "status": F.when(F.col("done"), "succeeded").otherwise("failed"), "processed_items": F.when(F.col("done"), F.col("total_items")).otherwise(F.col("processed_items")),
        "failed_items": F.when(F.col("done"), 0).otherwise(F.col("_failed")), "error_summary": F.when(~F.col("done"), F.left("_error", F.lit(4000))),
        "lease_owner": none.cast("string"), "lease_until": none.cast("timestamp"), "finished_at": now,
    }).select(columns))
    detail = F.to_json(F.struct("job_type"))
    p.upsert("log", jobs.filter("done").select(F.col("id").alias("job_id"), now.alias("finished_at"), F.lit("kb.index.succeeded").alias("action"), F.lit("kb_index_job").alias("target_type"), detail.alias("detail")))


def run_round(store: SnapshotStore, now: Callable[[], Column], owner: str, embed: Callable[[Column], Column], batch: str | None, on_step: Callable[[str], None]) -> bool:
    """Claims the first free job of each document and brings it to its end; False if there was none."""
    p = Publish(store, on_step)
    claimed = lifecycle.claim(p.read("jobs"), now(), owner, n=None, batch=batch, per="document_id")
    if claimed.isEmpty():
        return False
    p.upsert("jobs", claimed)
    number = p.commit()
    on_step("claimed")

    p = Publish(store, on_step)
    # as committed: what this owner has just claimed
    mine = store.read("jobs", number).filter((F.col("status") == "running") & (F.col("lease_owner") == owner) & ~F.coalesce("cancel_requested", F.lit(False)))
    made = payloads(p, mine, embed).persist()  # read by what follows; made anew from the tables where it is lost
    counts = made.groupBy("job_id").agg(F.count("error").alias("_failed"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("item_id"))).alias("_error"))
    jobs = mine.join(counts, F.col("id") == F.col("job_id"), "left").drop("job_id").withColumns({
        "_failed": F.coalesce("_failed", F.lit(0)), "done": F.coalesce(F.col("_failed") == 0, F.lit(True)), "indexing": F.col("job_type").isin(*INDEXING),
    })
    write_targets(p, made.filter("error is null"), jobs)
    items = p.read("items")
    told = made.select(F.col("item_id").alias("id"), "error")
    p.upsert("items", items.join(told, "id").withColumns({
        "status": F.when(F.col("error").isNull(), "succeeded").otherwise("failed"), "last_error": F.col("error"),
        "retry_count": F.coalesce("retry_count", F.lit(0)) + F.col("error").isNotNull().cast("int"), "processed_at": F.when(F.col("error").isNull(), now()).otherwise(F.col("processed_at")),
    }).select(items.columns))
    finish(p, jobs, now())
    p.commit()
    made.unpersist()
    on_step("finished")
    return True


def process_batch(
    store: SnapshotStore, requests: DataFrame, batch_id: int, stream: str = "index", owner: str = "worker", now: Callable[[], Column] = F.current_timestamp,
    embed: Callable[[Column], Column] = hash_vector, batch: str | None = None, on_step: Callable[[str], None] = lambda step: None,
) -> None:
    """One micro-batch: its requests, unless the ledger has them, then rounds until no job is free."""
    if store.last_batch(stream) < batch_id:
        p = Publish(store, on_step)
        receive(p, requests)
        p.record_batch(stream, batch_id)
        p.commit()
    on_step("received")
    while run_round(store, now, owner, embed, batch, on_step):
        pass


def run_worker(requests: DataFrame, store: SnapshotStore, checkpoint: str, **how) -> StreamingQuery:
    """Starts the worker on a stream of REQUEST rows."""
    step = lambda df, batch_id: process_batch(store, df.persist(), batch_id, **how)
    return requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
