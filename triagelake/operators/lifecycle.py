"""Staged index lifecycle: each mutation takes the old tables to the new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def claim(jobs: DataFrame, now: Column, owner: str, lease: str = "INTERVAL 5 MINUTE", n: int | None = 1, batch: str | None = None, per: str | None = None) -> DataFrame:
    """The first n jobs (None: all) that wait or whose lease ran out, marked as running.

    Deleted jobs and those that shall be cancelled are never taken.  ``batch``: jobs of
    that batch_id, without one only those of none.  ``per``: of each value of that column
    only the first job, so that the jobs of one document run one behind the other.
    Columns that ``jobs`` lacks have no effect."""
    has = set(jobs.columns)
    free = (F.col("status") == "pending") | ((F.col("status") == "running") & (F.col("lease_until") < now))
    for flag in ("is_deleted", "cancel_requested"):
        if flag in has:
            free = free & ~F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    if "batch_id" in has:
        free = free & (F.col("batch_id").isNull() if batch is None else F.col("batch_id") == batch)
    ready = jobs.filter(free)
    if per:
        # the first job that waits, runs or may be taken: a document with a running job waits
        w = Window.partitionBy(per).orderBy("created_at", "id")
        busy = (F.col("status") == "running") & ~(F.col("lease_until") < now)
        ready = jobs.filter(free | busy).withColumn("_rn", F.row_number().over(w)).filter((F.col("_rn") == 1) & ~busy).drop("_rn")
    ready = ready if n is None else ready.orderBy("created_at", "id").limit(n)
    changes = {
        "status": F.lit("running"), "lease_owner": F.lit(owner), "lease_until": now + F.expr(lease),
        "attempt_count": F.coalesce("attempt_count", F.lit(0)) + 1, "started_at": F.coalesce("started_at", now),
    }
    if "error_summary" in has:
        changes["error_summary"] = F.lit(None).cast("string")
    return ready.withColumns(changes)


def renew(jobs: DataFrame, ids: DataFrame, owner: str, now: Column, lease: str = "INTERVAL 5 MINUTE") -> DataFrame:
    """Longer leases for those of ``ids`` (id) that ``owner`` still runs."""
    i = ids.select(F.col("id").alias("_id")).distinct()
    mine = F.col("_id").isNotNull() & (F.col("status") == "running") & (F.col("lease_owner") == owner)
    return jobs.join(i, F.col("id") == F.col("_id"), "left").withColumn("lease_until", F.when(mine, now + F.expr(lease)).otherwise(F.col("lease_until"))).select(jobs.columns)


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """The rows to write when ``new`` jobs come: a job whose idempotency_key is known keeps
    its row, waits again if it had succeeded (else its status stays), and loses its
    cancellation, error and end; other jobs come as they are.  Of several new jobs of one
    key the first by id counts."""
    w = Window.partitionBy("idempotency_key").orderBy("id")
    first = new.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    keys = first.select("idempotency_key")
    known = jobs.join(keys, "idempotency_key", "left_semi").withColumns({
        "status": F.when(F.col("status") == "succeeded", "pending").otherwise(F.col("status")), "cancel_requested": F.lit(False),
        "error_summary": F.lit(None).cast("string"), "finished_at": F.lit(None).cast(jobs.schema["finished_at"].dataType),
    })
    fresh = first.join(jobs.select("idempotency_key"), "idempotency_key", "left_anti")
    return known.unionByName(fresh, allowMissingColumns=True).select(jobs.columns)


def enqueue_items(items: DataFrame, new: DataFrame) -> DataFrame:
    """The rows to write when ``new`` items come: one of a known (job_id, target_key) waits
    again without its error, other items come as they are."""
    key = ["job_id", "target_key"]
    known = items.join(new.select(*key).distinct(), key, "left_semi").withColumns({"status": F.lit("pending"), "last_error": F.lit(None).cast("string")})
    fresh = new.dropDuplicates(key).join(items.select(*key), key, "left_anti")
    return known.unionByName(fresh, allowMissingColumns=True).select(items.columns)


def activate(versions: DataFrame, publish: DataFrame) -> DataFrame:
    """publish: document_id, version_id.  That version becomes the published one, the
    one published before is superseded."""
    p = publish.select(F.col("document_id").alias("_doc"), F.col("version_id").alias("_ver"))
    joined = versions.join(p, F.col("document_id") == F.col("_doc"), "left")
    status = (
        F.when(F.col("_doc").isNull(), F.col("status"))
        .when(F.col("id") == F.col("_ver"), "published")
        .when(F.col("status") == "published", "superseded")
        .otherwise(F.col("status"))
    )
    return joined.withColumn("status", status).select(versions.columns)


def visible_chunks(chunks: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of each document's current version."""
    v = versions.select(F.col("id").alias("document_version_id"), "document_id", "version_no")
    d = documents.select(F.col("id").alias("document_id"), "current_version_no", "title")
    return chunks.join(v, "document_version_id").join(d, "document_id").filter("current_version_no = version_no")


def finish(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """Counts of processed and failed items into their jobs, and the outcome."""
    counts = items.groupBy("job_id").agg(
        F.count_if(F.col("status") == "succeeded").alias("_done"), F.count_if(F.col("status") == "failed").alias("_failed")
    )
    joined = jobs.join(counts, F.col("id") == F.col("job_id"), "left")
    done, failed = F.coalesce("_done", F.lit(0)), F.coalesce("_failed", F.lit(0))
    outcome = F.when(F.col("cancel_requested"), "canceled").when(failed > 0, "failed").otherwise("succeeded")
    return joined.withColumns({
        "processed_items": done, "failed_items": failed,
        "status": F.when((F.col("status") == "running") & F.col("job_id").isNotNull(), outcome).otherwise(F.col("status")),
    }).select(jobs.columns)


def first_failures(items: DataFrame, by: list[str], order: list[Column], n: int = 20) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return items.filter("status = 'failed'").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
