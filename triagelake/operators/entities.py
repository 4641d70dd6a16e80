"""Entity tables: filtered pages, soft deletion, partial updates, idempotent inserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(df: DataFrame, status: str | None = None) -> DataFrame:
    """Rows of that status; without one, all that are not deleted."""
    return df.filter(F.col("status") == status) if status is not None else df.filter(F.col("status") != "deleted")


def equals(df: DataFrame, **wanted) -> DataFrame:
    """Equality on each value that is given (empty and None: no filter)."""
    for name, value in wanted.items():
        if value:
            df = df.filter(F.col(name) == value)
    return df


def keyword(df: DataFrame, word: str | None, columns: list[str]) -> DataFrame:
    """Rows where a column is like %word%, in any case; % and _ in it keep their meaning."""
    if not word:
        return df
    like = F.lit(False)
    for c in columns:
        like = like | F.col(c).ilike(f"%{word}%")
    return df.filter(like)


def page(df: DataFrame, order: list[Column], page_no: int, page_size: int) -> DataFrame:
    return df.orderBy(*order).offset((page_no - 1) * page_size).limit(page_size)


def soft_delete(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    gone = ids.select(F.col(key).alias("_gone")).distinct()
    return df.join(gone, F.col(key) == F.col("_gone"), "left").withColumn(
        "status", F.when(F.col("_gone").isNotNull(), "deleted").otherwise(F.col("status"))
    ).drop("_gone")


def partial_update(df: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """``updates``: key, set_fields (names), columns and optionally seq; a listed field is
    set even to null, any other keeps its value.  Of several updates of one key each
    field takes the last that lists it (by seq; without one, by the greatest value)."""
    fields = [c for c in updates.columns if c not in (key, "set_fields", "seq") and c in df.columns]
    order = "seq" if "seq" in updates.columns else None
    last = [F.max_by(F.struct(c), F.when(F.array_contains("set_fields", c), F.struct(F.col(order or c)))).alias(f"_l{i}") for i, c in enumerate(fields)]
    merged = updates.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("set_fields"))).alias("set_fields"), *last)
    updates = merged.select(key, "set_fields", *[F.col(f"_l{i}")[c].alias(c) for i, c in enumerate(fields)])
    u = updates.select(F.col(key).alias("_key"), "set_fields", *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = df.join(u, F.col(key) == F.col("_key"), "left")
    new = {c: F.when(F.array_contains("set_fields", c), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in fields}
    return joined.withColumns(new).select(df.columns)


def insert_new(existing: DataFrame, batch: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key of ``batch`` that ``existing`` does not have."""
    w = Window.partitionBy(key).orderBy(*order)
    first = batch.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return first.join(existing.select(key).distinct(), key, "left_anti")


def missing_references(refs: DataFrame, ref: str, target: DataFrame, key: str) -> DataFrame:
    known = target.select(F.col(key).alias("_known"))
    return refs.filter(F.col(ref).isNotNull()).join(known, F.col(ref) == F.col("_known"), "left_anti")


def recency(last: Column, today: Column) -> Column:
    """Today (also without a date), Yesterday or Earlier, against midnight."""
    return (
        F.when(last.isNull() | (last >= today), "Today")
        .when(last >= today - F.expr("INTERVAL 1 DAY"), "Yesterday")
        .otherwise("Earlier")
    )


UNTITLED = "New Chat"


def with_title(df: DataFrame, word: str | None, title: str = "title") -> DataFrame:
    """Rows whose title holds the trimmed word as it stands, in any case; a missing title
    is ``New Chat``."""
    wanted = (word or "").strip().lower()
    return df.filter(F.contains(F.lower(F.coalesce(F.col(title), F.lit(UNTITLED))), F.lit(wanted))) if wanted else df


def threads(df: DataFrame, word: str | None, today: Column, title: str = "title", last: str = "last_at", order: str = "place") -> DataFrame:
    """Threads with that title, in order, with ``bucket``.  If none of them has a date they
    stay in the input's order (``order``) and have no bucket; else the latest come first,
    those without a date before them, and each belongs to Today, Yesterday or Earlier."""
    found = with_title(df, word, title)
    both = found.crossJoin(F.broadcast(found.agg((F.count(last) > 0).alias("_dated"))))  # one row
    by_date = F.when(F.col("_dated"), F.col(last))
    bucket = F.when(F.col("_dated"), recency(F.col(last), today))
    return both.withColumn("bucket", bucket).orderBy(by_date.desc_nulls_first(), order).drop("_dated")


def owned_references(refs: DataFrame, owner: str, ref: str, owners: DataFrame, owner_key: str, targets: DataFrame, target_key: str, target_owner: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reason``): rows that name an owner and, if they like, a
    target which has to exist and belong to that owner."""
    o = owners.select(F.col(owner_key).alias("_owner")).distinct()
    t = targets.select(F.col(target_key).alias("_target"), F.col(target_owner).alias("_of")).dropDuplicates(["_target"])
    joined = refs.join(o, F.col(owner) == F.col("_owner"), "left").join(t, F.col(ref) == F.col("_target"), "left")
    named = F.col(ref).isNotNull() & (F.col(ref).cast("string") != "")
    reason = (
        F.when(F.col("_owner").isNull(), "owner not found").when(named & F.col("_target").isNull(), "target not found")
        .when(named & ~F.col("_of").eqNullSafe(F.col(owner)), "target belongs to another owner")
    )
    told = joined.withColumn("reason", reason)
    return told.filter("reason is null").select(refs.columns), told.filter("reason is not null").select(*refs.columns, "reason")


def known_ids(wanted: DataFrame, key: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the wanted ids in their order, ids that are not there); no ids, no rows."""
    asked = wanted.select(F.col(key), "place")
    return rows.join(asked, key).orderBy("place").drop("place"), asked.join(rows.select(key), key, "left_anti").select(key)


def same_positions(a: Column, b: Column) -> Column:
    """Two lists agree in length and at each place; nulls are equal."""
    return F.coalesce((F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x), a.isNull() & b.isNull())
