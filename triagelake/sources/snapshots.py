"""Tables that are published together: readers see all changes of a publish or none.

A store is a folder with Parquet files below ``data/`` and one manifest for each publish
below ``manifests/``, named by its number.  A manifest lists, for every table, its schema,
its key and for each bucket (a hash of the key) the folder that holds the bucket's rows.
A publish writes new folders first and its manifest last, by a rename that fails where
that number is taken; until then nobody reads the new files, and whatever interrupts it
leaves the state before.  A change by key reads and rewrites only the buckets it meets.

A manifest also has a ledger, the last batch of each stream that is in it, so that a
batch which comes again can be told.  ``vacuum`` deletes folders no kept manifest lists.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.sources.tables import upsert


class Conflict(Exception):
    """Another publish has taken the number."""


class Files:
    """The few calls to the Hadoop file system that a manifest needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), spark._jsc.hadoopConfiguration())
        self.none = spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def names(self, folder: str) -> list[str]:
        at = self.path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(f"{self.root}/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """The file appears whole, or Conflict if there is one of that name."""
        draft = self.path(f"{self.root}/drafts/{uuid.uuid4().hex}")
        stream = self.fs.create(draft)
        try:
            stream.write(text.encode("utf-8"))
        finally:
            stream.close()
        target = self.path(f"{self.root}/{name}")
        self.fs.mkdirs(target.getParent())
        try:
            self.context.rename(draft, target, self.none)
        except Exception as problem:
            self.fs.delete(draft, False)
            if self.fs.exists(target):
                raise Conflict(name) from problem
            raise

    def delete(self, folder: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{folder}"), True)


class SnapshotStore:
    """``store.read(name)`` for readers, ``with store.publish() as p: p.upsert(...)`` for a writer."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    def versions(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self.files.names("manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """Of that publish, or of the last one (without any: an empty one, number 0)."""
        number = version if version is not None else max(self.versions(), default=0)
        if not number:
            return {"version": 0, "tables": {}, "ledger": {}}
        return json.loads(self.files.read(f"manifests/{number:012d}.json"))

    def last_batch(self, stream: str) -> int:
        return self.manifest()["ledger"].get(stream, -1)

    def read(self, name: str, version: int | None = None, manifest: dict | None = None) -> DataFrame:
        return self.rows_of((manifest or self.manifest(version))["tables"][name])

    def rows_of(self, entry: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(entry["schema"])
        wanted = [f"{self.files.root}/data/{at}/bucket={b}" for b, at in entry["parts"].items() if buckets is None or int(b) in buckets]
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*wanted)

    def publish(self) -> Publish:
        return Publish(self)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the folders that none of the last ``keep`` manifests lists, and the older
        manifests; no publish may be under way.  Returns the number of folders."""
        numbers = self.versions()
        old, kept = numbers[:-keep], [self.manifest(n) for n in numbers[-keep:]]
        used = {at for m in kept for t in m["tables"].values() for at in t["parts"].values()}
        for n in old:
            self.files.delete(f"manifests/{n:012d}.json")
        gone = [f"{name}/{at}" for name in self.files.names("data") for at in self.files.names(f"data/{name}") if f"{name}/{at}" not in used]
        for at in gone:
            self.files.delete(f"data/{at}")
        return len(gone)


class Publish:
    """Changes to several tables; nothing is seen before ``commit`` (the end of a ``with``
    without an error).  ``on_step`` is told each step by name."""

    def __init__(self, store: SnapshotStore, on_step: Callable[[str], None] = lambda step: None):
        self.store, self.on_step = store, on_step
        self.base = store.manifest()
        self.tables = dict(self.base["tables"])
        self.ledger = dict(self.base["ledger"])

    def __enter__(self) -> Publish:
        return self

    def __exit__(self, kind, problem, trace) -> None:
        if kind is None:
            self.commit()

    def read(self, name: str) -> DataFrame:
        """The table with the changes made here so far."""
        return self.store.rows_of(self.tables[name])

    def create(self, name: str, schema: str | T.StructType, key: list[str], buckets: int = 16) -> None:
        """An empty table, where there is none of that name."""
        kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        self.tables.setdefault(name, {"schema": kind.jsonValue(), "key": key, "buckets": buckets, "parts": {}})

    def upsert(self, name: str, rows: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """``rows`` in place of those of their keys (the caller gives one row a key);
        rows with the keys of ``gone`` go.  Other buckets keep their files."""
        entry = self.tables[name]
        key, schema = entry["key"], T.StructType.fromJson(entry["schema"])
        new = (self.store.spark.createDataFrame([], schema) if rows is None else rows).select(*[F.col(f.name).cast(f.dataType) for f in schema])
        keys = new.select(*key) if gone is None else new.select(*key).unionByName(gone.select(*[F.col(k).cast(schema[k].dataType) for k in key]))
        bucket = self._bucket(entry)
        # at most as many rows as the table has buckets
        met = [r["bucket"] for r in keys.select(bucket.alias("bucket")).distinct().collect()]
        if not met:
            return
        old = self.store.rows_of(entry, met)
        left = upsert(old, keys.distinct().select("*", F.lit(True).alias("_gone")), key).filter("_gone is null").select(*schema.names)
        self._write(name, left.unionByName(new), met)

    def _bucket(self, entry: dict) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in entry["key"]]), F.lit(entry["buckets"])).cast("int")

    def _write(self, name: str, rows: DataFrame, met: list[int]) -> None:
        self.on_step(f"write {name}")
        entry, folder = self.tables[name], f"{name}/{uuid.uuid4().hex}"
        spread = F.pmod(F.xxhash64(*entry["key"], F.lit(1)), F.lit(4))  # a bucket is written by four tasks
        dealt = rows.withColumn("bucket", self._bucket(entry)).repartition("bucket", spread)
        dealt.write.partitionBy("bucket").parquet(f"{self.store.files.root}/data/{folder}")
        there = {int(n.split("=")[1]) for n in self.store.files.names(f"data/{folder}") if n.startswith("bucket=")}
        parts = {b: at for b, at in entry["parts"].items() if int(b) not in met}
        self.tables[name] = entry | {"parts": parts | {str(b): folder for b in met if b in there}}

    def record_batch(self, stream: str, batch_id: int) -> None:
        self.ledger[stream] = batch_id

    def commit(self) -> int:
        number = self.base["version"] + 1
        self.on_step("commit")
        text = json.dumps({"version": number, "tables": self.tables, "ledger": self.ledger}, ensure_ascii=False)
        self.store.files.create(f"manifests/{number:012d}.json", text)
        return number
