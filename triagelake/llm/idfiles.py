"""Token-id files with constant-time access by document key.

Layout under one folder that all executors share:

* ``shard-<range>-<number>-<attempt>.bin``: the raw ids of consecutive documents,
  little-endian, 2 bytes an id if the vocabulary allows, else 4; nothing else.
* ``shard-<range>-<number>-<attempt>.idx``: a header of fixed size, the levels of a
  minimal perfect hash of the shard's document keys in blocks of 512 bits, each
  behind the rank of its first bit, and by hash slot a record of fixed size: a
  32-bit fingerprint, the document's first id, id count and place in the shard;
  then the keys in document order.
* ``manifest/``: one Parquet row for each shard with its key range and counts.

Documents are dealt to shards by ranges of doc_id, so shards in order hold the
ids in ascending doc_id order.  The minimal perfect hash has levels of bit
arrays: a key takes the first level where no other key that is still without a
place has its bit; the rank of that bit is its slot.  A lookup reads the header,
one block for each level it tries (1.5 on average), one record and the wanted
ids, whatever the shard's size; a key that is absent meets a wrong fingerprint
(but for one in 2**32).

A shard closes at ``shard_tokens`` ids or ``shard_docs`` documents, whichever
comes first, so a task's memory and an index's size have a bound.  Each attempt of
a task writes files of its own name, and the manifest, which Spark commits, names
those of the attempt that counts: nothing is renamed or overwritten.

Null texts have only the end id.  Null ids come first and have the key "null".
Rows of one id (or of none) are in the order of their texts' hashes, then texts;
they may lie in several shards, as many as they fill, and are told apart by their
number within the id.  Other columns have no effect.  An empty table gives an
empty manifest.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelake.llm.common import bound_batches, slices
from triagelake.llm.tokens import encoder

MANIFEST = (
    "range_no int, shard_no int, name string, first_id long, last_id long, null_ids long, "
    "n_docs long, n_tokens long, id_bytes int"
)
MANIFEST_ARROW = pa.schema([
    (name, {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[kind]) for name, kind in (c.split() for c in MANIFEST.split(", "))
])
MAGIC = b"TIDX0002"
HEADER, LEVELS = 2048, 200  # bytes; the most levels, whose sizes fit there
BLOCK = np.dtype([("rank", "<u8"), ("bits", "u1", 64)])
RECORD = np.dtype([("print", "<u4"), ("start", "<u8"), ("count", "<u8"), ("place", "<u8")])


# ---- hashing -----------------------------------------------------------------

def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply); x: uint64."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_codes(ids: np.ndarray, is_null: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """64-bit codes of (id or null, how often it came before)."""
    code = mix(ids.astype(np.int64).view(np.uint64), 1)
    code = np.where(is_null, np.uint64(0x5F3759DF), code)
    return mix(code ^ mix(nth.astype(np.uint64), 2), 3)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit codes."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0] + [int(b.sum()) for b in levels])
        self.ranks = [np.concatenate([[0], np.cumsum(b)]) for b in levels]

    @classmethod
    def build(cls, codes: np.ndarray, room: float = 1.5) -> PerfectHash:
        levels, left = [], codes
        while len(left):
            size = max(2, int(len(left) * room))
            at = (mix(left, 100 + len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
            if len(levels) > LEVELS:
                raise ValueError("the codes are not distinct")
        return cls(levels)

    def slots(self, codes: np.ndarray) -> np.ndarray:
        """Slot of each code; of a code that is not in the set, some slot or -1."""
        out = np.full(len(codes), -1, np.int64)
        for n, bits in enumerate(self.levels):
            at = (mix(codes, 100 + n) % np.uint64(len(bits))).astype(np.int64)
            hit = (out < 0) & bits[at]
            out[hit] = self.before[n] + self.ranks[n][at[hit]]
        return out

    def blocks(self) -> np.ndarray:
        """The levels one behind the other, each padded to whole blocks."""
        out = []
        for n, bits in enumerate(self.levels):
            padded = np.zeros(-(-len(bits) // 512) * 512, bool)
            padded[: len(bits)] = bits
            made = np.zeros(len(padded) // 512, BLOCK)
            made["bits"] = np.packbits(padded).reshape(-1, 64)
            made["rank"] = self.before[n] + self.ranks[n][np.arange(len(made)) * 512]
            out.append(made)
        return np.concatenate(out) if out else np.zeros(0, BLOCK)


# ---- one shard ---------------------------------------------------------------

def occurrence(ids: np.ndarray, is_null: np.ndarray) -> np.ndarray:
    """How often each key came before, the keys being in order."""
    nth = np.zeros(len(ids), np.int64)
    for i in range(1, len(ids)):
        if is_null[i] == is_null[i - 1] and (is_null[i] or ids[i] == ids[i - 1]):
            nth[i] = nth[i - 1] + 1
    return nth


def fingerprints(codes: np.ndarray) -> np.ndarray:
    return (mix(codes, 7) >> np.uint64(32)).astype("<u4")


def index_bytes(ids: np.ndarray, is_null: np.ndarray, lengths: np.ndarray, id_bytes: int) -> bytes:
    codes = key_codes(ids, is_null, occurrence(ids, is_null))
    hashed = PerfectHash.build(codes)
    slots, n = hashed.slots(codes), len(ids)
    records = np.zeros(n, RECORD)
    records["print"][slots] = fingerprints(codes)
    records["start"][slots] = np.cumsum(lengths) - lengths
    records["count"][slots] = lengths
    records["place"][slots] = np.arange(n)
    head = MAGIC + struct.pack("<IQI", id_bytes, n, len(hashed.levels)) + b"".join(struct.pack("<Q", len(x)) for x in hashed.levels)
    return head.ljust(HEADER, b"\0") + hashed.blocks().tobytes() + records.tobytes() + ids.astype("<i8").tobytes() + is_null.astype("u1").tobytes()


class ShardReader:
    """Access to one shard: to single documents by key, in a few reads of fixed size
    (``get``), or to all of them in order (``all``)."""

    def __init__(self, folder: str, name: str):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.path = f"{root}/{name}"
        self.index = self.fs.open_input_file(f"{self.path}.idx")
        self.payload = self.fs.open_input_file(f"{self.path}.bin")
        head = self.index.read_at(HEADER, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{self.path}.idx is not an index of token ids")
        id_bytes, self.n, n_levels = struct.unpack_from("<IQI", head, 8)
        self.dtype = np.dtype(f"<u{id_bytes}")
        self.sizes = struct.unpack_from(f"<{n_levels}Q", head, 24)
        self.first_block = np.concatenate([[0], np.cumsum([-(-x // 512) for x in self.sizes])]).astype(np.int64)
        self.records_at = HEADER + int(self.first_block[-1]) * BLOCK.itemsize
        self.keys_at = self.records_at + self.n * RECORD.itemsize

    def find(self, doc_id: int | None, nth: int = 0) -> np.void | None:
        """The record of a key, or None if this shard does not have it."""
        code = key_codes(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([nth]))
        for level, size in enumerate(self.sizes):
            at = int((mix(code, 100 + level) % np.uint64(size))[0])
            block = int(self.first_block[level]) + at // 512
            raw = np.frombuffer(self.index.read_at(BLOCK.itemsize, HEADER + block * BLOCK.itemsize), BLOCK)[0]
            bits = np.unpackbits(raw["bits"])
            if bits[at % 512]:
                slot = int(raw["rank"]) + int(bits[: at % 512].sum())
                record = np.frombuffer(self.index.read_at(RECORD.itemsize, self.records_at + slot * RECORD.itemsize), RECORD)[0]
                return record if record["print"] == fingerprints(code)[0] else None
        return None

    def get(self, doc_id: int | None, nth: int = 0) -> np.ndarray | None:
        record = self.find(doc_id, nth)
        return None if record is None else self.tokens(record)

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, is_null and records of all documents in order, each record found by its key."""
        raw = self.index.read_at(9 * self.n, self.keys_at)
        ids, is_null = np.frombuffer(raw, "<i8", self.n), np.frombuffer(raw, "u1", self.n, 8 * self.n).astype(bool)
        blocks = np.frombuffer(self.index.read_at(self.records_at - HEADER, HEADER), BLOCK)
        bits = [np.unpackbits(blocks["bits"][a:b])[:size].astype(bool) for a, b, size in zip(self.first_block, self.first_block[1:], self.sizes)]
        codes = key_codes(ids, is_null, occurrence(ids, is_null))
        slots = PerfectHash(bits).slots(codes)
        records = np.frombuffer(self.index.read_at(self.n * RECORD.itemsize, self.records_at), RECORD)[slots]
        if (slots < 0).any() or (records["print"] != fingerprints(codes)).any():
            raise ValueError(f"{self.path}: a key is missing from its index")
        return ids, is_null, records

    def tokens(self, record: np.void) -> np.ndarray:
        size = self.dtype.itemsize
        return np.frombuffer(self.payload.read_at(int(record["count"]) * size, int(record["start"]) * size), self.dtype)

    def close(self) -> None:
        self.index.close()
        self.payload.close()


# ---- on DataFrames -----------------------------------------------------------

def write_ids(
    df: DataFrame, folder: str, path: str, end_id: int | None = 2,
    shard_tokens: int = 4_000_000, shard_docs: int = 50_000, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Encode every whole text with the vocabulary file ``path``, write the shards
    into ``folder`` (a URI that pyarrow opens) and return the manifest."""
    spark = df.sparkSession
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)

    def write(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        fs, root = pafs.FileSystem.from_uri(folder)
        task, shard_no = TaskContext.get(), 0
        end = b"" if end_id is None else enc.pack([end_id])
        ids, nulls, lengths, parts, held = [], [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal ids, nulls, lengths, parts, held, shard_no
            name = f"shard-{task.partitionId():06d}-{shard_no:06d}-{task.taskAttemptId()}"
            a, is_null = np.array(ids, np.int64), np.array(nulls, bool)
            index = index_bytes(a, is_null, np.array(lengths, np.int64), enc.dtype.itemsize)
            for kind, data in (("bin", b"".join(parts)), ("idx", index)):
                with fs.open_output_stream(f"{root}/{name}.{kind}") as f:
                    f.write(data)
            known = a[~is_null].tolist() or [None]
            row = (task.partitionId(), shard_no, name, known[0], known[-1], int(is_null.sum()), len(a), held, enc.dtype.itemsize)
            ids, nulls, lengths, parts, held, shard_no = [], [], [], [], 0, shard_no + 1
            return pa.RecordBatch.from_pylist([dict(zip(MANIFEST_ARROW.names, row))], MANIFEST_ARROW)

        for frame in frames:
            for part in slices(frame):
                for is_null, doc_id, body in zip(*(part.column(c).to_pylist() for c in ("is_null", "doc_id", "text"))):
                    packed = enc.encode_packed(body) + end
                    ids.append(doc_id)
                    nulls.append(is_null)
                    lengths.append(len(packed) // enc.dtype.itemsize)
                    parts.append(packed)
                    held += lengths[-1]
                    if held >= shard_tokens or len(ids) >= shard_docs:
                        yield close()
        if ids:
            yield close()

    bound_batches(spark)
    doc_id = F.col(key).cast("long")
    order = [F.desc("is_null"), "doc_id", "hash"]  # the hash parts rows of one id, or of none, over tasks
    manifest = (
        df.select(doc_id.isNull().alias("is_null"), F.coalesce(doc_id, F.lit(0)).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order, "text")
        .mapInArrow(write, MANIFEST)
    )
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The shards with ``start``: how many ids all shards before hold."""
    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    ranges = shards.groupBy("range_no").agg(F.sum("n_tokens").alias("range_tokens"))
    # one row a range: as many as tasks of the writing stage
    before = F.coalesce(F.sum("range_tokens").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("range_no", before.alias("range_start"))
    within = Window.partitionBy("range_no").orderBy("shard_no").rowsBetween(Window.unboundedPreceding, -1)
    return (
        shards.join(ranges, "range_no")
        .withColumn("start", F.col("range_start") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .drop("range_start")
    )


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document from the files, found by its key through the index: doc_id,
    start (ids of all documents before it), n_tokens, ids (packed as 4-byte
    little-endian) and ids_crc32 of these bytes."""
    return _read(spark, folder, True)


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """As ``read_documents``, without the ids."""
    return _read(spark, folder, False)


def _read(spark: SparkSession, folder: str, with_ids: bool, shards_a_task: int = 4) -> DataFrame:
    def read(frames: Iterator) -> Iterator:
        for frame in frames:
            for name, start in zip(frame["name"], frame["start"]):
                shard = ShardReader(folder, name)
                ids, is_null, records = shard.all()
                for lo in range(0, len(ids), 2000):
                    part = records[lo : lo + 2000]
                    payload = (shard.tokens(r).astype("<u4").tobytes() for r in part)
                    if with_ids:
                        payload = list(payload)
                    out = pd.DataFrame({
                        "doc_id": pd.array(ids[lo : lo + 2000], "Int64"),
                        "start": int(start) + part["start"].astype(np.int64),
                        "n_tokens": part["count"].astype(np.int64),
                        "ids_crc32": [zlib.crc32(p) for p in payload],
                    })
                    out.loc[is_null[lo : lo + 2000], "doc_id"] = pd.NA
                    if with_ids:
                        out["ids"] = payload
                    yield out
                shard.close()

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    shards = read_manifest(spark, folder).select("name", "start")
    # a stated number of tasks, which adaptive execution leaves as it is
    n = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").count()
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, n // shards_a_task)))
    return shards.repartitionByRange(tasks, "start").mapInPandas(read, schema)


def lookup(spark: SparkSession, folder: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """The ids of the wanted documents only (a null key: of those without an id).  Keys
    are sorted and parted by range; a task reads the manifest's rows of its range, finds
    a key's shards by binary search and the documents through their indexes.  Keys that
    no shard has give no row; a repeated document gives a row for each ``nth``, counted
    over all its shards."""
    wanted = keys.select(F.col(key).cast("long").alias("doc_id")).distinct()
    columns = ["range_no", "shard_no", "name", "first_id", "last_id", "null_ids"]

    def rows_of(shards: list[dict], doc_id: int | None, last: list) -> Iterator[tuple]:
        nth = 0
        for shard in shards:
            if not last or last[0] != shard["name"]:  # the keys being sorted, each shard is opened once
                if last:
                    last[1].close()
                last[:] = [shard["name"], ShardReader(folder, shard["name"])]
            own = 0
            while (ids := last[1].get(doc_id, own)) is not None:
                yield doc_id, nth, len(ids), ids.astype("<u4").tobytes()
                nth, own = nth + 1, own + 1

    def find(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        manifest = pads.dataset(f"{root}/manifest", filesystem=fs, format="parquet", schema=MANIFEST_ARROW, exclude_invalid_files=False)
        opened: list = []
        for frame in frames:
            asked = frame.column("doc_id").to_pylist()
            known = [x for x in asked if x is not None]
            if known:
                near = (pads.field("last_id") >= min(known)) & (pads.field("first_id") <= max(known))
                shards = sorted(manifest.to_table(columns, filter=near).to_pylist(), key=lambda r: (r["range_no"], r["shard_no"]))
                last = [r["last_id"] for r in shards]
            for doc_id in asked:
                if doc_id is None:
                    mine = sorted(manifest.to_table(columns, filter=pads.field("null_ids") > 0).to_pylist(), key=lambda r: (r["range_no"], r["shard_no"]))
                else:
                    mine, at = [], bisect_left(last, doc_id)
                    while at < len(shards) and shards[at]["first_id"] <= doc_id:
                        mine.append(shards[at])
                        at += 1
                for row in rows_of(mine, doc_id, opened):
                    yield pa.RecordBatch.from_pylist([dict(zip(FOUND.names, row))], FOUND)

    return wanted.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(find, "doc_id long, nth int, n_tokens long, ids binary")


FOUND = pa.schema([("doc_id", pa.int64()), ("nth", pa.int32()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
