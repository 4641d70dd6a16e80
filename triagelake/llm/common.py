"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes of an Arrow batch that goes to Python, and of the texts that are Python strings at once.
BATCH_BYTES, SLICE_BYTES = 8 << 20, 2 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@lru_cache(maxsize=1)
def _test_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="triagelake-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _test_dir()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_staged: list[str] = []


def stage_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    lets several later jobs read one result that survives lost executors."""
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_tables() -> list[str]:
    """Paths of the tables staged so far and not dropped."""
    return list(_staged)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes staged tables; nothing that reads them may be evaluated any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _staged.remove(path)


def utf8(text: Column | str) -> Column:
    """UTF-8 bytes of a text; null counts as the empty text."""
    col = F.col(text) if isinstance(text, str) else text
    return F.encode(F.coalesce(col, F.lit("")), "UTF-8")


def is_held_out(doc_id: Column | str, folds: int = 5) -> Column:
    """Fold 0 of crc32(doc_id as text); a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(utf8(col.cast("string"))) % folds == 0


def spare_name(df: DataFrame, stem: str) -> str:
    """``stem``, or longer, so that no column of ``df`` has the name."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def bound_batches(spark: SparkSession) -> None:
    """Lets the session send at most ``BATCH_BYTES`` to Python at once (a row is
    never parted), where it would send more."""
    now = int(spark.conf.get(BATCH_SETTING).rstrip("b"))
    if now > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def slices(batch: pa.RecordBatch | pa.Array, rows: int = 500) -> Iterator:
    """Parts of at most ``rows`` rows and ``SLICE_BYTES`` bytes, or of one row."""
    for at in range(0, len(batch), rows):
        left = [batch.slice(at, rows)]
        while left:
            part = left.pop()
            if len(part) > 1 and part.nbytes > SLICE_BYTES:
                half = len(part) // 2
                left += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def per_text(spark: SparkSession, work, kind: str):
    """A function of a text column: ``work`` of each whole text.  Only the texts go to
    Python and only results come back; the other columns wait in the JVM."""
    bound_batches(spark)
    out = _arrow(T._parse_datatype_string(f"x {kind}").fields[0].dataType)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            made = [pa.array([work(t) for t in part.to_pylist()], out) for part in slices(batch)]
            yield pa.concat_arrays(made) if made else pa.array([], out)

    return F.arrow_udf(run, kind)


def map_texts(df: DataFrame, keep: list[str], work, schema: str, rows: int = 500) -> DataFrame:
    """``work`` on the texts of ``rows`` rows or ``SLICE_BYTES`` bytes at a time, in Arrow batches.

    ``df``: the columns ``keep`` and ``text``.  ``work(texts)`` returns a list of
    tuples for the columns of ``schema``, one for each text, or a pair of row
    numbers and such a list where a text gives several rows or none.  The columns
    ``keep`` pass unread, so 64-bit ids beside nulls stay exact.
    """
    bound_batches(df.sparkSession)
    out_schema = T.StructType([*df.select(*keep).schema.fields, *T._parse_datatype_string(schema).fields])
    types = [(f.name, _arrow(f.dataType)) for f in T._parse_datatype_string(schema).fields]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for part in slices(frame, rows):
                made = work(part.column("text").to_pylist())
                kept = [part.column(c) for c in keep]
                if isinstance(made, tuple):
                    index, made = made
                    kept = [c.take(pa.array(np.asarray(index, np.int64))) for c in kept]
                columns = list(zip(*made)) if made else [()] * len(types)
                arrays = [pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(kept + arrays, names=[*keep, *(n for n, _ in types)])

    return df.select(*keep, "text").mapInArrow(run, out_schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    return {
        "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
        "boolean": pa.bool_(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64()),
    }[kind.simpleString()]
