"""Exact vector search by cells: centres from a sample, and the triangle inequality.

Unit vectors are dealt to the nearest of a few centres; a cell knows its radius.  From a
query at distance D of a centre no member of radius R is nearer than D - R; for unit vectors
the cosine is 1 - distance**2 / 2.  The nearest cells with k rows give a threshold; cells
whose bound is below it are left out.  A part of a cell and the queries that read it are
scored as matrices (``dense_blocks``).  Results equal a search of everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.functions.text import hold
from triagelake.operators import dense_blocks
from triagelake.operators.dense_blocks import best_of_block, block_schema
from triagelake.operators.retrieval import dot
from triagelake.sources.staging import staged

#: Rows of a part of a cell, so that a crowded cell is many tasks; slack for rounded scores and distances.
PART_ROWS, SLACK = 4096, 2e-6


def unit(v: Column) -> Column:
    """The vector by its length, as doubles."""
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / length)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * dot(a, b)))


@dataclass
class CellIndex:
    """``rows``: cell, part, cid, v, v_len, u (unit), d (distance of the centre) and the
    caller's columns; ``cells``: cell, centre, n, parts, radius."""

    rows: DataFrame
    cells: DataFrame


def latest_points(rows: DataFrame, key: str = "cid", version: str = "version", deleted: str = "deleted") -> DataFrame:
    """Of each point its last row; points whose last row is deleted go."""
    others = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*others), version).alias("_last")).select(key, "_last.*")
    return last.filter(~F.coalesce(F.col(deleted), F.lit(False))) if deleted in rows.columns else last


def build_cells(corpus: DataFrame, n_cells: int = 64, sample_rows: int = 20_000, keep: list[str] | None = None) -> CellIndex:
    """corpus: cid, v.  Centres are fitted on the ``sample_rows`` rows of least id hash
    (bounded); every row is indexed.  Vectors without a length (null, zero, with a null
    or non-finite component) are left out: they have no cosine."""
    keep = keep or []
    v = F.col("v")
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (dot(v, v) > 0)
    held = hold(corpus.filter(sound).select("cid", "v", *keep), ["cid", "v", *keep], u=unit(v), v_len=F.sqrt(dot(v, v)))
    points = staged(held, "points")
    sample = points.orderBy(F.xxhash64("cid"), "cid").limit(sample_rows).select(array_to_vector("u").alias("features"))
    if sample.isEmpty():
        empty = points.select(F.lit(0).alias("cell"), F.lit(0).alias("part"), "cid", "v", "v_len", "u", F.lit(0.0).alias("d"), *keep)
        return CellIndex(empty, empty.groupBy("cell").agg(F.any_value("u").alias("centre"), F.count("*").alias("n"), F.lit(1).alias("parts"), F.max("d").alias("radius")))
    model = KMeans(k=n_cells, seed=7, maxIter=10).fit(sample)
    centres = points.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centre array<double>")
    centres = centres.filter(dot(F.col("centre"), F.col("centre")) > 0).withColumn("centre", unit(F.col("centre")))
    numbers, middles = (np.array(x) for x in zip(*[(r.cell, r.centre) for r in centres.orderBy("cell").collect()]))  # n_cells centres

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, _ = dense_blocks.vectors(pa.chunked_array([batch.column("u")]))
            cosine = u @ middles.T
            at = cosine.argmax(axis=1) if len(u) else np.array([], int)
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine[np.arange(len(u)), at]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers[at], pa.int32()), pa.array(d)], names=[*batch.schema.names, "cell", "d"])

    before = points.select("cid", "v", "v_len", "u", *keep)
    dealt = before.mapInArrow(nearest, T.StructType([*before.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("d", T.DoubleType())]))
    placed = staged(dealt, "cells")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("radius")).withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int"))
    cells = staged(sizes.join(centres, "cell"), "centres")
    rows = placed.join(F.broadcast(cells.select("cell", "parts")), "cell").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts").cast("long")).cast("int")).drop("parts")
    return CellIndex(staged(rows, "rows"), cells)


def search_cells(index: CellIndex, queries: DataFrame, k: int, where: Column | None = None, skipped: list[int] | None = None) -> DataFrame:
    """queries: query_id, q.  query_id, cid, score and rank of the k most similar rows that
    ``where`` (over the kept columns) lets through.  ``skipped`` receives the number of
    (query, cell) pairs, of those read, and of the rows kept of those read later."""
    rows = index.rows if where is None else index.rows.filter(where)
    cells = index.cells
    if where is not None:  # what is left of each cell
        left = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("radius"))
        cells = cells.drop("n", "radius").join(left, "cell")
    asked = hold(queries.select("query_id", "q"), ["query_id", "q"], qu=unit(F.col("q")))
    every = cells.agg(F.collect_list(F.struct("cell", "centre", "n", "parts", "radius")).alias("_cells"))  # one row of n_cells cells
    seen = asked.crossJoin(F.broadcast(every)).select("query_id", "q", "qu", F.explode("_cells").alias("c"))
    seen = hold(seen, ["query_id", "q", "c"], far=distance(F.col("qu"), F.col("c.centre")))
    gap = F.greatest(F.lit(0.0), F.col("far") - F.col("c.radius"))
    near = Window.partitionBy("query_id").orderBy("far", "c.cell")
    seen = seen.select("query_id", "q", "c.cell", "c.parts", (1 - gap * gap / 2 + SLACK).alias("bound"), (F.sum("c.n").over(near) - F.col("c.n") < k).alias("first"))
    pairs = staged(seen, "pairs")

    schema = block_schema(queries, rows, [], None)

    def scored(picked: DataFrame) -> DataFrame:
        spread = picked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        # under columns of its own: both sides come from the index
        mine = spread.select(*[F.col(c).alias(c) for c in ("cell", "part", "query_id", "q")])
        return rows.select("cell", "part", "cid", "v").groupBy("cell", "part").cogroup(mine.groupBy("cell", "part")).applyInArrow(best_of_block(k, [], None, schema), schema)

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "cid")
    head = staged(scored(pairs.filter("first")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), "head")
    edge = head.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("edge"))
    rest = pairs.filter("not first").join(edge, "query_id", "left").filter("edge is null or bound >= edge")
    later = scored(rest)
    if skipped is not None:
        later = staged(later, "later")
        skipped += [pairs.count(), pairs.filter("first").count() + rest.count(), later.count()]
    return head.drop("rank").unionByName(later).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
