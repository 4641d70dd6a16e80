"""Exact cosine top-k by matrices: the query vectors meet block after block of a task's rows.

A task keeps only the best k of each query (and group) in its blocks, so no row is made of a
pair.  Scores are rounded to six places as Spark's ``round`` of the plain sums: the matrix
product orders its sums otherwise, so what lies near a border of rounding is summed again
in order.  A score with a null component or vectors of two lengths is null and comes last;
one that is no number (a vector without length) comes first, as in a descending sort.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.sources.staging import read_rows, shared_path

#: Rows of a block at most and, where there are tasks enough, at least; tasks, where there are fewer cores;
#: queries of a pass, at most and at least; scores held at once.
BLOCK_ROWS, LEAST_ROWS, LEAST_TASKS, BLOCK_QUERIES, LEAST_QUERIES, HELD = 65_536, 16_384, 8, 8192, 64, 1 << 21
#: Rows that a task holds of what its blocks found, and of an output batch.
STATE, OUTPUT_ROWS = 1 << 21, 1 << 16
#: Keys of scores that are null, and of rows that are out.
NULL, OUT = -1e308, -np.inf


def vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of doubles, and how long each vector is (-1: null or with a null component)."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    width = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    values = pc.fill_null(pc.cast(flat, pa.float64(), safe=False), 0.0).to_numpy(zero_copy_only=False)
    most, own = max(0, int(width.max(initial=0))), np.maximum(width, 0)
    starts = np.cumsum(own) - own
    if len(width) and (own == most).all():
        out = values.reshape(len(width), most)
    else:
        out = np.zeros((len(width), most))
        whose = np.repeat(np.arange(len(width)), own)
        out[whose, np.arange(len(values)) - starts[whose]] = values
    if flat.null_count:
        holes = np.flatnonzero(pc.is_null(flat).to_numpy(zero_copy_only=False))
        width[np.repeat(np.arange(len(width)), own)[holes]] = -1
    return out, width


def in_order(products: np.ndarray) -> np.ndarray:
    """Sums of the rows, from the first component to the last."""
    return np.cumsum(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def half_up(x: float) -> float:
    return float(Decimal(repr(float(x))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) + 0.0 if np.isfinite(x) else x


class Cosines:
    """Scores of queries against a block's rows, as keys of a descending sort."""

    def __init__(self, rows: pa.ChunkedArray):
        self.rows, self.width = vectors(rows)
        self.length = np.sqrt(in_order(self.rows * self.rows))
        self.unit = self.rows / self.length[:, None]
        self.wild = np.flatnonzero(~np.isfinite(self.length) | (self.length < 1e-150))

    def keys(self, q: np.ndarray, q_width: np.ndarray) -> np.ndarray:
        rows, length = self.rows, self.length
        most = max(q.shape[1], rows.shape[1])
        if most > q.shape[1]:
            q = np.pad(q, ((0, 0), (0, most - q.shape[1])))
        if most > rows.shape[1]:
            pad = ((0, 0), (0, most - rows.shape[1]))
            self.rows, self.unit = rows, _ = np.pad(rows, pad), np.pad(self.unit, pad)
        q_length = np.sqrt(in_order(q * q))
        scores = (q / q_length[:, None]) @ self.unit.T
        scores *= 1e6
        size = np.abs(scores)
        floor = np.floor(size)
        size -= floor
        i, j = np.nonzero(np.abs(size - 0.5) < 1e-5)
        key = np.copysign(floor + (size >= 0.5), scores) / 1e6 + 0.0
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            key[a, b] = [half_up(x) for x in in_order(q[a] * rows[b]) / (q_length[a] * length[b])]
        # lengths beyond the range of doubles, or none
        for r in self.wild:
            key[:, r] = [half_up(x) for x in in_order(q * rows[r]) / (q_length * length[r])]
        for r in np.flatnonzero(~np.isfinite(q_length) | (q_length < 1e-150)):
            key[r] = [half_up(x) for x in in_order(q[r] * rows) / (q_length[r] * length)]
        key[np.isnan(key)] = np.inf
        if (self.width != most).any() or (q_width != most).any():
            key[(q_width[:, None] != self.width[None, :]) | (q_width < 0)[:, None]] = NULL
        return key


def codes(table: pa.Table, columns: list[str]) -> np.ndarray:
    """A number for each combination of values (nulls are a value)."""
    if not columns:
        return np.zeros(len(table), np.int64)
    each = [table.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in columns]
    each = [(e.combine_chunks() if isinstance(e, pa.ChunkedArray) else e).indices.to_numpy(zero_copy_only=False) for e in each]
    return np.unique(np.stack(each, axis=1), axis=0, return_inverse=True)[1].reshape(-1)


def best(keys: np.ndarray, borders: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) places of the k highest keys of each query in each part of the rows; ties
    go to the earlier row."""
    for a, b in zip(borders[:-1], borders[1:]):
        part = keys[:, a:b]
        if b - a > k:
            edge = np.partition(part, b - a - k, axis=1)[:, b - a - k]
            i, j = np.nonzero((part >= edge[:, None]) & (part > OUT))
        else:
            i, j = np.nonzero(part > OUT)
        order = np.lexsort((j, -part[i, j], i))
        i, j = i[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        yield i[place < k], j[place < k] + a


def once_each(keys: np.ndarray, order: np.ndarray, starts: np.ndarray) -> None:
    """Of each query and run of rows (``order`` brings them together) only the best row stays."""
    mine = keys[:, order]
    sizes = np.diff(np.r_[starts, len(order)])
    top = np.repeat(np.maximum.reduceat(mine, starts, axis=1), sizes, axis=1) == mine
    seen = np.cumsum(top, axis=1, dtype=np.int32)
    before = seen[:, starts] - top[:, starts]
    first = top & (seen - np.repeat(before, sizes, axis=1) == 1)
    mine[~first] = OUT
    keys[:, order] = mine


def best_rows(rows: pa.Table, asked: pa.Table, k: int, by: list[str], once: str | None) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Of one block (cid, v, by, once) and queries (query_id, q): the query's place and the rows found."""
    with np.errstate(all="ignore"):
        rank = pc.rank(rows.column("cid").combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)
        group = codes(rows, by)
        rows = rows.take(pa.array(np.lexsort((rank, group))))
        rank, group = np.sort(rank) if not by else rank[np.lexsort((rank, group))], np.sort(group)
        borders = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)]
        if once:
            same = codes(rows, [once])
            order = np.lexsort((rank, same))
            starts = np.flatnonzero(np.r_[True, same[order][1:] != same[order][:-1]])
        block = Cosines(rows.column("v"))
        q, q_width = vectors(asked.column("q"))
        step = max(1, HELD // len(rows))
        for lo in range(0, len(q), step):
            keys = block.keys(q[lo : lo + step], q_width[lo : lo + step])
            if once:
                once_each(keys, order, starts)
            found = list(best(keys, borders, k))
            i, j = (np.concatenate(x) for x in zip(*found))
            score = keys[i, j]
            score = pa.array(np.where(score == np.inf, np.nan, score), mask=score == NULL)
            whose, which = asked.column("query_id").combine_chunks().take(pa.array(i + lo)), pa.array(j)
            kept = {c: rows.column(c).take(which) for c in dict.fromkeys([*by, *([once] if once else []), "cid"])}
            yield i + lo, pa.table({"query_id": whose, **kept, "score": score})


def best_of_block(k: int, by: list[str], once: str | None, schema: T.StructType):
    """For a cogroup: rows of one block (cid, v, by, once), queries (query_id, q)."""
    names = schema.names

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        made = [t.select(names) for _, t in best_rows(left, right, k, by, once)] if len(left) and len(right) else []
        if made:
            return pa.concat_tables(made)
        kinds = {"score": pa.float64(), "query_id": right.schema.field("query_id").type}
        return pa.table({n: pa.array([], kinds[n] if n in kinds else left.schema.field(n).type) for n in names})

    return one


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each run of one ``_block``."""
    held, mark = [], None
    for batch in batches:
        marks = batch.column("_block").to_numpy()
        cuts = np.r_[np.flatnonzero(np.diff(marks, prepend=-1)), len(marks)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if held and marks[lo] != mark:
                yield pa.Table.from_batches(held)
                held = []
            mark = marks[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def k_best(place: np.ndarray, found: pa.Table, k: int, by: list[str]) -> tuple[np.ndarray, pa.Table]:
    """The k best rows of each query (its place) and group among those of several blocks."""
    score = found.column("score").combine_chunks()
    key = pc.fill_null(score, NULL).to_numpy(zero_copy_only=False)
    key = np.where(np.isnan(key), np.inf, key)
    rank = pc.rank(found.column("cid").combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)
    group = codes(found, by)
    order = np.lexsort((rank, -key, group, place))
    a, b = place[order], group[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    order = order[np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)])) < k]
    return place[order], found.take(pa.array(order))


def best_of_task(path: str, k: int, by: list[str], once: str | None, names: list[str]):
    """For rows in runs of ``_block``: the k best of each query (staged under ``path``) and group
    in all blocks of the task.  Beyond STATE rows those found so far go out, and it begins anew."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, places, tables, rows, blocks = read_rows(path, ["query_id", "q"]), [], [], 0, 0
        if not len(asked):
            return
        for block in blocks_of(batches):
            blocks += 1
            for place, found in best_rows(block, asked, k, by, once):
                places.append(place)
                tables.append(found)
                rows += len(place)
                if rows > STATE:
                    if blocks > 1:
                        place, found = k_best(np.concatenate(places), pa.concat_tables(tables), k, by)
                        places, tables, rows = [place], [found], len(place)
                    if rows > STATE // 2:
                        for t in tables:
                            yield from t.select(names).to_batches(OUTPUT_ROWS)
                        places, tables, rows, blocks = [], [], 0, 1
        if rows:
            if blocks > 1:
                tables = [k_best(np.concatenate(places), pa.concat_tables(tables), k, by)[1]]
            for t in tables:
                yield from t.select(names).to_batches(OUTPUT_ROWS)

    return rank


def block_schema(queries: DataFrame, corpus: DataFrame, by: list[str], once: str | None) -> T.StructType:
    kept = list(dict.fromkeys([*by, *([once] if once else []), "cid"]))
    return T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), *[T.StructField(c, corpus.schema[c].dataType) for c in kept], T.StructField("score", T.DoubleType())])


def grid(n_rows: int, cores: int) -> tuple[int, int]:
    """Blocks of rows, bounded in memory, and the tasks that take them: as many as keep the cluster
    busy, however many rows there are, since each task shuffles its best of every query."""
    tasks = max(LEAST_TASKS, cores)
    blocks = max(-(-n_rows // BLOCK_ROWS), min(tasks, -(-n_rows // LEAST_ROWS)), 1)
    return blocks, min(blocks, tasks)


def block_top_k(queries: DataFrame, corpus: DataFrame, k: int, by: list[str] | None = None, once: str | None = None) -> DataFrame:
    """queries: query_id, q; corpus: cid, v, ``by``, ``once``.  query_id, by, once, cid and score: of
    each query, task and group the k best, so that the k best of all are among them.  With
    ``once``, of the rows with one value of that column only each query's best takes part.

    Rows are shuffled once; the queries lie in the shared folder.  What is shuffled, of rows and of
    those found, grows with rows plus queries; queries beyond a task's memory take another pass."""
    by = by or []
    spark = corpus.sparkSession
    schema = block_schema(queries, corpus, by, once)
    asked = queries.select("query_id", "q")
    rows = corpus.select(*[c for c in schema.names if c not in ("query_id", "score")], "v")
    n_rows, n_groups = rows.agg(F.count("*"), F.approx_count_distinct(F.struct(*by)) if by else F.lit(1)).first()
    n_queries = asked.count()
    blocks, tasks = grid(n_rows, spark.sparkContext.defaultParallelism)
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(once or "cid"), F.lit(blocks)).cast("int"))
    rows = rows.repartitionById(tasks, F.col("_block") % tasks)
    rows = rows.sortWithinPartitions("_block") if blocks > tasks else rows
    at_once = min(BLOCK_QUERIES, max(LEAST_QUERIES, STATE // (2 * k * max(1, n_groups))))
    passes = max(1, -(-n_queries // at_once))
    dealt = F.pmod(F.xxhash64("query_id", "q"), F.lit(passes))
    found = []
    for i in range(passes):
        path = shared_path(spark, "asked")
        asked.filter(dealt == i).coalesce(1).write.parquet(path)
        found.append(rows.mapInArrow(best_of_task(path, k, by, once, schema.names), schema))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every
