"""Exact top-k by inner product with a three-phase uniform threshold.

Vectors become integers.  Queries and candidates are packed into blocks of rows,
every query block meets every candidate block once, and the dimensions are cut
into m lists, each giving a local score (the inner product over its dimensions).

1. Each list of a block names its k best candidates of a query among an eighth of the
   block's rows, those of the greatest norms (``gathered``); their exact sums are taken,
   and the k-th best of all blocks' sums is a safe cutoff: k vectors reach it.
2. The cutoff goes to all blocks.  A vector that reaches the cutoff c has a local
   score of c / m or more in one list at least, so each list collects its entries
   from there on; one that no list collects is out.  A list whose norms (the query's
   times the greatest of a slice of candidates) stay below c / m is not computed for that
   query there; blocks are filled in the order of norms.
3. A collected vector's sum is at most its seen local scores and c / m for each
   list that has not collected it; where that bound reaches c, the exact sum is
   taken, and sums of c or more go to the final ranking.

Sums are exact: floats hold them only if no sum can pass 2**53, else 64-bit integers,
and Python's where these could wrap.  A scaled component of 2**62 or more, and a
reported score of more than 64 bits, is an error that says so.  Vectors that are null or hold a null, NaN or infinity take no part; of
vectors of different lengths the shorter counts as filled up with zeros.
Repeated rows take part each on its own; a query never meets rows of its own id.
Only the two named columns are read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.llm.common import stage_table

BLOCK = "block long, ids binary, rows binary, width int"


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def to_integers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, x as double; an error from 2**62 on."""
    def one(x: Column) -> Column:
        scaled = F.lit(scale) * x.cast("double")
        too_large = F.raise_error(F.concat(F.lit("scaled component of 2**62 or more: "), scaled.cast("string"))).cast("long")
        return F.when(F.abs(scaled) < 2.0**62, F.floor(scaled)).otherwise(too_large)

    return F.transform(vector, one)


def pack_blocks(df: DataFrame, rows: int) -> DataFrame:
    """(vec_id, v) into blocks of at most ``rows`` vectors of one width, within each task."""

    def pack(frames: Iterator) -> Iterator:
        held: dict[int, list] = {}
        for frame in frames:
            for vec_id, v in zip(frame["vec_id"], frame["v"]):
                group = held.setdefault(len(v), [])
                group.append((vec_id, v))
                if len(group) >= rows:
                    yield block(len(v), held.pop(len(v)))
            if sum(map(len, held.values())) >= 4 * rows:
                for width in list(held):
                    yield block(width, held.pop(width))
        for width in list(held):
            yield block(width, held.pop(width))

    def block(width: int, group: list) -> pd.DataFrame:
        ids = np.array([g[0] for g in group], "<i8")
        data = np.array([g[1] for g in group], "<i8").reshape(len(group), width)
        return pd.DataFrame({"block": [0], "ids": [ids.tobytes()], "rows": [_narrow(data)], "width": [width]})

    return df.mapInPandas(pack, BLOCK).withColumn("block", F.monotonically_increasing_id())


def _narrow(data: np.ndarray) -> bytes:
    """One byte for the item size, then the integers in it."""
    most = int(np.abs(data).max()) if data.size else 0
    size = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([size]) + data.astype(f"<i{size}").tobytes()


def _wide(raw: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).reshape(n, width)


def _matrices(q: np.ndarray, c: np.ndarray, n_lists: int):
    """Both with one width, in a type that holds every sum, and the lists' borders."""
    width = max(q.shape[1], c.shape[1])
    top = [int(np.abs(x).max()) if x.size else 0 for x in (q, c)]
    most = top[0] * top[1] * max(1, width)
    kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
    q, c = (np.pad(x.astype(kind), ((0, 0), (0, width - x.shape[1]))) for x in (q, c))
    return q, c, np.linspace(0, width, n_lists + 1).astype(int)


def as_longs(scores: np.ndarray) -> np.ndarray:
    """Exact sums as 64-bit integers, or an error."""
    if scores.dtype == object and any(abs(int(s)) >= 1 << 63 for s in scores):
        raise OverflowError("a score needs more than 64 bits")
    return scores.astype(np.int64)


def local_scores(q, c, borders) -> np.ndarray:
    """lists x queries x candidates."""
    return np.stack([q[:, a:b] @ c[:, a:b].T for a, b in zip(borders[:-1], borders[1:])])


def phase_one(q_ids, q, c_ids, c, k: int, n_lists: int) -> Iterator[tuple[int, int]]:
    """(query, exact sum) of the k best sums among the candidates that the lists name."""
    q, c, borders = _matrices(q, c, n_lists)
    for lo in range(0, len(q), 256):
        scores = local_scores(q[lo : lo + 256], c, borders)
        own = q_ids[lo : lo + 256, None] == c_ids[None, :]
        total = scores.sum(axis=0)
        # floats choose the candidates; their sums are taken from ``total``
        scores = np.where(own[None], -np.inf, scores.astype(float))
        top = min(k, len(c_ids))
        named = np.argpartition(scores, -top, axis=2)[:, :, -top:]
        for i in range(scores.shape[1]):
            who = np.unique(named[:, i])
            who = who[~own[i, who]]
            for s in np.sort(total[i, who])[::-1][:k]:
                yield int(q_ids[lo + i]), str(int(s))


def gathered(n: int, k: int) -> int:
    """How many of a block's n rows phase one looks at."""
    return min(n, max(4 * k, -(-n // 8)))


def norms(x: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """lists x rows."""
    f = x.astype(float)
    return np.stack([np.sqrt((f[:, a:b] ** 2).sum(axis=1)) for a, b in zip(borders[:-1], borders[1:])])


def phases_two_and_three(q_ids, q, cutoffs, c_ids, c, n_lists: int, slice_rows: int = 512, done: list | None = None) -> Iterator[pd.DataFrame]:
    """(query_id, vec_id, score) of every candidate that reaches the query's cutoff; to
    ``done`` goes how many local scores each slice took."""
    q, c, borders = _matrices(q, c, n_lists)
    q_norms, c_norms = norms(q, borders), norms(c, borders)
    for lo in range(0, len(q), 256):
        mine, my_ids = q[lo : lo + 256], q_ids[lo : lo + 256]
        known = ~np.isnan(cutoffs[lo : lo + 256])
        cut = np.where(known, np.nan_to_num(cutoffs[lo : lo + 256]), -np.inf)
        cut = np.where(np.abs(cut) < 2.0**53, cut, np.nextafter(cut, -np.inf))  # a float may have rounded it up
        share = np.nextafter(cut / n_lists, -np.inf)[:, None]
        slack = 1e-6 * np.maximum(1.0, np.abs(np.where(known, cut, 0)))[:, None]  # the bound is rounded
        for at in range(0, len(c), slice_rows):
            part, part_ids = c[at : at + slice_rows], c_ids[at : at + slice_rows]
            most = q_norms[:, lo : lo + 256] * c_norms[:, at : at + slice_rows].max(axis=1)[:, None]  # lists x queries
            needed = most * (1 + 1e-9) >= share[None, :, 0]
            if done is not None:
                done.append(int(needed.sum()) * len(part))
            if not needed.any():
                continue
            bound, some = np.zeros((len(mine), len(part))), np.zeros((len(mine), len(part)), bool)
            for i in range(n_lists):
                who = needed[i]
                bound[~who] += share[~who]
                if not who.any():
                    continue
                asks = mine[:, borders[i] : borders[i + 1]] if who.all() else mine[who, borders[i] : borders[i + 1]]
                scores = asks @ part[:, borders[i] : borders[i + 1]].T
                near = scores.astype(float)  # of sums beyond 2**53 the bounds are rounded, the exact sums below are not
                near = near if scores.dtype == np.float64 else np.nextafter(near, np.inf)
                collected = near >= share[who]
                bound[who] += np.where(collected, near, share[who])
                some[who] |= collected
            open_ = some & (bound + slack >= cut[:, None]) & (my_ids[:, None] != part_ids[None, :])
            i, j = np.nonzero(open_)
            exact = (mine[i] * part[j]).sum(axis=1)
            reach = (exact >= cut[i]).astype(bool)
            i, j, exact = i[reach], j[reach], exact[reach]
            if len(i):
                yield pd.DataFrame({"query_id": my_ids[i], "vec_id": part_ids[j], "score": as_longs(exact)})


def top_k(
    df: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, n_lists: int = 4,
    query_rows: int = 1024, candidate_rows: int = 4096, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` the k rows of
    other ids with the highest inner products, ties to the smaller vec_id."""
    spark = df.sparkSession
    rows = df.filter(F.col(key).isNotNull() & usable(F.col(vector)))
    ints = to_integers(F.col(vector), scale)
    each = rows.select(F.col(key).alias("vec_id"), ints.alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    by_norm = each.withColumn("norm", norm).sortWithinPartitions(F.desc("norm")).drop("norm")
    candidates = stage_table(spark, pack_blocks(by_norm, candidate_rows), "candidates")
    asked = rows.filter(is_query).select(F.col(key).alias("vec_id"), ints.alias("v")).dropDuplicates()
    queries = stage_table(spark, pack_blocks(asked, query_rows), "queries")

    # Every query block meets every candidate block: a copy of it for each group of these.
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = candidates.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)))

    def meet(asked: DataFrame) -> DataFrame:
        asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns])
        return asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>"))).join(dealt, "g")

    def read(r):
        q_ids, ids = np.frombuffer(r.q_ids, "<i8"), np.frombuffer(r.ids, "<i8")
        return q_ids, _wide(r.q_rows, len(q_ids), r.q_width), ids, _wide(r.rows, len(ids), r.width)

    def first(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                q_ids, q, c_ids, c = read(r)
                n = gathered(len(c_ids), k)
                yield pd.DataFrame(phase_one(q_ids, q, c_ids[:n], c[:n], k, n_lists), columns=["query_id", "score"])

    # as text, for sums that no long holds
    sums = meet(queries).mapInPandas(first, "query_id long, score string").withColumn("score", F.col("score").cast("decimal(38,0)"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    cutoffs = sums.withColumn("n", F.row_number().over(best)).filter(F.col("n") == k).select("query_id", F.col("score").cast("double").alias("cutoff"))
    cutoffs = stage_table(spark, cutoffs, "cutoffs")

    # The cutoffs go with their query blocks to all candidate blocks.
    def unpack(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                ids = np.frombuffer(r.ids, "<i8")
                yield pd.DataFrame({"block": r.block, "at": np.arange(len(ids)), "query_id": ids})

    listed = queries.mapInPandas(unpack, "block long, at int, query_id long").join(cutoffs, "query_id", "left")
    per_block = listed.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "cutoff"))), lambda s: s["cutoff"]).alias("cutoffs"))

    def last(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                q_ids, q, c_ids, c = read(r)
                cut = np.array([np.nan if x is None else x for x in r.q_cutoffs], float)
                yield from phases_two_and_three(q_ids, q, cut, c_ids, c, n_lists)

    reach = meet(queries.join(per_block, "block")).mapInPandas(last, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reach.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
