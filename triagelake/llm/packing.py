"""Packing token sequences by minimum bin slack.

Every document (its ids and an end id) is cut into full windows and one rest.
How many pieces there are of each length is all that the filling depends on: a
histogram of at most ``capacity`` counts, whatever the corpus.  From it windows
are filled one kind after another: the longest length that is left is set, and a
bitset subset-sum over the other lengths with their counts finds the multiset
whose sum comes closest to the capacity; the counts are traced back from the
bitsets, and the same filling repeats as often as the counts allow.  Pieces then
take the places of their length by their number within it.

A window of a power of two needs no padding.  The fillings that miss the
capacity are few (less than one for each length, at the end); their pieces are
laid end to end, cut at the capacity, and the last window is cut into powers of
two, so padding is zero.  (For this the rests' ids are kept with the pieces.)

Pieces are numbered within (length, bucket), buckets being dealt by a hash, and
the buckets' counts give each its first number: a length that a third of all
pieces have is no single group.

Null texts have only the end id.  Repeated rows and ids are packed each on its
own.  Other columns have no effect.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.llm.common import map_texts, stage_table
from triagelake.llm.tokens import encoder

PIECES = "start long, length int, ids_crc32 long, doc_tokens long, ids binary"


# ---- filling windows (from counts of lengths alone) --------------------------

def closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of the lengths in ``counts`` whose sum is closest to ``room``
    from below: bitset subset-sum, with the counts used traced back."""
    lengths = sorted((n for n in counts if 0 < n <= room and counts[n]), reverse=True)
    full, mask, bits, layers = 1 << room, (1 << room + 1) - 1, 1, []
    for n in lengths:
        left = min(counts[n], room // n)
        step = 1
        while left:  # a count as sums of doubling steps
            take = min(step, left)
            layers.append((n, take, bits))
            bits |= bits << n * take & mask
            left -= take
            step *= 2
            if bits & full:
                break
        if bits & full:
            break
    at, used = bits.bit_length() - 1, Counter()
    for n, take, before in reversed(layers):
        if not before >> at & 1:
            used[n] += take
            at -= n * take
    return dict(used)


def fillings(counts: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """[(multiset of lengths, how many windows)] that fill a window exactly, and
    the counts of what is left."""
    left = {n: c for n, c in counts.items() if c}
    out, rest = [], Counter()
    while left:
        longest = max(left)
        left[longest] -= 1
        used = Counter(closest(left, capacity - longest))
        left[longest] += 1
        used[longest] += 1
        if sum(n * c for n, c in used.items()) == capacity:
            times = min(left[n] // c for n, c in used.items())
            out.append((dict(used), times))
            for n, c in used.items():
                left[n] -= c * times
        else:  # nothing fills a window with the longest: it goes to the end
            rest[longest] += left[longest]
            left[longest] = 0
        left = {n: c for n, c in left.items() if c}
    return out, dict(rest)


def places(counts: dict[int, int], capacity: int) -> tuple[pd.DataFrame, int]:
    """Where the pieces of each length go, as ranges of their numbers: length,
    first, last (exclusive), per_window, sequence, offset; the second value is
    the first free sequence.  Lengths without a row there are in no filling."""
    filled, _ = fillings(counts, capacity)
    taken, rows, sequence = Counter(), [], 0
    for used, times in filled:
        offset = 0
        for n in sorted(used, reverse=True):
            c = used[n]
            rows.append((n, taken[n], taken[n] + c * times, c, sequence, offset))
            taken[n] += c * times
            offset += n * c
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "last", "per_window", "sequence", "offset"]), sequence


def tail_windows(total: int, capacity: int) -> list[int]:
    """Lengths of the windows over what fills none: full ones, then powers of two."""
    last = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in reversed(range(last.bit_length())) if last >> b & 1]


# ---- on DataFrames -----------------------------------------------------------

def cut_pieces(df: DataFrame, path: str, capacity: int = 1024, end_id: int | None = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Full windows and the rest of every document, with crc32 of the piece's ids
    as little-endian 4-byte integers; ``ids``: these, packed, of the rests only."""

    def cut(texts: list) -> tuple[list, list]:
        enc = encoder(path)
        end = b"" if end_id is None else enc.pack([end_id])
        index, rows = [], []
        for i, body in enumerate(texts):
            ids = np.frombuffer(enc.encode_packed(body) + end, enc.dtype)
            for at in range(0, len(ids), capacity):
                piece = ids[at : at + capacity]
                rest = piece.tobytes() if len(piece) < capacity else None
                index.append(i)
                rows.append((at, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), len(ids), rest))
        return index, rows

    base = df.select(
        F.col(key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), F.col(text).alias("text")
    )
    return map_texts(base, ["doc_id", "row_id"], cut, PIECES)


def _numbered(pieces: DataFrame, n_pieces: int, per_bucket: int = 100_000) -> DataFrame:
    """``nth``: number of each piece within its length, from 0."""
    buckets = F.pmod(F.xxhash64("row_id", "start"), F.lit(max(1, -(-n_pieces // per_bucket))))
    dealt = pieces.withColumn("bucket", buckets)
    by_length = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("length", "bucket").count().select(
        "length", "bucket", F.coalesce(F.sum("count").over(by_length), F.lit(0)).alias("before")
    )
    within = Window.partitionBy("length", "bucket").orderBy("row_id", "start")
    return (
        dealt.withColumn("nth", F.row_number().over(within) - 1)
        .join(before, ["length", "bucket"])
        .withColumn("nth", F.col("nth") + F.col("before"))
        .drop("bucket", "before")
    )


def pack(df: DataFrame, path: str, capacity: int = 1024, end_id: int | None = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of
    every piece; each id of each document lies in exactly one."""
    spark = df.sparkSession
    dtype = encoder(path).dtype
    pieces = stage_table(spark, cut_pieces(df, path, capacity, end_id, key, text), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    n_pieces = sum(counts.values())
    ranges, free = places(counts, capacity)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    # The ranges depend on the capacity alone: a few for each filling, and each
    # filling uses up a length or most of it.
    table = spark.createDataFrame(
        ranges.astype(object).values.tolist(),
        "of int, first long, last long, per_window int, sequence long, at int",
    )
    nth = F.col("nth") - F.col("first")
    full = (
        _numbered(pieces.drop("ids"), n_pieces)
        .join(F.broadcast(table), (F.col("of") == F.col("length")) & (F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("last")))
        .select(
            *names,
            (F.col("sequence") + F.floor(nth / F.col("per_window"))).cast("long").alias("sequence_id"),
            (F.col("at") + nth % F.col("per_window") * F.col("length")).cast("long").alias("offset"),
        )
    )
    used = {} if ranges.empty else ranges.groupby("length")["last"].max().to_dict()
    used = {n: int(used.get(n, 0)) for n in counts}
    left = sorted((n for n in counts if counts[n] > used[n]), reverse=True)
    if left:
        lies_at, total = {}, 0
        for n in left:
            lies_at[n] = total - used[n] * n
            total += n * (counts[n] - used[n])
        full = full.unionByName(_tail(pieces, n_pieces, left, used, lies_at, total, free, capacity, dtype).select(full.columns))
    return full.withColumn("length", F.col("length").cast("long"))


def _tail(pieces, n_pieces, left, used, lies_at, total, free, capacity, dtype) -> DataFrame:
    """The pieces in no filling, end to end and cut at the windows' borders."""
    n_full = total // capacity
    small = np.cumsum([n_full * capacity, *tail_windows(total, capacity)[n_full:]])

    def cut(rests: list) -> tuple[list, list]:
        index, rows = [], []
        for i, r in enumerate(rests):
            ids = np.frombuffer(r["ids"], dtype).astype("<u4")
            lo = begin = lies_at[r["length"]] + r["nth"] * r["length"]
            end = begin + r["length"]
            while lo < end:
                if lo < n_full * capacity:
                    window, base = lo // capacity, lo - lo % capacity
                    hi = min(end, base + capacity)
                else:
                    k = int(np.searchsorted(small, lo, side="right")) - 1
                    window, base, hi = n_full + k, int(small[k]), min(end, int(small[k + 1]))
                crc = zlib.crc32(ids[lo - begin : hi - begin].tobytes())
                index.append(i)
                rows.append((lo - begin, hi - lo, crc, free + window, lo - base))
                lo = hi
        return index, rows

    skipped = F.create_map(*[F.lit(x) for n in left for x in (n, used[n])])
    rest = pieces.filter(F.col("length").isin(left))
    wanted = _numbered(rest.drop("ids"), n_pieces).filter(F.col("nth") >= skipped[F.col("length")]).select("row_id", "start", "nth")
    rows = rest.join(wanted, ["row_id", "start"]).withColumn("text", F.struct("length", "nth", "ids"))
    rows = rows.select("doc_id", F.col("start").alias("from"), "doc_tokens", "text")
    schema = "shift long, length int, ids_crc32 long, sequence_id long, offset long"
    return map_texts(rows, ["doc_id", "from", "doc_tokens"], cut, schema).withColumn("start", F.col("from") + F.col("shift"))
