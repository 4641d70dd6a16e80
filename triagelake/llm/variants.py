"""Spelling variants: words one edit apart, each led to its most frequent neighbour.

Words are maximal runs of letters ``[A-Za-z\\u00C0-\\u00FF]``, only A-Z lower-cased, of at
least ``min_letters`` code points and ``min_count`` occurrences.  Two words are near when
one inserted, deleted or replaced code point makes one of the other.

Every word's edits are generated as 64-bit keys (replacements by a later letter, and
deletions: each pair is met from one side) and asked of blocked Bloom filters, one for
each length; lengths of ``LAST_SHARD`` and more share one.  Filters go to the tasks by
broadcast, at most ``filter_bytes`` at a time: a vocabulary with larger filters is probed
in several passes, parts of one length's filter among them, so what is broadcast never
grows with the data.  Only edits that a filter lets through are shuffled, as (word's key,
edit's key); the join with the vocabulary and a comparison of the two words then remove
every false positive, also those of equal keys.

A null text has no words; a null id counts as the empty text in ``damaged_words``.
Repeated rows count each.  An empty table gives an empty result.  Only the named columns
are read; others, whatever their names, have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.llm.common import bound_batches, stage_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of this many code points or more share a filter.
LAST_SHARD = 64
BITS_PER_WORD = 24
FILTER_BYTES = 64 << 20
#: Elements of the arrays that a task holds at once.
CELLS = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


# ---- words -------------------------------------------------------------------

def runs(text: Column | str, min_letters: int = 1) -> Column:
    """Array of the maximal runs of letters with at least ``min_letters``, A-Z lower-cased."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.translate(col, UPPER, LOWER), F.lit(f"[a-zÀ-ÿ]{{{min_letters},}}"), F.lit(0))


def damaged_words(df: DataFrame, min_letters: int = 6, one_in: int = 199, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row ``word`` an occurrence.  Where ``one_in`` divides the CRC-32 of
    ``<id>:<run>``, the run has lost its code point at that CRC modulo its length."""
    each = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(runs(text, min_letters)).alias("run"))
    crc = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    place = (crc % F.length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    return each.select(F.when(crc % one_in == 0, lost).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= min_letters)


def vocabulary_of(words: DataFrame, min_count: int = 5) -> DataFrame:
    """word and its number of occurrences n, where that is at least ``min_count``."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


# ---- keys of words and of their edits ----------------------------------------

def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit keys (the finisher of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letter_values(codes: np.ndarray) -> np.ndarray:
    return mixed(codes.astype(np.uint64) + np.uint64(BASE))


def powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = BASE
    return np.multiply.accumulate(out)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the list, code points) of words of one length; few letters at once."""
    places: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(len(w), []).append(i)
    for size, index in places.items():
        step = max(1, CELLS // max(1, size))
        for at in range(0, len(index), step):
            part = index[at : at + step]
            letters = "".join(words[i] for i in part).encode("utf-32-le", "surrogatepass")
            yield np.array(part), np.frombuffer(letters, np.uint32).reshape(len(part), size)


def word_keys(words: list[str]) -> np.ndarray:
    """Sum of the letters' values times powers of an odd base, modulo 2**64."""
    out = np.zeros(len(words), np.uint64)
    for index, codes in by_length(words):
        out[index] = (letter_values(codes) * powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)
    return out


def replacements(codes: np.ndarray, keys: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of every replacement of a letter by a later letter of ``alphabet``."""
    power = powers(codes.shape[1])
    rest = keys[:, None] - letter_values(codes) * power
    for c, value in zip(alphabet, letter_values(alphabet), strict=True):
        row, place = np.nonzero(codes < c)
        yield row, rest[row, place] + value * power[place]


def deletions(codes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every word with one letter less; of equal neighbours one."""
    terms = letter_values(codes) * powers(codes.shape[1])
    before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
    after = keys[:, None] - before - terms
    other = np.ones(codes.shape, bool)
    other[:, 1:] = codes[:, 1:] != codes[:, :-1]
    row, place = np.nonzero(other)
    return row, before[row, place] + after[row, place] * np.uint64(INVERSE)


# ---- filters -----------------------------------------------------------------

def shard_of(n_letters: int) -> int:
    return min(n_letters, LAST_SHARD)


def place_bits(keys: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of 64 bits of each key and the five bits (some may meet) it sets there."""
    m = mixed(keys)
    block = ((m >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)
    mask, low = np.zeros(len(m), np.uint64), mixed(m)
    for k in range(5):
        mask |= np.uint64(1) << ((low >> np.uint64(6 * k)) & np.uint64(63))
    return block.astype(np.int64), mask


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(keys ^ np.uint64(BASE)) % np.uint64(parts)).astype(np.int64)


class Plan:
    """Sizes of the filters: of each shard its parts and the 64-bit blocks of a part."""

    def __init__(self, counts: dict[int, int], filter_bytes: int = FILTER_BYTES):
        self.parts, self.blocks, self.passes = {}, {}, []
        room = 0
        for shard in sorted(counts):
            size = max(64, counts[shard] * BITS_PER_WORD // 8)
            self.parts[shard] = parts = -(-size // filter_bytes)
            self.blocks[shard] = -(-size // parts // 8)
            for part in range(parts):
                if not self.passes or room < self.blocks[shard] * 8:
                    self.passes.append([])
                    room = filter_bytes
                self.passes[-1].append((shard, part))
                room -= self.blocks[shard] * 8

    def units(self, shard: int, keys: np.ndarray, wanted: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray]]:
        """(part, places of the keys in it) for the parts of ``shard`` that are wanted."""
        own = [p for s, p in wanted if s == shard]
        if not own:
            return
        if self.parts[shard] == 1:
            yield 0, np.arange(len(keys))
            return
        part = part_of(keys, self.parts[shard])
        for p in own:
            yield p, np.flatnonzero(part == p)


def with_keys(vocabulary: DataFrame) -> DataFrame:
    """``vocabulary`` with n_letters and the 64-bit key of each word."""
    bound_batches(vocabulary.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            words = frame.column("word").to_pylist()
            sizes = pa.array([len(w) for w in words], pa.int64())
            yield pa.RecordBatch.from_arrays([*frame.columns, sizes, pa.array(word_keys(words).view(np.int64))], names=["word", "n", "n_letters", "key"])

    return vocabulary.select("word", "n").mapInArrow(run, "word string, n long, n_letters long, key long")


def build_filters(keyed: DataFrame, plan: Plan, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """The filters of one pass: blocks of the tasks are joined by OR before and after one
    shuffle; at most the bytes of a pass reach the driver."""
    shards = sorted({s for s, _ in wanted})

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            sizes = np.minimum(frame.column("n_letters").to_numpy(), LAST_SHARD)
            keys = frame.column("key").to_numpy().view(np.uint64)
            for shard in np.unique(sizes).tolist():
                own = keys[sizes == shard]
                for part, index in plan.units(shard, own, wanted):
                    block, mask = place_bits(own[index], plan.blocks[shard])
                    n = len(index)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(block), pa.array(mask.view(np.int64))],
                        names=["shard", "part", "block", "mask"],
                    )

    rows = keyed.filter(F.least("n_letters", F.lit(LAST_SHARD)).isin(shards)).select("n_letters", "key")
    blocks = rows.mapInArrow(run, "shard int, part int, block long, mask long").groupBy("shard", "part", "block").agg(F.expr("bit_or(mask)").alias("mask"))
    got = blocks.toArrow()
    shard, part, block, mask = (got.column(c).to_numpy() for c in ("shard", "part", "block", "mask"))
    out = {}
    for s, p in wanted:
        own = (shard == s) & (part == p)
        out[s, p] = np.zeros(plan.blocks[s], np.uint64)
        out[s, p][block[own]] = mask[own].view(np.uint64)
    return out


def probe(words: list[str], keys: np.ndarray, alphabet: np.ndarray, plan: Plan, filters: dict[tuple[int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(key of a word, key of an edit) for the edits that the filters let through."""
    from_word, to_edit = [], []
    wanted = sorted(filters)

    def ask(shard: int, row_keys: np.ndarray, row: np.ndarray, edits: np.ndarray) -> None:
        if shard not in plan.blocks:
            return
        for part, index in plan.units(shard, edits, wanted):
            block, mask = place_bits(edits[index], plan.blocks[shard])
            index = index[(filters[shard, part][block] & mask) == mask]
            from_word.append(row_keys[row[index]])
            to_edit.append(edits[index])

    for index, codes in by_length(words):
        size, own = codes.shape[1], keys[index]
        if any(s == shard_of(size) for s, _ in wanted):
            for row, edits in replacements(codes, own, alphabet):
                ask(shard_of(size), own, row, edits)
        if any(s == shard_of(size - 1) for s, _ in wanted):
            ask(shard_of(size - 1), own, *deletions(codes, own))
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *from_word]), np.concatenate([none, *to_edit])


# ---- neighbours and forms ----------------------------------------------------

def candidates(keyed: DataFrame, alphabet: np.ndarray, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word_key and edit_key of all edits that pass the filters."""
    spark = keyed.sparkSession
    shard = F.least("n_letters", F.lit(LAST_SHARD))
    # at most LAST_SHARD rows
    plan = Plan({r["shard"]: r["count"] for r in keyed.groupBy(shard.cast("int").alias("shard")).count().collect()}, filter_bytes)
    found = []
    for wanted in plan.passes:
        sent = spark.sparkContext.broadcast(build_filters(keyed, plan, wanted))

        def run(frames: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                for at in range(0, len(frame), 2000):
                    part = frame.slice(at, 2000)
                    words, keys = part.column("word").to_pylist(), part.column("key").to_numpy().view(np.uint64)
                    a, b = probe(words, keys, alphabet, plan, sent.value)
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["word_key", "edit_key"])

        shards = {s for s, _ in wanted}
        asks = shard.isin(sorted(shards | {s + 1 for s in shards if s < LAST_SHARD}))
        found.append(keyed.filter(asks).select("word", "key").mapInArrow(run, "word_key long, edit_key long"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "word_key long, edit_key long")


def near_pairs(keyed: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, n, near, near_n of all near words, both ways, each pair of words once."""
    # letters a-z and U+00C0 to U+00FF: 90 rows at most
    letters = keyed.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct().collect()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), np.uint32)
    met = candidates(keyed, alphabet, filter_bytes)
    a = keyed.select(F.col("key").alias("word_key"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = keyed.select(F.col("key").alias("edit_key"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    pairs = met.join(b, "edit_key").join(a, "word_key").filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()
    both = F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    ))
    return pairs.select(both.alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """word and root: from each word along its forms to the last.  A form is several
    times as frequent as its word, so chains are short; each round doubles the way."""
    spark = forms.sparkSession
    now = stage_table(spark, forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        new = stage_table(spark, moved, "roots")
        if new.filter("moved").isEmpty():
            return new.select("word", "root")
        now = new.select("word", "root")


def group_variants(words: DataFrame, min_count: int = 5, ratio: int = 5, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of ``words`` (a row an occurrence)
    with ``min_count`` occurrences.

    The form is the near word with the largest n (ties: the first by code points) if that
    is at least ``ratio`` times the word's n, else null; the root is the end of the chain
    of forms, the word itself where there is none."""
    spark = words.sparkSession
    keyed = stage_table(spark, with_keys(vocabulary_of(words, min_count)), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_pairs(keyed, filter_bytes).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    led = F.col("best.less") * -1 >= F.col("n") * ratio
    summed = stage_table(spark, keyed.select("word", "n").join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(led, F.col("best.near")).alias("form"), F.when(led, -F.col("best.less")).alias("form_n"),
    ), "forms")
    last = roots(summed.filter("form is not null"))
    return summed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
