"""Scoring texts by context-tree weighting over bytes.

A text is its UTF-8 bytes, ``0xFF`` (no byte of UTF-8) before it ``depth`` times and once
behind it as its end.  A byte is eight binary decisions; the context of a decision is the
bits before it in its byte (a prefix) and the last 0 to ``depth`` bytes.  Each node (bytes,
prefix) counts zeros and ones in all training texts and has the Krichevsky-Trofimov
estimate of them, Pe; its weighted probability is ``Pw = (Pe + product of Pw of the nodes
with one byte more) / 2``, and Pe alone at full depth.  A decision's probability mixes the
estimates of all depths with the shares ``Pe / (2 Pw)`` that training gave the nodes on
its path; a path ends at the last node that training has seen.  The score is the log10 of
the whole text's probability, the code length its bits a byte.

A probability depends on the last ``depth + 1`` bytes only, so everything is done once for
each distinct gram of that many bytes: one pass over all texts counts grams (and words,
for the unigram score beside it), tasks sum them, buckets of grams that share their last
three context bytes build their part of the tree, and the three shallow levels are joined
by Spark.  Tasks read the table of grams from the shared folder, in parts of about
``part_rows`` rows: where it is larger, texts are scored in several passes of which each
adds its grams, so what a task holds is bounded and no gram is left out.

Words of the unigram score go by 64-bit hashes.  A null text is an empty one; repeated
rows are scored each; a null id counts as the empty text for the fold.  Without training
rows every decision has probability one half.  Only the named columns are read.  An
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log, pi

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.llm.common import bound_batches, fresh_path, is_held_out, slices, stage_table
from triagelake.llm.variants import mixed

EDGE = b"\xff"
#: Context bytes that all grams of one bucket's subtree share.
SHARED = 3
#: Windows that a task holds at once, entries of its counts, rows of a bucket, and of a part of a table.
WINDOWS, ENTRIES, BUCKET_ROWS, PART_ROWS = 4 << 20, 1 << 21, 1 << 18, 2 << 20
GRAM, WORD = 0, 1
END_WORD = b""
SPACE = re.compile(rb"[\x20\x09-\x0D]")


# ---- windows and words of texts ----------------------------------------------

def joined(part: np.ndarray, n: int) -> np.ndarray:
    """Every ``n`` (5 to 7) bytes of ``part`` as one number, the first highest."""
    two = (part[:-1].astype(np.uint16) << 8) | part[1:]
    out = ((two[:-2].astype(np.uint32) << 16) | two[2:])[: len(part) - n + 1].astype(np.uint64)
    if n >= 6:
        out = (out << np.uint64(16)) | two[4 : 4 + len(out)]
    return out if n == 6 else (out << np.uint64(8)) | part[n - 1 :]


def windows(bodies: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, gram) of every byte and end of ``bodies``, at most WINDOWS at a time."""
    pad = EDGE * depth
    buffer = np.frombuffer(b"".join(x for body in bodies for x in (pad, body, EDGE)), np.uint8)
    sizes = np.array([len(b) + 1 for b in bodies], np.int64)
    owner = np.repeat(np.arange(len(bodies), dtype=np.int32), sizes)
    starts = np.cumsum(sizes + depth) - sizes - depth  # of the texts' first windows
    first = np.cumsum(sizes) - sizes
    for at in range(0, len(owner), WINDOWS):
        own = owner[at : at + WINDOWS]
        low, high = starts[own[0]] + at - first[own[0]], starts[own[-1]] + at + len(own) - first[own[-1]]
        part = buffer[low : high + depth]
        gram = joined(part, depth + 1)
        # windows that reach into the next text's edge go
        inside = np.ones(len(gram), bool)
        for next_text in range(own[0] + 1, own[-1] + 1):
            border = starts[next_text] - low
            inside[border - depth : border] = False
        yield own, gram[inside]


def word_lists(body: bytes, size: int = WINDOWS) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, of about ``size`` bytes at a time."""
    at = 0
    while at < len(body):
        cut = SPACE.search(body, at + size) if at + size < len(body) else None
        end = cut.start() if cut else len(body)
        yield body[at:end].lower().split()
        at = end


def bytes_of(part: pa.Array) -> list[bytes]:
    return [x or b"" for x in part.cast(pa.binary()).to_pylist()]


class Counts:
    """Sums by key, as sorted arrays."""

    def __init__(self):
        self.keys, self.sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, sums: np.ndarray) -> None:
        keys, sums = np.concatenate([self.keys, keys]), np.concatenate([self.sums, sums])
        order = np.argsort(keys, kind="stable")
        keys, sums = keys[order], sums[order]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
        self.keys, self.sums = keys[at], np.add.reduceat(sums, at) if len(at) else sums


def gather(df: DataFrame, depth: int) -> DataFrame:
    """kind, key, n of all grams and words: n counts training texts only, and is 0 for
    what only held-out texts have.  ``df``: held_out and text.  A task sums its own
    before the shuffle."""
    bound_batches(df.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words = Counts(), {True: Counter(), False: Counter()}
        waiting: dict[bool, list[np.ndarray]] = {True: [], False: []}

        def drain(kind: int, keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(sums)], names=["kind", "key", "n"])

        def count_waiting() -> None:
            for held, some in waiting.items():
                if some:
                    keys, sums = np.unique(np.concatenate(some), return_counts=True)
                    grams.add(keys, np.zeros(len(keys), np.int64) if held else sums)
                    some.clear()

        def drained_words() -> Iterator[pa.RecordBatch]:
            for held, counter in words.items():
                keys = np.fromiter(map(xxhash.xxh3_64_intdigest, counter), np.uint64, len(counter))
                sums = np.fromiter(counter.values(), np.int64, len(counter))
                yield drain(WORD, keys, np.zeros(len(sums), np.int64) if held else sums)
                counter.clear()

        for frame in frames:
            for part in slices(frame):
                held_out, bodies = part.column("held_out").to_pylist(), bytes_of(part.column("text"))
                for held in (True, False):
                    own = [b for b, h in zip(bodies, held_out) if h == held]
                    waiting[held] += [gram for _, gram in windows(own, depth)]
                    words[held][END_WORD] += len(own)
                    for body in own:
                        for some in word_lists(body):
                            words[held].update(some)
                if sum(map(len, [g for some in waiting.values() for g in some])) >= WINDOWS:
                    count_waiting()
                if len(grams.keys) > ENTRIES:
                    yield drain(GRAM, grams.keys, grams.sums)
                    grams = Counts()
                if sum(map(len, words.values())) > ENTRIES // 4:
                    yield from drained_words()
        count_waiting()
        yield drain(GRAM, grams.keys, grams.sums)
        yield from drained_words()

    rows = df.select("held_out", F.encode("text", "UTF-8").alias("text")).mapInArrow(run, "kind int, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


# ---- the tree ----------------------------------------------------------------

def ln_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, eight steps up."""
    rising = np.ones_like(x)
    for k in range(8):
        rising = rising * (x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * log(2 * pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(rising)


def ln_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return ln_gamma(zeros + 0.5) + ln_gamma(ones + 0.5) - log(pi) - ln_gamma(zeros + ones + 1)


def _ln_gamma(x: Column) -> Column:
    rising = x
    for k in range(1, 8):
        rising = rising * (x + k)
    y = x + 8
    return (y - 0.5) * F.log(y) - y + 0.5 * log(2 * pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - F.log(rising)


def _ln_kt(zeros: Column, ones: Column) -> Column:
    return _ln_gamma(zeros + 0.5) + _ln_gamma(ones + 0.5) - log(pi) - _ln_gamma(zeros + ones + 1.0)


class Subtree:
    """The nodes of depth SHARED to ``depth`` above some grams (whole subtrees of them)."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int):
        byte, context = grams & np.uint64(0xFF), grams >> np.uint64(8)
        step = np.arange(8, dtype=np.uint64)
        self.bit = ((byte[:, None] >> (np.uint64(7) - step)) & np.uint64(1)).astype(bool).ravel()
        prefix = (np.uint64(1) << step) | (byte[:, None] >> (np.uint64(8) - step))
        key, n = ((context[:, None] << np.uint64(8)) | prefix).ravel(), np.repeat(counts.astype(float), 8)
        self.keys, self.parent, self.zeros, self.ones, self.kids = {}, {}, {}, {}, {}
        zeros, ones, kids = n * ~self.bit, n * self.bit, None
        for d in range(depth, SHARED - 1, -1):
            key = key & np.uint64((1 << (8 * d + 8)) - 1)
            key, at = np.unique(key, return_inverse=True)
            self.keys[d], self.parent[d + 1] = key, at  # parent[d + 1]: places in depth d
            self.zeros[d] = zeros = np.bincount(at, zeros, len(key))
            self.ones[d] = ones = np.bincount(at, ones, len(key))
            own = ln_kt(zeros, ones)
            if kids is None:
                kids = own
            else:
                self.kids[d] = below = np.bincount(at, kids, len(key))
                kids = np.logaddexp(own, below) - log(2)
        self.ln_pw = kids

    def ln_probability(self, sure: np.ndarray, left: np.ndarray, p: np.ndarray, depth: int) -> np.ndarray:
        """ln P of each gram's last byte.  Given of the nodes of depth SHARED: the mix of
        the depths above (``sure``), what weight is left, and P(1) at the last seen node."""
        for d in range(SHARED, depth + 1):
            if d > SHARED:
                sure, left, p = (x[self.parent_of[d]] for x in (sure, left, p))
            zeros, ones = self.zeros[d], self.ones[d]
            estimate = (ones + 0.5) / (zeros + ones + 1)
            p = np.where(zeros + ones > 0, sure + left * estimate, p)
            if d < depth:
                share = 1 / (1 + np.exp(np.clip(self.kids[d] - ln_kt(zeros, ones), -700, 700)))
                sure, left = sure + left * share * estimate, left * (1 - share)
        p = p[self.parent[depth + 1]]
        return np.log(np.where(self.bit, p, 1 - p)).reshape(-1, 8).sum(axis=1)

    @property
    def parent_of(self) -> dict[int, np.ndarray]:
        """Places of the parents: of the nodes of depth d in those of depth d - 1."""
        return self.parent


def context_of(gram: Column) -> Column:
    """The last SHARED bytes before the gram's last one."""
    return F.shiftright(gram, 8).bitwiseAND((1 << (8 * SHARED)) - 1)


def _shallow(deep: DataFrame) -> DataFrame:
    """Of the nodes of depth SHARED: key, sure, left and p from the depths above.

    ``deep``: key, zeros, ones, ln_pw."""
    spark, levels = deep.sparkSession, {}
    now = deep
    for d in range(SHARED - 1, -1, -1):
        mask = (1 << (8 * d + 8)) - 1
        now = now.groupBy(F.col("key").bitwiseAND(mask).alias("key")).agg(
            F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("ln_pw").alias("kids"))
        own = _ln_kt(F.col("zeros"), F.col("ones"))
        top = F.greatest("own", "kids")
        now = now.withColumn("own", own).withColumn("ln_pw", top + F.log1p(F.exp(F.least("own", "kids") - top)) - log(2))
        now = levels[d] = stage_table(spark, now, f"depth-{d}")
    above = None
    for d in range(SHARED):
        nodes = levels[d].withColumn("up", F.col("key").bitwiseAND((1 << (8 * d)) - 1)) if d else levels[d]
        if above is None:
            nodes = nodes.withColumns({"sure": F.lit(0.0), "left": F.lit(1.0), "p": F.lit(0.5)})
        else:
            nodes = nodes.join(above.withColumnRenamed("key", "up"), "up")
        estimate = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
        share = 1.0 / (1.0 + F.exp(F.col("kids") - F.col("own")))
        above = nodes.select(
            "key", (F.col("sure") + F.col("left") * share * estimate).alias("sure"), (F.col("left") * (1.0 - share)).alias("left"),
            F.when(F.col("zeros") + F.col("ones") > 0, F.col("sure") + F.col("left") * estimate).otherwise(F.col("p")).alias("p"),
        )
    up = F.col("key").bitwiseAND((1 << (8 * SHARED)) - 1)
    return deep.select("key", up.alias("up")).join(above.withColumnRenamed("key", "up"), "up").select("key", "sure", "left", "p")


def gram_table(grams: DataFrame, depth: int) -> DataFrame:
    """key and ln_p, the last byte's ln P after the others, of each gram of ``grams`` (key, n)."""
    spark = grams.sparkSession
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-grams.count() // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("context"), F.lit(n_buckets)).alias("bucket")
    dealt = grams.withColumn("context", context_of(F.col("key"))).select(bucket, "key", "n")

    def subtree(table: pa.Table) -> tuple[np.ndarray, Subtree]:
        keys = table.column("key").to_numpy().view(np.uint64)
        return keys, Subtree(keys, table.column("n").to_numpy(), depth)

    def up(table: pa.Table) -> pa.Table:
        _, tree = subtree(table)
        columns = (tree.keys[SHARED].view(np.int64), tree.zeros[SHARED], tree.ones[SHARED], tree.ln_pw)
        return pa.table(dict(zip(("key", "zeros", "ones", "ln_pw"), columns)))

    def down(table: pa.Table, above: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"key": pa.array([], pa.int64()), "ln_p": pa.array([], pa.float64())})
        keys, tree = subtree(table)
        order = np.argsort(above.column("key").to_numpy())
        given = (above.column(c).to_numpy()[order] for c in ("sure", "left", "p"))
        return pa.table({"key": keys.view(np.int64), "ln_p": tree.ln_probability(*given, depth)})

    deep = stage_table(spark, dealt.groupBy("bucket").applyInArrow(up, "key long, zeros double, ones double, ln_pw double"), "deep")
    above = _shallow(deep).withColumn("context", F.shiftright("key", 8)).select(bucket, "key", "sure", "left", "p")
    return dealt.groupBy("bucket").cogroup(above.groupBy("bucket")).applyInArrow(down, "key long, ln_p double")


# ---- scores ------------------------------------------------------------------

class Lookup:
    """Values of 64-bit keys, in open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = np.append(keys, np.uint64(0)), np.append(values, 0)  # the last place: nothing
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, len(keys), np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._start(keys)
        while len(left):
            free = self.slots[at] == len(keys)
            self.slots[at[free]] = left[free]
            again = self.slots[at] != left
            left, at = left[again], (at[again] + 1) & self.mask

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The values, 0 for keys that are not there."""
        at = self._start(keys)
        found = self.slots[at]
        open_ = np.flatnonzero((self.keys[found] != keys) & (found < len(self.keys) - 1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found[open_] = self.slots[at[open_]]
            open_ = open_[(self.keys[found[open_]] != keys[open_]) & (found[open_] < len(self.keys) - 1)]
        return self.values[found]


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return mixed(keys) % np.uint64(parts)


def _dealt(table: DataFrame, value: str, parts: int) -> str:
    """Writes key and ``value`` into the shared folder, in ``parts`` parts by the key."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            part = _part_of(frame.column("key").to_numpy().view(np.uint64), parts).astype(np.int32)
            yield frame.append_column("part", pa.array(part))

    rows = table.select("key", value)
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType())])
    path = fresh_path(table.sparkSession, f"part-{value}")
    rows.mapInArrow(run, schema).write.partitionBy("part").parquet(path)
    return path


@lru_cache(maxsize=2)
def _part_table(path: str, value: str, part: int) -> Lookup:
    """One part of such a table, of about PART_ROWS rows; a worker's tasks share it."""
    fs, root = pafs.FileSystem.from_uri(path)
    selector = pafs.FileSelector(f"{root}/part={part}", allow_not_found=True)
    files = [f.path for f in fs.get_file_info(selector) if f.base_name.endswith(".parquet")]
    tables = [pq.read_table(f, filesystem=fs, columns=["key", value], partitioning=None) for f in files]
    keys = [t.column("key").to_numpy().view(np.uint64) for t in tables]
    values = [t.column(value).to_numpy() for t in tables]
    return Lookup(np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, float if value == "ln_p" else np.int64), *values]))


PARTIAL = "n_bytes long, n_tokens long, n_known long, base_ln double, ln_p double"


def _partial_scores(docs: DataFrame, keep: list[str], depth: int, grams: str, words: str, parts: tuple[int, int], part: tuple[int, int], n_train: int, n_distinct: int) -> DataFrame:
    """What one part of the tables adds to each text's sums."""
    kept = docs.select(*keep).schema
    below = n_train + 0.1 * (n_distinct + 1)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_ln = count = None
        for frame in frames:
            gram_ln = gram_ln or _part_table(grams, "ln_p", part[0])
            count = count or _part_table(words, "n", part[1])
            for rows in slices(frame):
                bodies = bytes_of(rows.column("text"))
                n_tokens, n_known, base, ln_p = (np.zeros(len(bodies), t) for t in (np.int64, np.int64, float, float))
                for own, gram in windows(bodies, depth):
                    values = gram_ln(gram)
                    if parts[0] > 1:
                        values[_part_of(gram, parts[0]) != part[0]] = 0
                    ln_p += np.bincount(own, values, len(bodies))
                known: dict[bytes, int] = {END_WORD: 0}
                tokens, owner = [], []

                def add_tokens() -> None:
                    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
                    c = count(keys)
                    mine = _part_of(keys, parts[1]) == part[1]
                    ln_c = np.where(mine, np.log((c + 0.1) / below), 0)
                    flat = np.concatenate(tokens)
                    who = np.repeat(np.array(owner), [len(t) for t in tokens])
                    base[:] += np.bincount(who, ln_c[flat], len(bodies))
                    n_known[:] += np.bincount(who, ((c > 0) & mine)[flat], len(bodies)).astype(np.int64)
                    n_tokens[:] += np.bincount(who, minlength=len(bodies))
                    tokens.clear()
                    owner.clear()

                for i, body in enumerate(bodies):
                    tokens.append(np.zeros(1, np.int64))
                    owner.append(i)
                    for some in word_lists(body):
                        tokens.append(np.fromiter((known.setdefault(w, len(known)) for w in some), np.int64, len(some)))
                        owner.append(i)
                        if len(known) > ENTRIES // 4:
                            add_tokens()
                            known = {END_WORD: 0}
                if bodies:
                    if not tokens:
                        tokens, owner = [np.zeros(0, np.int64)], [0]
                    add_tokens()
                made = (np.array([len(b) for b in bodies], np.int64), n_tokens, n_known, base, ln_p)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), *(pa.array(x, t) for x, t in zip(made, types))], names=[*keep, *(c.split()[0] for c in PARTIAL.split(", "))])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields)
    return docs.select(*keep, F.encode("text", "UTF-8").alias("text")).mapInArrow(run, f"{fields}, {PARTIAL}")


def score_documents(df: DataFrame, depth: int = 5, folds: int = 10, key: str = "doc_id", text: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and
    bits_per_byte of every row; fold 0 of the ids' CRC-32 is held out from training.

    ``base_score`` is a unigram model's log10 probability of the words and one end,
    smoothed by 0.1; ``score`` the tree's of the bytes and the end."""
    if not SHARED < depth <= 6:
        raise ValueError("depth is a number from 4 to 6: a node's key has 64 bits")
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("doc_id"), is_held_out(key, folds).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = stage_table(spark, gather(docs, depth), "counts")
    words = counts.filter((F.col("kind") == WORD) & (F.col("n") > 0)).select("key", "n")
    # one row each
    n_train, n_distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    grams = stage_table(spark, gram_table(counts.filter(F.col("kind") == GRAM).select("key", "n"), depth), "grams")
    parts = [max(1, -(-n // part_rows)) for n in (grams.count(), n_distinct)]
    keep, source = ["doc_id", "held_out"], docs
    if max(parts) > 1:  # sums of several passes meet by row
        source, keep = stage_table(spark, docs.withColumn("row", F.monotonically_increasing_id()), "rows"), [*keep, "row"]
    gram_path, word_path = _dealt(grams, "ln_p", parts[0]), _dealt(words, "n", parts[1])
    out = None
    for k in range(max(parts)):
        part = (k if k < parts[0] else -1, k if k < parts[1] else -1)
        some = _partial_scores(source, keep, depth, gram_path, word_path, tuple(parts), part, n_train, n_distinct)
        out = some if out is None else out.unionByName(some)
    if max(parts) > 1:
        out = out.groupBy(*keep).agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"), *(F.sum(c).alias(c) for c in ("n_known", "base_ln", "ln_p")))
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base_ln") / log(10)).alias("base_score"), (F.col("ln_p") / log(10)).alias("score"),
        "n_bytes", (-F.col("ln_p") / log(2) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
