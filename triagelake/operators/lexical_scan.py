"""BM25 of texts that are searched once: two passes over the texts, and no index.

The first pass counts in how many texts each asked term stands; a task shuffles its sums
alone.  The second scores every text for every query, and a task shuffles its k best of each
query.  No text, posting or pair is shuffled or written, so both grow with the number of
tasks.  ``lexical_index`` is for texts that are searched again and again; the results agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.operators.lexical_index import inverse_frequency
from triagelake.sources.staging import read_rows, shared_path, staged

#: Keys below this are numbered by a table of them all.
DENSE = 1 << 24
#: Of the texts scored at once: their bytes, and cells of (term, text).
SLICE_BYTES, CELLS = 1 << 17, 1 << 20
#: Places compared at once.
PLACES = 1 << 21
#: No code point: stands between texts.
BETWEEN = np.array([0x1FFFFF], np.uint32)
TEXTS = "parts array<struct<field: string, content: string>>"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Numbers:
    """Known keys numbered from 1; of any other key the number is 0."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.size = len(self.keys) + 1
        self.table = None
        top = int(self.keys[-1]) if len(self.keys) else 0
        if top < DENSE:
            self.table = np.zeros(top + 2, np.int32)
            self.table[self.keys] = np.arange(1, self.size)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table.take(keys, mode="clip")
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at + 1, 0).astype(np.int32)


class Terms:
    """Distinct terms of three characters or more; a term is a chain of trigrams that cover it."""

    def __init__(self, terms: list[str]):
        codes = [code_points(t).astype(np.int64) for t in terms]
        chains = [np.array([*range(0, len(c) - 3, 3), len(c) - 3]) for c in codes]
        self.n, self.longest = len(terms), max(map(len, codes), default=0)
        self.length = np.array([len(c) for c in chains], np.int32)
        self.first = np.cumsum(self.length, dtype=np.int32) - self.length
        self.offset = np.concatenate([np.zeros(0, np.int32), *chains]).astype(np.int32)
        a, b, c = (np.concatenate([np.zeros(0, np.int64), *(x[at + i] for x, at in zip(codes, chains))]) for i in range(3))
        self.marks = Numbers(np.concatenate([a, b, c]))
        a, b, c = self.marks(a), self.marks(b), self.marks(c)
        self.pairs = Numbers(self.key(a, b))
        pair = self.pairs(self.key(a, b))
        self.grams = Numbers(self.key(pair, c))
        self.gram = self.grams(self.key(pair, c))
        self.alone, self.chained = np.flatnonzero(self.length == 1), np.flatnonzero(self.length > 1).astype(np.int32)
        # the trigrams of the chained terms, and whose they are
        self.link_of = np.repeat(np.arange(len(self.chained)), self.length[self.chained])
        self.link = np.flatnonzero(np.repeat(self.length, self.length) > 1)
        self.link_first = np.flatnonzero(np.diff(self.link_of, prepend=-1))

    def key(self, before: np.ndarray, mark: np.ndarray) -> np.ndarray:
        wide = before.astype(np.int64) if int(before.max(initial=0) + 1) * self.marks.size >= 1 << 31 else before
        return wide * self.marks.size + mark

    def numbered(self, codes: np.ndarray) -> np.ndarray:
        """The asked trigram at each place, or 0."""
        mark = self.marks(codes)
        pair = self.pairs(self.key(mark[:-1], mark[1:]))
        return self.grams(self.key(pair[:-1], mark[2:]))

    def counts(self, codes: list[np.ndarray], whose: np.ndarray, n_texts: int) -> np.ndarray:
        """How often each term (a row) stands in each text (a column), overlaps included;
        ``codes``: pieces, ``whose``: the text of each."""
        out = np.zeros((self.n, n_texts), np.int64)
        if not codes or not self.n:
            return out
        joined = np.concatenate([x for c in codes for x in (c, BETWEEN)])
        if len(joined) < 3:
            return out
        text = np.repeat(whose.astype(np.int32), [len(c) + 1 for c in codes])
        gram = self.numbered(joined)
        at = np.flatnonzero(gram).astype(np.int32)
        seen = gram[at]
        cells = np.bincount(seen * n_texts + text[at], minlength=self.grams.size * n_texts).reshape(self.grams.size, n_texts)
        out[self.alone] = cells[self.gram[self.first[self.alone]]]
        if not len(self.chained):
            return out
        # the rarest trigram of each chain says where the term may stand
        total = cells.sum(axis=1)
        often = total[self.gram[self.link]]
        least = np.minimum.reduceat(often, self.link_first)
        rare = np.flatnonzero(often == least[self.link_of])
        rare = self.link[rare[np.r_[True, np.diff(self.link_of[rare]) > 0]]]
        term, rare, least = (x[least > 0] for x in (self.chained, rare, least))
        asked = np.zeros(self.grams.size, bool)
        asked[self.gram[rare]] = True
        mine = np.flatnonzero(asked[seen])
        seen, at = seen[mine], at[mine]
        at = at[np.argsort(seen.astype(np.uint16) if self.grams.size < 1 << 16 else seen, kind="stable")]
        total[~asked] = 0
        start = np.cumsum(total) - total
        gram = np.concatenate([np.zeros(self.longest, np.int32), gram, np.zeros(self.longest + 2, np.int32)])
        group = (np.cumsum(least) - least) // PLACES
        borders = np.r_[np.flatnonzero(np.diff(group, prepend=-1)), len(group)]
        flat, following = out.reshape(-1), np.zeros(self.n, np.int32)
        for lo, hi in zip(borders[:-1], borders[1:]):
            n, r = least[lo:hi], rare[lo:hi]
            mine = np.repeat(term[lo:hi], n)
            place = at[np.repeat(start[self.gram[r]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            place -= np.repeat(self.offset[r] - np.int32(self.longest), n)
            # the others of the chain, from the rarest one on and around
            following[term[lo:hi]] = r - self.first[term[lo:hi]] + 1
            step = 1
            while len(mine):
                which = following[mine] + np.int32(step - 1)
                length = self.length[mine]
                which -= np.where(which >= length, length, np.int32(0))
                which += self.first[mine]
                same = np.flatnonzero(gram[place + self.offset[which]] == self.gram[which])
                mine, place, length, step = mine[same], place[same], length[same], step + 1
                last = length == step
                where, times = np.unique(mine[last].astype(np.int64) * n_texts + text[place[last] - self.longest], return_counts=True)
                flat[where] = times
                mine, place = mine[~last], place[~last]
        return out


def slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Parts of about SLICE_BYTES of texts and ``most`` rows."""
    for batch in batches:
        parts = batch.column("parts")
        size = pc.fill_null(pc.binary_length(parts.values.field("content")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.r_[0, np.cumsum(size)][parts.offsets.to_numpy()]
        lo = 0
        while lo < len(batch):
            hi = int(np.searchsorted(upto, upto[lo] + SLICE_BYTES, side="left"))
            hi = min(max(hi, lo + 1), lo + most, len(batch))
            yield batch.slice(lo, hi - lo)
            lo = hi


def sizes_and_counts(part: pa.RecordBatch, terms: Terms) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Number of tokens of each text, and the counts of the terms by field."""
    texts, fields = part.column("parts").flatten(), {}
    whose = np.repeat(np.arange(len(part)), pc.list_value_length(part.column("parts")).to_numpy(zero_copy_only=False))
    codes = [code_points(x) for x in texts.field("content").to_pylist()]
    size = np.bincount(whose, [max(0, len(c) - 2) for c in codes], minlength=len(part)).astype(np.int64)
    for i, f in enumerate(texts.field("field").to_pylist()):
        if len(codes[i]) > 2:
            fields.setdefault(f, []).append(i)
    return size, {f: terms.counts([codes[i] for i in rows], whose[rows], len(part)) for f, rows in fields.items()}


def rows_of(terms: Terms) -> int:
    return max(1, CELLS // max(terms.n, terms.grams.size))


def count_terms(path: str):
    """term and df (texts with it); without a term: number of texts and of their tokens."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pc.unique(read_rows(path, ["term"]).column("term"))
        terms = Terms(names.to_pylist())
        df, n, tokens = np.zeros(terms.n, np.int64), 0, 0
        for part in slices(batches, rows_of(terms)):
            size, fields = sizes_and_counts(part, terms)
            n, tokens = n + len(part), tokens + int(size.sum())
            if fields:
                df += np.count_nonzero(sum(fields.values()), axis=1)
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*names.take(pa.array(there)).to_pylist(), None], pa.string()), pa.array(np.r_[df[there], n]), pa.array(np.r_[np.zeros(len(there), np.int64), tokens])], names=["term", "df", "tokens"])

    return count


def best_of_task(path: str, k: int, k1: float, b: float, weights: dict[str, float], kind: pa.DataType):
    """The k best of each query among a task's texts."""
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = read_rows(path, ["query_id", "term", "idf", "avgdl"])
        if not len(asked):
            return
        encoded = asked.column("term").combine_chunks().dictionary_encode()
        which = encoded.indices.to_numpy()
        terms = Terms(encoded.dictionary.to_pylist())
        idf = np.zeros(terms.n)
        idf[which] = asked.column("idf").to_numpy()
        mean = asked.column("avgdl")[0].as_py()
        ids, query = np.unique(asked.column("query_id").to_numpy(), return_inverse=True)
        mine = np.split(which[np.lexsort((which, query))], np.cumsum(np.bincount(query))[:-1])
        best: list[list[tuple]] = [[] for _ in ids]
        edge = np.full(len(ids), -1.0)
        for part in slices(batches, rows_of(terms)):
            size, fields = sizes_and_counts(part, terms)
            if not fields:
                continue
            cids = part.column("cid").to_pylist()
            order = np.argsort(np.argsort(np.array(cids), kind="stable"))
            norm = k1 * (1 - b + b * size / mean)
            tf = sum(fields.values()).astype(np.float64)
            heavy = sum(c * weights.get(f, 0.0) for f, c in fields.items()) if weights else tf
            share = idf[:, None] * tf * (k1 + 1) / (tf + norm)
            sums = np.stack([np.add.reduce(share.take(these, axis=0), axis=0) for these in mine])
            values = np.round(sums, 6)
            good = (sums > 0) & (values >= edge[:, None])
            for q in np.flatnonzero(good.any(axis=1)):
                at, these, value = np.flatnonzero(good[q]), mine[q], values[q]
                at = at[np.lexsort((order[at], -value[at]))[:k]]
                score = value[at]
                if weights:
                    x = heavy[np.ix_(these, at)]
                    score = np.round((idf[these, None] * x * (k1 + 1) / (x + norm[at])).sum(axis=0), 6)
                found = best[q] + [(-v, cids[i], s) for v, i, s in zip(value[at].tolist(), at.tolist(), score.tolist())]
                best[q] = sorted(found)[:k]
                if len(best[q]) == k:
                    edge[q] = -best[q][-1][0]
        rows = [(i, c, -v, s) for i, found in zip(ids.tolist(), best) for v, c, s in found]
        if rows:
            kinds = {"query_id": pa.int64(), "cid": kind, "plain": pa.float64(), "score": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))

    return rank


def spread(texts: DataFrame) -> DataFrame:
    """Texts that lie in few large parts (a file of one row group) are dealt by their ids."""
    n, most = texts.groupBy(F.spark_partition_id().alias("p")).count().agg(F.sum("count"), F.max("count")).first()
    cores = texts.sparkSession.sparkContext.defaultParallelism
    if not n or most <= max(1024, 2 * n // cores):
        return texts
    parts = max(cores, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return texts.repartition(min(parts, -(-n // 256)), "cid")


def whole_texts(corpus: DataFrame, fields: dict[str, str]) -> DataFrame:
    """cid and TEXTS, one row an id: rows of one id are one text.  Rows without an id go."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.coalesce(F.col(c), F.lit(""))).alias("content")) for f, c in fields.items()])
    there = spread(corpus.filter("cid is not null"))
    rows = there.select("cid", parts.alias("parts"))
    many = staged(there.groupBy("cid").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("cid").alias("_cid")), "repeated")
    if many.isEmpty():
        return rows
    same = F.col("cid") == F.col("_cid")
    joined = rows.join(many, same, "left_semi").groupBy("cid").agg(F.flatten(F.collect_list("parts")).alias("parts"))
    return rows.join(many, same, "left_anti").unionByName(joined)


def scan(
    corpus: DataFrame, fields: dict[str, str], query_terms: DataFrame, k: int, weights: dict[str, float] | None = None,
    k1: float = 1.2, b: float = 0.75, query_group: int = 1000,
) -> DataFrame:
    """As ``lexical_index.search``, from the texts: ``corpus`` has cid (number or text) and the columns of
    ``fields`` (field: column).  More than ``query_group`` queries are taken in turn."""
    spark = corpus.sparkSession
    texts = whole_texts(corpus, fields)
    queries = query_terms.select(F.col("query_id").cast("long").alias("query_id"), "term").filter(F.length("term") >= 3).distinct()
    groups = max(1, -(-queries.select("query_id").distinct().count() // query_group))
    dealt = F.pmod(F.xxhash64("query_id"), F.lit(groups))
    kind = corpus.schema["cid"].dataType
    arrow = pa.string() if isinstance(kind, T.StringType) else pa.int64() if isinstance(kind, T.LongType) else pa.int32()
    found = []
    for g in range(groups):
        path, asked_path = shared_path(spark, "terms"), shared_path(spark, "asked")
        queries.filter(dealt == g).write.parquet(path)
        terms = spark.read.schema(queries.schema).parquet(path)
        counted = texts.select("parts").mapInArrow(count_terms(path), "term string, df long, tokens long")
        sums = staged(counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens")), "frequencies")
        stats = sums.filter("term is null and df > 0").select(F.col("df").alias("n_docs"), (F.col("tokens") / F.col("df")).alias("avgdl"))
        asked = terms.join(sums.filter("term is not null").select("term", "df"), "term").crossJoin(F.broadcast(stats)).select(
            "query_id", "term", inverse_frequency(F.col("n_docs"), F.col("df")).alias("idf"), "avgdl")
        asked.write.parquet(asked_path)
        found.append(texts.mapInArrow(best_of_task(asked_path, k, k1, b, weights or {}, arrow), T.StructType().add("query_id", "long").add("cid", kind).add("plain", "double").add("score", "double")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    w = Window.partitionBy("query_id").orderBy(F.desc("plain"), "cid")
    return every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "cid", "plain", "score", "rank")
