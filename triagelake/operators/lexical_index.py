"""A stored lexical index: postings of trigrams with their places, and BM25 from it.

Texts are dealt to blocks of about ``block_docs`` by a hash of their ids.  A row of the
postings is one trigram in one block (and field): the block's texts that have it (gaps of
their places in the block), how often, and where (gaps within a text), with the largest
count and the least text size, from which the block's best score for a query is bounded.

A search reads the rows of the queries' trigrams alone, never a text.  Terms longer than
three characters stand where their trigrams do, one behind the other; their hits are
made once for each group of queries and block.  Of each query the block with the best
bound is scored first; its k-th score is a threshold, and blocks that cannot reach it are
left out.  The results are those of scoring everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.operators.chunking import slices
from triagelake.operators.retrieval import postings
from triagelake.sources.staging import staged

POSTINGS = "block int, field string, gram long, n int, max_tf int, min_dl long, docs array<int>, tfs array<int>, places array<int>"
HITS = "query_group int, block int, term string, n int, max_tf double, min_dl long, docs array<int>, tfs array<double>, heavy array<double>"


@dataclass
class LexicalIndex:
    """``postings`` (POSTINGS), ``sizes`` (block, cids, dls) and ``n_blocks``."""

    postings: DataFrame
    sizes: DataFrame
    n_blocks: int

    def write(self, path: str) -> None:
        self.postings.write.partitionBy("block").option("compression", "zstd").parquet(f"{path}/postings")
        self.sizes.write.parquet(f"{path}/sizes")

    @staticmethod
    def read(spark: SparkSession, path: str) -> LexicalIndex:
        sizes = spark.read.parquet(f"{path}/sizes")
        n = sizes.agg(F.max("n_blocks")).first()[0]
        return LexicalIndex(spark.read.schema(T._parse_datatype_string(POSTINGS)).parquet(f"{path}/postings"), sizes, n or 1)

    def staged(self) -> LexicalIndex:
        return LexicalIndex(staged(self.postings, "postings"), staged(self.sizes, "sizes"), self.n_blocks)

    def stats(self) -> DataFrame:
        """One row: number of texts and their mean size."""
        each = F.explode("dls").alias("dl")
        return self.sizes.select(each).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


# ---- building ----------------------------------------------------------------

def grams_of(codes: np.ndarray) -> np.ndarray:
    """Every three code points as one number of 63 bits."""
    c = codes.astype(np.int64)
    return (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]


def gram_key(text: str) -> int:
    a, b, c = map(ord, text)
    return a << 42 | b << 21 | c


def _invert(table: pa.Table) -> pa.Table:
    """The postings of one block; rows: block, cid, field, content in lower case."""
    block = table.column("block")[0].as_py()
    _, doc = np.unique(np.array(table.column("cid").to_pylist()), return_inverse=True)
    codes = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in table.column("content").to_pylist()]
    size = np.bincount(doc, [max(0, len(c) - 2) for c in codes]).astype(np.int64)
    out = []
    fields = table.column("field").to_pylist()
    for field in sorted(set(fields)):
        rows = sorted((i for i, f in enumerate(fields) if f == field and len(codes[i]) > 2), key=lambda i: doc[i])
        if not rows:
            continue
        gram = np.concatenate([grams_of(codes[i]) for i in rows])
        whose = np.concatenate([np.full(len(codes[i]) - 2, doc[i], np.int32) for i in rows])
        place = np.concatenate([np.arange(len(codes[i]) - 2, dtype=np.int32) for i in rows])
        order = np.argsort(gram, kind="stable")
        gram, whose, place = gram[order], whose[order], place[order]
        new_gram = np.r_[True, gram[1:] != gram[:-1]]
        new_doc = new_gram | np.r_[True, whose[1:] != whose[:-1]]
        at_doc = np.flatnonzero(new_doc)
        tfs = np.diff(np.r_[at_doc, len(gram)]).astype(np.int32)
        gaps = np.diff(place, prepend=np.int32(0))
        gaps[at_doc] = place[at_doc]
        first = np.flatnonzero(new_gram[at_doc])  # of each gram, in the pairs (gram, text)
        docs = whose[at_doc]
        doc_gaps = np.diff(docs, prepend=np.int32(0))
        doc_gaps[first] = docs[first]
        ends = np.r_[first, len(at_doc)].astype(np.int32)
        place_ends = np.r_[at_doc[first], len(gram)].astype(np.int32)
        out.append(pa.table({
            "block": np.full(len(first), block, np.int32), "field": pa.array([field] * len(first)), "gram": gram[at_doc[first]],
            "n": np.diff(ends), "max_tf": np.maximum.reduceat(tfs, first), "min_dl": np.minimum.reduceat(size[docs], first),
            "docs": pa.ListArray.from_arrays(ends, doc_gaps.astype(np.int32)), "tfs": pa.ListArray.from_arrays(ends, tfs),
            "places": pa.ListArray.from_arrays(place_ends, gaps.astype(np.int32)),
        }))
    return pa.concat_tables(out) if out else _empty(POSTINGS)


def _empty(schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in kinds.items()}
    return pa.table({n: pa.array([], kinds[k]) for n, k in (f.split() for f in schema.split(", "))})


def build_index(corpus: DataFrame, text: str = "content", field: str | None = None, block_docs: int = 1024) -> LexicalIndex:
    """corpus: cid (number or text) and ``text``; with ``field``, a row for each field of a
    text.  Null texts are empty ones, rows without an id have no place in the index."""
    there = corpus.filter("cid is not null")
    n_blocks = max(1, -(-there.count() // block_docs))
    rows = there.select(
        F.pmod(F.xxhash64("cid"), F.lit(n_blocks)).cast("int").alias("block"), "cid",
        (F.coalesce(F.col(field).cast("string"), F.lit("")) if field else F.lit("")).alias("field"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("content"),
    )
    dl = F.greatest(F.length("content") - 2, F.lit(0)).cast("long")
    each = rows.groupBy("block", "cid").agg(F.sum(dl).alias("dl"))
    pairs = each.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("cid", "dl"))).alias("p"))  # about block_docs pairs
    sizes = pairs.select("block", F.col("p.cid").alias("cids"), F.col("p.dl").alias("dls"), F.lit(n_blocks).alias("n_blocks"))
    return LexicalIndex(rows.groupBy("block").applyInArrow(_invert, POSTINGS), sizes, n_blocks)


def term_totals(corpus: DataFrame, text: str = "content") -> DataFrame:
    """corpus: cid and ``text``.  term, df (ids with it) and n (places) of every trigram, as from
    ``retrieval.postings``, but a task counts within its texts and shuffles sums alone.  Ids that
    stand in several rows are counted by their postings."""
    rows = corpus.select("cid", F.lower(F.coalesce(F.col(text), F.lit(""))).alias("content"))
    many = staged(rows.groupBy("cid").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("cid").alias("_cid")), "repeated")
    same = F.col("cid").eqNullSafe(F.col("_cid"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for whole in batches for p in slices(whole, "content")):
            codes = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in part.column("content").to_pylist()]
            codes = [c for c in codes if len(c) > 2]
            if not codes:
                continue
            gram, at, n = np.unique(np.concatenate([grams_of(c) for c in codes]), return_inverse=True, return_counts=True)
            whose = np.repeat(np.arange(len(codes)), [len(c) - 2 for c in codes])
            pairs = np.sort(at.reshape(-1) * len(codes) + whose)
            pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.bincount(pairs // len(codes), minlength=len(gram))), pa.array(n)], names=["gram", "df", "n"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column("gram").to_numpy()
            marks = np.stack([g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            yield pa.RecordBatch.from_arrays([pa.array([marks[i : i + 3] for i in range(0, len(marks), 3)], pa.string()), batch.column("df"), batch.column("n")], names=["term", "df", "n"])

    once = rows.join(many, same, "left_anti").select("content").mapInArrow(count, "gram long, df long, n long")
    summed = once.groupBy("gram").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).mapInArrow(spell, "term string, df long, n long")
    tf, _ = postings(rows.join(many, same, "left_semi"))
    both = summed.unionByName(tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n")))
    return both.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


# ---- searching ---------------------------------------------------------------

def _lists(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    flat = table.column(column).combine_chunks()
    return flat.offsets.to_numpy(), flat.values.to_numpy()


class BlockPostings:
    """The rows of one block that were read, by field and trigram."""

    def __init__(self, table: pa.Table):
        self.docs, self.tfs, self.places = (_lists(table, c) for c in ("docs", "tfs", "places"))
        self.min_dl = table.column("min_dl").to_numpy()
        self.rows: dict[str, dict[int, int]] = {}
        self.known: dict[int, np.ndarray] = {}
        for i, (field, gram) in enumerate(zip(table.column("field").to_pylist(), table.column("gram").to_pylist())):
            self.rows.setdefault(field, {})[gram] = i

    def counts(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        (ends, docs), (_, tfs) = self.docs, self.tfs
        span = slice(ends[row], ends[row + 1])
        return np.cumsum(docs[span]), tfs[span]

    def spots(self, row: int, offset: int) -> np.ndarray:
        """text * 2**32 + place, less the trigram's offset in a term (2**31 keeps it positive)."""
        if row not in self.known:
            docs, tfs = self.counts(row)
            ends, gaps = self.places
            gaps = gaps[ends[row] : ends[row + 1]]
            run = np.cumsum(gaps, dtype=np.int64)
            start = np.cumsum(tfs) - tfs
            self.known[row] = np.repeat((docs.astype(np.int64) << 32) - run[start] + gaps[start] + (1 << 31), tfs) + run
        return self.known[row] - offset

    def hits(self, term: str, field: str) -> tuple[np.ndarray, np.ndarray, int] | None:
        """Texts of the block with the term, how often, and a bound of their least size."""
        known, last = self.rows[field], len(term) - 3
        offsets = [*range(0, last, 3), last]  # all characters of the term
        rows = [(known.get(gram_key(term[o : o + 3])), o) for o in offsets]
        if any(r is None for r, _ in rows):
            return None
        least = max(int(self.min_dl[r]) for r, _ in rows)
        if len(rows) == 1:
            return *self.counts(rows[0][0]), least
        ends = self.places[0]
        rows.sort(key=lambda x: ends[x[0] + 1] - ends[x[0]])
        spots = self.spots(*rows[0])
        for row in rows[1:]:
            spots = np.intersect1d(spots, self.spots(*row), assume_unique=True)
        if not len(spots):
            return None
        docs, tfs = np.unique(spots >> 32, return_counts=True)
        return docs, tfs, least


def _find(weights: dict[str, float]):
    """Hits of the terms of a query group in a block, all fields together."""
    def find(key: tuple, postings: pa.Table, terms: pa.Table) -> pa.Table:
        if not len(postings) or not len(terms):
            return _empty(HITS)
        block, out = BlockPostings(postings), []
        for term in sorted(set(terms.column("term").to_pylist())):
            found = [(f, h) for f in block.rows if (h := block.hits(term, f)) is not None]
            if not found:
                continue
            docs, at = np.unique(np.concatenate([h[0] for _, h in found]), return_inverse=True)
            tfs = np.bincount(at, np.concatenate([h[1] for _, h in found]))
            heavy = np.bincount(at, np.concatenate([h[1] * weights.get(f, 1.0 if not weights else 0.0) for f, h in found]))
            out.append((term, len(docs), float(tfs.max()), min(h[2] for _, h in found), docs.astype(np.int32), tfs, heavy))
        if not out:
            return _empty(HITS)
        columns = dict(zip(["term", "n", "max_tf", "min_dl", "docs", "tfs", "heavy"], zip(*out)))
        ends = np.r_[0, np.cumsum(columns["n"])].astype(np.int32)
        return pa.table({
            "query_group": np.full(len(out), key[0].as_py(), np.int32), "block": np.full(len(out), key[1].as_py(), np.int32), "term": pa.array(columns["term"]),
            "n": pa.array(columns["n"], pa.int32()), "max_tf": pa.array(columns["max_tf"]), "min_dl": pa.array(columns["min_dl"], pa.int64()),
            **{c: pa.ListArray.from_arrays(ends, np.concatenate(columns[c])) for c in ("docs", "tfs", "heavy")},
        })

    return find


def term_hits(index: LexicalIndex, terms: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """HITS of ``terms`` (query_group, term in lower case).  The rows of a trigram are read
    once for each query group that asks for it."""
    known = terms.filter(F.length("term") >= 3).distinct()
    offsets = F.sequence(F.lit(1), F.length("term") - 2)
    grams = known.select("query_group", F.explode(F.transform(offsets, lambda i: F.substr("term", i, F.lit(3)))).alias("g")).distinct()
    code = [F.expr(f"cast(conv(hex(encode(substr(g, {i}, 1), 'UTF-32')), 16, 10) as bigint)") for i in (1, 2, 3)]
    wanted = grams.select("query_group", (code[0] * (1 << 42) + code[1] * (1 << 21) + code[2]).alias("gram"))
    read = index.postings.join(wanted, "gram").select("query_group", *index.postings.columns)
    # under columns of its own: both sides come from the terms
    spread = known.select(F.col("query_group").alias("query_group"), F.col("term").alias("term"), F.explode(F.sequence(F.lit(0), F.lit(index.n_blocks - 1))).alias("block"))
    return read.groupBy("query_group", "block").cogroup(spread.groupBy("query_group", "block")).applyInArrow(_find(weights or {}), HITS)


def _rank(k: int, k1: float, b: float, kind: pa.DataType):
    """Best k of each query in a block; ``hits`` holds one row with the block's texts."""
    def rank(key: tuple, hits: pa.Table, asked: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "block": pa.array([], pa.int32()), "cid": pa.array([], kind), "plain": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        if len(hits) < 2 or not len(asked):
            return none
        terms = hits.column("term").to_pylist()
        here = terms.index(None)
        cids = hits.column("cids").combine_chunks()[here].values
        dls = hits.column("dls").combine_chunks()[here].values.to_numpy()
        norm = k1 * (1 - b + b * dls / asked.column("avgdl")[0].as_py())
        lists = {c: _lists(hits, c) for c in ("docs", "tfs", "heavy")}
        row_of, parts, out = {t: i for i, t in enumerate(terms)}, {}, []
        queries: dict[int, list[str]] = {}
        idf: dict[str, float] = {}
        for q, t, w in zip(*(asked.column(c).to_pylist() for c in ("query_id", "term", "idf"))):
            queries.setdefault(q, []).append(t)
            idf[t] = w
        for q, mine in queries.items():
            plain, score, met = np.zeros(len(dls)), np.zeros(len(dls)), np.zeros(len(dls), bool)
            for t in mine:
                if t not in row_of:
                    continue
                if t not in parts:
                    span = slice(lists["docs"][0][row_of[t]], lists["docs"][0][row_of[t] + 1])
                    docs = lists["docs"][1][span]
                    a, h = (lists[c][1][span] for c in ("tfs", "heavy"))
                    parts[t] = docs, *(idf[t] * x * (k1 + 1) / (x + norm[docs]) for x in (a, h))
                docs, a, h = parts[t]
                plain[docs] += a
                score[docs] += h
                met[docs] = True
            at = np.flatnonzero(met)
            value = np.round(plain[at], 6)
            if len(at) > k:
                edge = -np.partition(-value, k - 1)[k - 1]
                at, value = at[value >= edge], value[value >= edge]
            best = np.lexsort((at, -value))[:k]  # a block's texts are in the order of their ids
            out.append((np.full(len(best), q, np.int64), at[best], value[best], np.round(score[at[best]], 6)))
        if not out:
            return none
        q, at, value, score = (np.concatenate(x) for x in zip(*out))
        return pa.table({"query_id": q, "block": np.full(len(q), key[1].as_py(), np.int32), "cid": cids.take(pa.array(at)), "plain": value, "score": score})

    return rank


def inverse_frequency(n: Column, df: Column) -> Column:
    """ln((n - df + 0.5) / (df + 0.5)); 1e-6 where that is not positive."""
    idf = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)


def plan_blocks(hits: DataFrame, asked: DataFrame, k1: float, b: float) -> DataFrame:
    """query_id, query_group, block and ``bound``: no text of the block scores more.
    ``asked``: query_id, query_group, term, idf, avgdl."""
    tf, norm = F.col("max_tf"), k1 * (1 - b + b * F.col("min_dl") / F.col("avgdl"))
    part = F.col("idf") * tf * (k1 + 1) / (tf + norm)
    return asked.join(hits.select("query_group", "block", "term", "max_tf", "min_dl"), ["query_group", "term"]).groupBy("query_id", "query_group", "block").agg((F.sum(part) + 1e-5).alias("bound"))


def search(
    index: LexicalIndex, query_terms: DataFrame, k: int, weights: dict[str, float] | None = None, k1: float = 1.2, b: float = 0.75,
    query_group: int = 500, skipped: list[int] | None = None,
) -> DataFrame:
    """query_terms: query_id (a number) and term, in lower case and distinct.  query_id, cid, plain,
    score and rank of the k best by ``plain`` (all fields alike; ties to the smaller id);
    ``score`` counts hits by the ``weights`` of their fields, and is ``plain`` without
    them.  ``skipped`` receives the number of (query, block) pairs with hits, and of those scored."""
    groups = max(1, -(-query_terms.select("query_id").distinct().count() // query_group))
    dealt = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")
    terms = staged(query_terms.select("query_id", "term", dealt.alias("query_group")), "terms")
    # with a row without a term for the texts of each block
    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("query_group")
    texts = index.sizes.select(each, "block", "cids", "dls")
    found = staged(term_hits(index, terms.select("query_group", "term"), weights).unionByName(texts, allowMissingColumns=True), "hits")
    hits = found.filter("term is not null")
    frequency = hits.groupBy("query_group", "term").agg(F.sum("n").alias("df"))
    stats = index.stats()  # one row
    asked = staged(terms.join(frequency, ["query_group", "term"]).crossJoin(F.broadcast(stats)).select(
        "query_id", "query_group", "term", inverse_frequency(F.col("n_docs"), F.col("df")).alias("idf"), "avgdl"), "asked")
    bounds = staged(plan_blocks(hits, asked, k1, b), "bounds")
    kind = index.sizes.schema["cids"].dataType.elementType
    schema = f"query_id long, block int, cid {kind.simpleString()}, plain double, score double"
    arrow = pa.string() if isinstance(kind, T.StringType) else pa.int64() if isinstance(kind, T.LongType) else pa.int32()

    def scored(picked: DataFrame) -> DataFrame:
        blocks = picked.select("query_group", "block").distinct()
        both = found.join(blocks, ["query_group", "block"], "left_semi").select("query_group", "block", "term", "docs", "tfs", "heavy", "cids", "dls")
        mine = asked.join(picked.select("query_id", "block"), "query_id").select(*[F.col(c).alias(c) for c in ("query_id", "query_group", "block", "term", "idf", "avgdl")])
        return both.groupBy("query_group", "block").cogroup(mine.groupBy("query_group", "block")).applyInArrow(_rank(k, k1, b, arrow), schema)

    first = bounds.groupBy("query_id", "query_group").agg(F.max_by("block", "bound").alias("block"))
    head = staged(scored(first), "head")
    edge = head.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("plain")).alias("edge"))
    rest = bounds.join(first.select("query_id", F.col("block").alias("_first")), "query_id").filter("block <> _first").join(edge, "query_id", "left")
    rest = rest.filter(F.col("edge").isNull() | (F.col("bound") >= F.col("edge")))
    if skipped is not None:
        skipped += [bounds.count(), first.count() + rest.count()]
    w = Window.partitionBy("query_id").orderBy(F.desc("plain"), "cid")
    every = head.unionByName(scored(rest))
    return every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "cid", "plain", "score", "rank")
