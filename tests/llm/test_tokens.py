"""Encoding, id files and packing against the tokenizers library itself."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from triagelake.llm import bpe, idfiles, packing
from triagelake.llm.common import fresh_path
from triagelake.llm.tokens import encoder, vocabulary

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
ALPHABETS = ["abc", "aA \n", "it's the 123!?", "éÉß ñ", "日本語 x", "ȩ\u0301a ", " \t\x1c\x85\xa0　x", "<|endoftext|> a", "aaaa", "=-_", "thingertion"]


def texts(n, seed=3):
    rnd = random.Random(seed)
    for _ in range(n):
        a = rnd.choice(ALPHABETS)
        t = "".join(rnd.choice(a) for _ in range(rnd.randint(0, 150)))
        yield t if rnd.random() < 0.8 else "ab" * rnd.randint(1, 90) + t


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_library(path):
    enc, tok = encoder(path), Tokenizer.from_file(path)
    for t in texts(600):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert enc.encode(t).tolist() == ids
        assert bpe.decode(enc, enc.encode(t)) == tok.decode(ids, skip_special_tokens=False)


#: White space of each table beside symbols, contractions and letters.
BORDERS = ["!", "x", "'", "s", "t", "1", "é", "日", " ", "\n", "\t", "\x0b", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u2028", "\u3000", "ß", "-", "\u0301"]


def border_texts(n, seed):
    rnd = random.Random(seed)
    for _ in range(n):
        few = rnd.sample(BORDERS, rnd.randint(2, 6))
        yield "".join(rnd.choice(few) * rnd.choice([1, 1, 1, 2, 9]) for _ in range(rnd.randint(1, 40)))


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_tree_equals_library_at_any_leaf_size(path):
    enc, tok = encoder(path), Tokenizer.from_file(path)
    for t in [*texts(400, 4), *border_texts(3000, 9)]:
        want = tok.encode(t, add_special_tokens=False).ids
        for most in (3, 7, 16, 40):
            assert bpe.encode_by_tree(enc, t, most).tolist() == want, (t, most)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_tree_equals_library_on_long_texts(path):
    enc, tok = encoder(path), Tokenizer.from_file(path)
    long = ["!\x1c!" * 6000, "it's\x1f" * 5000, "a\u3000\u3000" * 9000, "\u3000" * 20000 + "x" * 20000 + "\xa0\xa0" + "y" * 17000, "é\x85 's\n" * 6000, "x" * 40000 + " !" * 9000]
    for t in [*long, *("".join(border_texts(700, k)) for k in range(6))]:
        assert len(t) > 16384 and bpe.encode_by_tree(enc, t, 16384).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_encoding_digests(spark, odd_docs):
    tok = Tokenizer.from_file(WORD)
    got = bpe.encoding_digests(odd_docs, WORD, leaf_chars=3000).collect()
    want = []
    for r in odd_docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        said, text = " ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    full = {(r.doc_id, r.n_tokens) for r in bpe.encode_documents(odd_docs, WORD).collect()}
    assert full == {(w[0], w[1]) for w in want}


def library_ids(docs, end):
    tok = Tokenizer.from_file(BYTE)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    return [(r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids + [end]) for r in rows]


def test_id_files_round_trip(spark, odd_docs):
    folder = fresh_path(spark, "test-ids")
    manifest = idfiles.write_ids(odd_docs, folder, BYTE, end_id=2, shard_docs=4)
    assert manifest.count() >= 4
    got = sorted(map(tuple, idfiles.read_digests(spark, folder).collect()), key=lambda r: r[1])
    want, start = [], 0
    for doc_id, ids in library_ids(odd_docs, 2):
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    keys = spark.createDataFrame([(6,), (2,), (12345,), (2**60 + 1,), (None,)], "doc_id long")
    found = [(r.doc_id, bytes(r.ids)) for r in idfiles.lookup(spark, folder, keys).collect()]
    assert sorted((d for d, _ in found), key=lambda d: (d is None, d)) == [2, 2, 6, 2**60 + 1, None]
    assert dict(found)[6] == np.array(dict(library_ids(odd_docs, 2))[6], "<u4").tobytes()
    assert "Join" not in idfiles.lookup(spark, folder, keys)._jdf.queryExecution().executedPlan().toString()


def test_keys_of_several_shards(spark):
    """Rows of one id, or of none, fill several shards and are found with their numbers."""
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(10)] + [(None, f"none {i}") for i in range(9)] + [(8, "x")], "doc_id long, text string").repartition(4)
    folder = fresh_path(spark, "test-ids")
    idfiles.write_ids(docs, folder, BYTE, end_id=2, shard_docs=3)
    got = idfiles.lookup(spark, folder, spark.createDataFrame([(7,), (None,), (8,)], "doc_id long")).collect()
    assert sorted(r.nth for r in got if r.doc_id == 7) == list(range(10)) and sorted(r.nth for r in got if r.doc_id is None) == list(range(9))
    want = sorted(np.array(x, "<u4").tobytes() for _, x in library_ids(docs, 2))
    assert sorted(bytes(r.ids) for r in got) == want


def test_reading_back_is_dealt_over_tasks(spark):
    docs = spark.range(40).selectExpr("id as doc_id", "concat('text ', id) as text")
    folder = fresh_path(spark, "test-ids")
    idfiles.write_ids(docs, folder, BYTE, shard_docs=2)
    got = idfiles.read_digests(spark, folder)
    assert got.select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism
    assert got.count() == 40


def test_a_key_costs_the_same_reads_in_any_shard(spark):
    """A document is found by reads whose bytes do not grow with the shard."""
    read = {}
    for n in (20, 5000):
        folder = fresh_path(spark, "test-ids")
        shards = idfiles.write_ids(spark.range(n).selectExpr("id as doc_id", "'x' as text").coalesce(1), folder, BYTE, shard_docs=10000).collect()
        shard = max(shards, key=lambda r: r.n_docs)
        reader = idfiles.ShardReader(folder, shard["name"])
        seen, index = [], reader.index

        class Counting:
            def read_at(self, size, at):
                seen.append(size)
                return index.read_at(size, at)

        reader.index = Counting()
        for k in range(shard.first_id, shard.last_id + 1):
            assert reader.get(k) is not None
        assert max(seen) <= idfiles.BLOCK.itemsize and reader.get(10**9) is None
        read[n] = sum(seen) / (shard.last_id - shard.first_id + 1)
    assert read[5000] < 2 * read[20]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 17, 5000):
        codes = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        assert sorted(idfiles.PerfectHash.build(codes).slots(codes)) == list(range(len(codes)))


def test_id_files_of_an_empty_table(spark, odd_docs):
    folder = fresh_path(spark, "test-ids")
    idfiles.write_ids(odd_docs.limit(0), folder, BYTE)
    assert idfiles.read_digests(spark, folder).count() == 0


def check_packing(docs, rows, capacity):
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    ids = library_ids(docs, 0)
    crc = sorted((d, zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids if d is not None)
    pieces = sum(len(x) for _, x in ids)
    assert sum(r.length for r in rows) == pieces and crc
    # every id of a document lies in exactly one piece
    for d, x in ids:
        own = [r for r in rows if r.doc_id == d and r.doc_tokens == len(x)]
        covered = sorted((r.start, r.start + r.length) for r in own)
        copies = sum(1 for e, y in ids if e == d and len(y) == len(x))
        assert sum(b - a for a, b in covered) == copies * len(x)
        for r in own:
            part = np.array(x[r.start : r.start + r.length], "<u4").tobytes()
            assert zlib.crc32(part) == r.ids_crc32 or copies > 1
    padding = 0
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding == 0
    return len(windows)


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing(spark, odd_docs, capacity):
    rows = packing.pack(odd_docs, BYTE, capacity=capacity, end_id=0).collect()
    check_packing(odd_docs, rows, capacity)


def test_packing_of_an_empty_table(spark, odd_docs):
    assert packing.pack(odd_docs.limit(0), BYTE).count() == 0


def test_fillings_are_exact():
    rnd = random.Random(2)
    for capacity in (1, 7, 32):
        for _ in range(60):
            counts = {n: rnd.randint(0, 5) for n in range(1, capacity + 1)}
            filled, rest = packing.fillings(counts, capacity)
            used = dict.fromkeys(counts, 0)
            for multiset, times in filled:
                assert sum(n * c for n, c in multiset.items()) == capacity
                for n, c in multiset.items():
                    used[n] += c * times
            assert all(used[n] + rest.get(n, 0) == counts[n] for n in counts)


def test_closest_is_the_best_sum():
    rnd = random.Random(6)
    for _ in range(200):
        items = [rnd.randint(1, 12) for _ in range(rnd.randint(0, 7))]
        room = rnd.randint(0, 30)
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        got = packing.closest({x: items.count(x) for x in items}, room)
        assert all(c <= items.count(n) for n, c in got.items())
        assert sum(n * c for n, c in got.items()) == max(s for s in sums if s <= room)
