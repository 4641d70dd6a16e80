"""Context-tree weighting against plain recursion over dictionaries."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from triagelake.llm import ctw


def held(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


class PlainTree:
    """Counts by (context bytes, prefix), products and mixes by recursion."""

    def __init__(self, texts: list[bytes], depth: int):
        self.depth, self.counts, self.kids = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for text in texts:
            for context, byte in self.steps(text):
                for k in range(8):
                    prefix, bit = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1
                    for d in range(depth + 1):
                        self.counts[context[depth - d :], prefix][bit] += 1
                        if d:
                            self.kids[context[depth - d + 1 :], prefix].add(context[depth - d :])
        self.memo: dict = {}

    def steps(self, text: bytes):
        whole = b"\xff" * self.depth + text + b"\xff"
        return ((whole[i - self.depth : i], whole[i]) for i in range(self.depth, len(whole)))

    def ln_pe(self, node) -> float:
        a, b = self.counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def ln_kids(self, node) -> float:
        return sum(self.ln_pw((c, node[1])) for c in self.kids[node])

    def ln_pw(self, node) -> float:
        if node not in self.memo:
            own = self.ln_pe(node)
            self.memo[node] = own if len(node[0]) == self.depth else np.logaddexp(own, self.ln_kids(node)) - math.log(2)
        return self.memo[node]

    def p_one(self, context: bytes, prefix: int, d: int = 0) -> float | None:
        node = (context[self.depth - d :], prefix)
        if node not in self.counts:
            return None
        a, b = self.counts[node]
        own, below = (b + 0.5) / (a + b + 1), self.p_one(context, prefix, d + 1) if d < self.depth else None
        if below is None:
            return own
        share = 0.5 * math.exp(self.ln_pe(node) - self.ln_pw(node))
        return share * own + (1 - share) * below

    def ln_byte(self, context: bytes, byte: int) -> float:
        out = 0.0
        for k in range(8):
            p = self.p_one(context, (1 << k) | (byte >> (8 - k)))
            p = 0.5 if p is None else p
            out += math.log(p if (byte >> (7 - k)) & 1 else 1 - p)
        return out

    def score(self, text: bytes) -> float:
        return sum(self.ln_byte(c, b) for c, b in self.steps(text)) / math.log(10)


def plain_scores(rows: list[tuple], depth: int) -> list[tuple]:
    body = lambda t: (t or "").encode()
    train = [body(t) for i, t in rows if not held(i)]
    tree, counts = PlainTree(train, depth), Counter(w for t in train for w in [*t.lower().split(), None])
    total, distinct, out = sum(counts.values()), len(counts), []
    for i, t in rows:
        tokens = [*body(t).lower().split(), None]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        out.append((i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), total, base, tree.score(body(t))))
    return out


def check(df, rows: list[tuple], depth: int, **how) -> None:
    by = lambda r: (str(r[0]), *map(str, r[1:4]), round(r[6], 6))
    got = sorted((tuple(r)[:7] for r in ctw.score_documents(df, depth=depth, **how).collect()), key=by)
    want = sorted(plain_scores(rows, depth), key=by)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-8, atol=1e-8)


def some_rows() -> list[tuple]:
    words = "the of and café über don't x1 THE 日本".split()
    rows = [(i, " ".join(words[(i * j + j // 3) % len(words)] for j in range(i % 23))) for i in range(60)]
    return [*rows, (None, "no id"), (None, None), (5, rows[5][1]), (5, rows[5][1]), (70, ""), (71, None), (72, "ab\x00\x00ab\x00"), (73, "a" * 3000), (74, " \n\t ")]


@pytest.mark.parametrize("depth", [4, 6])
def test_scores_match_plain_recursion(spark, depth):
    rows = some_rows()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, score string, key int").repartition(3)
    check(df, rows, depth)


def test_parts_of_the_tables_change_nothing(spark, monkeypatch):
    rows = some_rows()[:40]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ctw, "WINDOWS", 50)
    check(df, rows, 4, part_rows=60)


def test_probabilities_sum_to_one_and_windows_cover_texts():
    bodies = [b"abcabd", b"", b"x" * 40, b"abc"]
    for d in (4, 5, 6):
        grams = np.concatenate([g for _, g in ctw.windows(bodies, d)])
        plain = [w for b in bodies for w in [(b"\xff" * d + b + b"\xff")[i : i + d + 1] for i in range(len(b) + 1)]]
        assert [int(g).to_bytes(d + 1, "big") for g in grams] == plain
    tree = PlainTree(bodies, 4)
    for context in (b"\xffabc", b"xxxx", b"zzzz"):
        assert math.isclose(sum(math.exp(tree.ln_byte(context, b)) for b in range(256)), 1)


def test_lookup():
    keys = np.random.default_rng(3).integers(0, 2**63, 5000).astype(np.uint64)
    keys = np.unique(keys)
    table = ctw.Lookup(keys, np.arange(1, len(keys) + 1))
    assert (table(keys) == np.arange(1, len(keys) + 1)).all() and (table(keys + np.uint64(1)) == 0).all()


def test_training_rows_only_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ctw.score_documents(none).collect() == []
    ids = [i for i in range(200) if held(i)][:3]
    rows = [(i, f"text {i}") for i in ids]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 5)


def test_held_out_texts_beat_the_unigram_model(spark):
    got = ctw.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert all(r["score"] < 0 and r["n_known"] <= r["n_tokens"] for r in got)
