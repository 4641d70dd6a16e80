"""Spelling variants against plain loops."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np

from triagelake.llm import variants

A_TO_Z = {c: c + 32 for c in range(65, 91)}


def plain_words(rows: list[tuple], min_letters: int = 6, min_count: int = 5, one_in: int = 199) -> Counter:
    counts: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(A_TO_Z)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= min_letters
    return Counter({w: n for w, n in counts.items() if n >= min_count})


def is_near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts: Counter, ratio: int = 5) -> set[tuple]:
    form, near = {}, {w: [v for v in counts if is_near(w, v)] for w in counts}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), form[w] and counts[form[w]]))
    return out


def result(df) -> set[tuple]:
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def some_rows(seed: int = 5) -> list[tuple]:
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abÀÿéx") for _ in range(rnd.randint(5, 8))) for _ in range(25)]

    def word() -> str:
        w = stems[min(int(rnd.expovariate(0.4)), len(stems) - 1)]
        for _ in range(rnd.choice([0, 0, 0, 0, 1, 1, 2])):
            at = rnd.randrange(len(w))
            w = rnd.choice([w[:at] + w[at + 1 :], w[:at] + rnd.choice("abÀé") + w[at:], w[:at] + rnd.choice("abÀé") + w[at + 1 :]])
        return rnd.choice([w, w, w.upper() if w.isascii() else w])

    rows = [(i, rnd.choice([" ", "\n", "1", "_", "Ā"]).join(word() for _ in range(300))) for i in range(60)]
    return [*rows, (7, rows[7][1]), (None, rows[3][1]), (None, None), (100, ""), (101, None), (102, "Long" * 30 + " 東京 " + "long" * 30)]


def test_words_neighbours_and_roots_match_plain_loops(spark):
    rows = some_rows()
    counts = plain_words(rows)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    want = plain_variants(counts)
    assert len(want) > 100 and any(r[2] not in (r[0], r[1]) for r in want)
    assert result(variants.group_variants(variants.damaged_words(df))) == want


def test_many_passes_and_parts_change_nothing(spark):
    words = spark.createDataFrame([(w,) for w, n in plain_words(some_rows(9)).items() for _ in range(n)], "word string")
    plan = variants.Plan({6: 400, 7: 50, 64: 3}, filter_bytes=300)
    assert plan.parts[6] == 4 and len(plan.passes) > 4
    assert result(variants.group_variants(words, filter_bytes=300)) == result(variants.group_variants(words))


def test_long_words_and_repeated_letters(spark):
    long = "ab" * 5_000
    words = [long, long + "b", "b" + long, long[:70] + "é" + long[71:], "aaaaaaa", "aaaaaa", "aaaaab", "a" * 63, "a" * 64, "a" * 65, "a" * 66]
    df = spark.createDataFrame([(w,) for i, w in enumerate(words) for _ in range(5 + 30 * i)], "word string")
    assert result(variants.group_variants(df)) == plain_variants(Counter({w: 5 + 30 * i for i, w in enumerate(words)}))


def test_keys_of_edits_are_those_of_the_words_they_make():
    words = ["abcabc", "aabbcc", "éàéàéà"]
    keys = variants.word_keys(words)
    (_, codes), = variants.by_length(words)
    alphabet = np.array(sorted({ord(c) for w in words for c in w}), np.uint32)
    made = {(int(r), int(k)) for row, key in variants.replacements(codes, keys, alphabet) for r, k in zip(row, key)}
    plain = {(i, int(variants.word_keys([w[:p] + chr(c) + w[p + 1 :]])[0])) for i, w in enumerate(words) for p in range(6) for c in alphabet if chr(c) > w[p]}
    assert made == plain
    made = {(int(r), int(k)) for r, k in zip(*variants.deletions(codes, keys))}
    assert made == {(i, int(variants.word_keys([w[:p] + w[p + 1 :]])[0])) for i, w in enumerate(words) for p in range(6)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group_variants(variants.damaged_words(df)).collect() == []
