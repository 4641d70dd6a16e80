"""Plain loops over all chunks and runs, with borders of their own."""

import collections
import re
import struct

import xxhash


def words(line):
    return len(re.findall(r"[^ \t\n\x0b\f\r]+", line))


def spark_hash(*values):
    """Spark's xxhash64 of strings and longs, signed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=seed)
        signed = seed - (1 << 64) if seed >> 63 else seed
    return signed


def borders(text, divisor=3, long_words=50):
    """The chunks of a text as (first line, line behind the last)."""
    lines = text.split("\n")
    hashes = [spark_hash(x) for x in lines]
    long = [x.count(" ") >= long_words - 1 for x in lines]
    ends = [
        i for i in range(1, len(lines) + 1)
        if i == len(lines) or long[i - 1] or long[i] or spark_hash(hashes[i - 1], hashes[i - 2] if i > 1 else 0) % divisor == 0
    ]
    return list(zip([0, *ends], ends))


def chunk_lines_that_go(texts, long_words=50):
    """(text, line) of the chunks of several lines, or of one long line, that an earlier place has."""
    seen, gone = set(), set()
    for d, text in enumerate(texts):
        lines = text.split("\n")
        for a, b in borders(text):
            body = "\n".join(lines[a:b])
            if (b - a > 1 or lines[a].count(" ") >= long_words - 1) and re.search(r"[^ \t\n\x0b\f\r]", body):
                if body in seen:
                    gone |= {(d, i) for i in range(a, b)}
                seen.add(body)
    return gone


def run_lines_that_go(texts, least=50):
    """(text, line) of the lines in a run of ``least`` words or more that stands at an earlier
    place, too; a place that overlaps the first is none.  By all runs of any length."""
    first, gone = {}, set()
    for d, text in enumerate(texts):
        all_lines = text.split("\n")
        at = [i for i, x in enumerate(all_lines) if words(x)]
        lines = [all_lines[i] for i in at]
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += words(lines[b])
                if n >= least:
                    was, _, end = first.setdefault("\n".join(lines[a : b + 1]), (d, a, b))
                    if was != d or a > end:
                        gone |= {(d, i) for i in range(at[a], [*at, len(all_lines)][b + 1])}
    return gone


def clean(rows, runs):
    """rows: (id, text) in order of id, null texts as they are; the texts that are left."""
    texts = [t or "" for _, t in rows]
    gone = collections.defaultdict(set)
    for d, i in chunk_lines_that_go(texts) | (run_lines_that_go(texts) if runs else set()):
        gone[d].add(i)
    return [
        (k, t if not gone[d] else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])) for d, (k, t) in enumerate(rows)
    ]


def neighbour_lines_that_go(texts):
    """(text, line) of two neighbouring lines with words that an earlier place has side by side
    (one that overlaps the first place is none), and of the wordless lines behind each."""
    first, gone = {}, set()
    for d, text in enumerate(texts):
        lines = text.split("\n")
        at = [i for i, x in enumerate(lines) if words(x)]
        for i in range(len(at) - 1):
            was, place = first.setdefault((lines[at[i]], lines[at[i + 1]]), (d, i))
            if was != d or i > place + 1:
                gone |= {(d, j) for j in range(at[i], [*at, len(lines)][i + 2])}
    return gone
