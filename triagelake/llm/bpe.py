"""BPE encoding and decoding by tree concatenation.

A text longer than ``leaf_chars`` is cut into a tree of halves.  The leaves are
rows of their own, dealt over the cluster and encoded in parallel; one task then
joins the leaves of a text, pair by pair.  A cut falls on a border between two
pieces of the pre-tokenizer if there is one, where concatenation is exact: before
ASCII white space that follows another character, or, in text without such places,
where the pre-tokenizer itself ends a piece that is no white space (of white space
it looks ahead whether more follows).  Only inside a piece that is itself longer than a leaf (long text without any break)
does a cut divide what the merges may join; there the join re-encodes a window
of the last k tokens on the left and the first k on the right, and doubles k
until the window's outermost tokens equal those that both sides had.  A token
sequence is the encoder's own output exactly if every two neighbours are, so
once the ends agree the rest of both sides stands; a window that never agrees
grows to the whole of both sides, which is the plain encoding.

Null and empty texts have no tokens.  Repeated rows and repeated ids are encoded
each on its own.  Only the two named columns are read; other columns, whatever
their names, have no effect.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.common import map_texts
from triagelake.llm.tokens import Encoder, encoder, to_alphabet

ENCODED = "ids binary, n_tokens long, decoded string"
#: Before white space by any table (Python's holds the library's) that is ASCII's, which both know.
SAFE = re.compile(r"(?<=\S)(?=[\t-\r ])")


# ---- cutting -----------------------------------------------------------------

def halves(start: int, end: int, most: int, borders: np.ndarray | None = None) -> list[int]:
    """Leaf borders of [start, end): halved until no part is longer than ``most``;
    each middle moves to the nearest of ``borders`` (sorted) if these are given."""
    if end - start <= most:
        return [end]
    middle = (start + end) // 2
    if borders is not None:
        at = int(np.searchsorted(borders, middle))
        near = [int(b) for b in borders[max(0, at - 1) : at + 1] if start < b < end]
        if not near:
            return [end]
        middle = min(near, key=lambda b: abs(b - middle))
    return halves(start, middle, most, borders) + halves(middle, end, most, borders)


def leaves(enc: Encoder, text: str, most: int) -> Iterator[tuple[str, str]]:
    """(kind, payload) of each leaf, in order.  Kinds: ``special`` (a
    special token's string), ``text`` (normalized, ends on piece borders), ``part``
    and ``end`` (of a piece longer than ``most``, in the byte alphabet)."""
    cut = "|".join(re.escape(s) for s in enc.specials)
    for segment in re.split(f"({cut})", text) if cut else [text]:
        if segment in enc.specials:
            yield "special", segment
            continue
        if enc.tok.normalizer is not None:
            segment = enc.tok.normalizer.normalize_str(segment)
        yield from segment_leaves(enc, segment, most)


def segment_leaves(enc: Encoder, segment: str, most: int) -> Iterator[tuple[str, str]]:
    """The leaves of normalized text without special tokens."""
    borders = np.array([m.start() for m in SAFE.finditer(segment)] if len(segment) > most else [], np.int64)
    at = 0
    for end in halves(0, len(segment), most, borders):
        if end - at <= most:
            if end > at:
                yield "text", segment[at:end]
        else:  # no safe place within
            yield from piece_leaves(enc, segment[at:end], most)
        at = end


def piece_leaves(enc: Encoder, run: str, most: int) -> Iterator[tuple[str, str]]:
    """The leaves of a run by the pre-tokenizer's pieces; those longer than ``most`` are
    cut inside, and white space before one of these is given piece by piece."""
    spans, at = [span for _, span in enc.tok.pre_tokenizer.pre_tokenize_str(run)], 0
    for long_at, long_end in [*((a, b) for a, b in spans if b - a > most), (len(run), len(run))]:
        ends = [e for _, e in spans if at < e <= long_at and not run[e - 1].isspace()]
        stop = long_at if long_at == len(run) or not ends and long_at == at else max(ends, default=at)
        if stop > at:
            for end in halves(at, stop, most, np.array([e for e in ends if e < stop], np.int64)):
                yield "text", run[at:end]
                at = end
        for a, b in spans:
            if stop <= a and b <= long_at:
                yield "end", to_alphabet(run[a:b])
        if long_end > long_at:
            code, done = to_alphabet(run[long_at:long_end]), 0
            for end in halves(0, len(code), most):
                yield "end" if end == len(code) else "part", code[done:end]
                done = end
        at = long_end


# ---- encoding leaves and joining them ----------------------------------------

def encode_code(enc: Encoder, code: str, last: bool) -> np.ndarray:
    """BPE of text in the byte alphabet inside one piece; ``last``: up to its end."""
    model = enc.model if last else enc.inner_model
    return np.array([t.id for t in model.tokenize(code)], enc.dtype)


def encode_leaf(enc: Encoder, kind: str, payload: str) -> np.ndarray:
    if kind == "special":
        return np.array([enc.tok.token_to_id(payload)], enc.dtype)
    if kind == "text":
        if enc.is_plain(payload):
            return enc.encode(payload)
        # already normalized, and without special tokens: its pieces, one by one
        pieces = enc.tok.pre_tokenizer.pre_tokenize_str(payload)
        return np.array([t.id for p, _ in pieces for t in enc.model.tokenize(p)], enc.dtype)
    return encode_code(enc, payload, kind == "end")


def join_parts(enc: Encoder, left: np.ndarray, right: np.ndarray, last: bool, window: int = 8) -> np.ndarray:
    """Ids of two neighbouring parts of one piece, as if encoded at once."""
    strings, mark = enc.strings, len(enc.suffix)
    while len(left) and len(right):
        a, b = max(0, len(left) - window), min(window, len(right))
        at_end = last and b == len(right)
        code = "".join(strings[i] for i in left[a:]) + "".join(strings[i] for i in right[:b])
        if at_end and mark:
            code = code[:-mark]
        joined = encode_code(enc, code, at_end)
        left_agrees = a == 0 or joined[0] == left[a]
        right_agrees = b == len(right) or joined[-1] == right[b - 1]
        if left_agrees and right_agrees:
            return np.concatenate([left[:a], joined, right[b:]])
        window *= 2
    return np.concatenate([left, right])


def join_tree(enc: Encoder, parts: list[np.ndarray]) -> np.ndarray:
    """Joins neighbours pair by pair until one sequence is left."""
    while len(parts) > 1:
        parts = [
            join_parts(enc, parts[i], parts[i + 1], i + 2 >= len(parts)) if i + 1 < len(parts) else parts[i]
            for i in range(0, len(parts), 2)
        ]
    return parts[0]


def join_leaves(enc: Encoder, kinds, packed) -> np.ndarray:
    """All leaves of one text, in order."""
    out: list[np.ndarray] = []
    open_parts: list[np.ndarray] = []
    for kind, raw in zip(kinds, packed, strict=True):
        ids = np.frombuffer(raw, enc.dtype)
        if kind in ("part", "end"):
            open_parts.append(ids)
            if kind == "end":
                out.append(join_tree(enc, open_parts))
                open_parts = []
        else:
            out.append(ids)
    return np.concatenate(out) if out else np.empty(0, enc.dtype)


def encode_by_tree(enc: Encoder, text: str | None, most: int) -> np.ndarray:
    """The same cuts, leaves and joins in one process."""
    rows = list(leaves(enc, text or "", most))
    packed = [encode_leaf(enc, k, p).tobytes() for k, p in rows]
    return join_leaves(enc, [k for k, _ in rows], packed)


def decode(enc: Encoder, ids: np.ndarray) -> str:
    """``decode(ids, skip_special_tokens=False)``; without a decoder the library
    sets one space between the tokens' strings."""
    if enc.tok.decoder is None:
        return " ".join(map(enc.strings.__getitem__, ids.tolist()))
    return enc.tok.decode(ids.tolist(), skip_special_tokens=False)


# ---- on DataFrames -----------------------------------------------------------

def _per_document(df: DataFrame, path: str, leaf_chars: int, finish, schema: str, key: str, text: str) -> DataFrame:
    """``finish(enc, doc_id, ids)`` for each document, short ones in the scanning
    task, long ones by leaves."""
    base = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def short(texts: list) -> list[tuple]:
        enc = encoder(path)
        return [finish(enc, enc.encode(t)) for t in texts]

    def cut(texts: list) -> tuple[list, list]:
        enc = encoder(path)
        made = [(i, (n, *leaf)) for i, t in enumerate(texts) for n, leaf in enumerate(leaves(enc, t, leaf_chars))]
        return [i for i, _ in made], [row for _, row in made]

    def encode_leaves(texts: list) -> list[tuple]:
        enc = encoder(path)
        return [(encode_leaf(enc, *t.split(":", 1)).tobytes(),) for t in texts]

    columns = [c.split()[0] for c in schema.split(", ")]

    def join_one(group, frame):
        enc = encoder(path)
        frame = frame.sort_values("leaf")
        made = finish(enc, join_leaves(enc, frame["kind"], frame["ids"]))
        doc_id = None if pd.isna(group[1]) else int(group[1])
        return pd.DataFrame({"doc_id": pd.array([doc_id], "Int64"), **{c: [v] for c, v in zip(columns, made)}})

    is_long = F.length("text") > leaf_chars
    few = map_texts(base.filter(~is_long), ["doc_id"], short, schema)
    long_ones = base.filter(is_long).withColumn("row_id", F.monotonically_increasing_id())
    cuts = map_texts(long_ones, ["row_id", "doc_id"], cut, "leaf int, kind string, part string", rows=20)
    dealt = cuts.repartition("row_id", "leaf").withColumn("text", F.concat_ws(":", "kind", "part"))
    made = map_texts(dealt, ["row_id", "doc_id", "leaf", "kind"], encode_leaves, "ids binary", rows=50)
    many = made.groupBy("row_id", "doc_id").applyInPandas(join_one, "doc_id long, " + schema)
    return few.unionByName(many)


def encode_documents(df: DataFrame, path: str, leaf_chars: int = 16384, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, packed ids (little-endian, 2 bytes each if the vocabulary allows,
    else 4), n_tokens and the text decoded from these ids, of every whole text."""

    def finish(enc, ids):
        return ids.tobytes(), len(ids), decode(enc, ids)

    return _per_document(df, path, leaf_chars, finish, ENCODED, key, text)


def encoding_digests(df: DataFrame, path: str, leaf_chars: int = 16384, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids (decimal, joined by a space) and
    of the decoded text, without moving ids or decoded texts out of the task."""
    numbers: list[str] = []

    def finish(enc, ids):
        if not numbers:
            numbers.extend(map(str, range(enc.tok.get_vocab_size())))
        said = " ".join(map(numbers.__getitem__, ids.tolist()))
        return (
            len(ids),
            hashlib.sha256(said.encode()).hexdigest(),
            hashlib.sha256(decode(enc, ids).encode("utf-8")).hexdigest(),
        )

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _per_document(df, path, leaf_chars, finish, schema, key, text)
