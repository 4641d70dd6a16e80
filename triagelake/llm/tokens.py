"""Whole-text BPE encoding with the tokenizers library, once per distinct piece.

A byte-pair encoder never merges over the borders that its pre-tokenizer sets,
so a text's ids are the concatenated ids of its pieces.  Pieces repeat far more
often than texts: each Python worker keeps the packed ids of recent pieces and
asks the library's BPE model only for new ones.  Texts with characters beyond
ASCII and the Latin-1 letters, with control characters that Python and the
library class differently, or with a special token's string go through the
library whole, so that its own Unicode tables decide.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer, models

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
UNUSUAL = re.compile(r"[^\x00-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]")
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_PIECES = re.compile(
    rf"{CONTRACTIONS}| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+"
)
WORD_PIECES = re.compile(rf"{CONTRACTIONS}|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in that byte-level BPE gives each byte: printable
    Latin-1 bytes stand for themselves, the others for 256, 257, ... in order."""
    table, spare = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            table[byte] = chr(byte)
        else:
            table[byte] = chr(spare)
            spare += 1
    return table


BYTE_ALPHABET = _byte_alphabet()


def to_alphabet(piece: str) -> str:
    return piece.encode("utf-8").decode("latin-1").translate(BYTE_ALPHABET)


class _Recent(dict):
    """A two-generation cache of short keys: the older half is forgotten when the
    newer is full, so its bytes have a bound."""

    def __init__(self, make, size: int, longest: int = 64):
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Encodes as ``Tokenizer.encode(text, add_special_tokens=False).ids`` does."""

    def __init__(self, path: str, cache_size: int = 200_000):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.lower = "Lowercase" in json.dumps(spec["normalizer"])
        self.pieces = WORD_PIECES if self.suffix else BYTE_PIECES
        self.packed = _Recent(lambda p: self.pack(self.piece_ids(p)), cache_size)

    def pack(self, ids) -> bytes:
        return np.asarray(ids, self.dtype).tobytes()

    def piece_ids(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(to_alphabet(piece))]

    def is_plain(self, text: str) -> bool:
        return not UNUSUAL.search(text) and not ("<|" in text and self.has_special(text))

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.specials)

    def encode_packed(self, text: str | None) -> bytes:
        """Little-endian ids (2 bytes each if the vocabulary allows)."""
        if not text:
            return b""
        if not self.is_plain(text):
            return self.pack(self.tok.encode(text, add_special_tokens=False).ids)
        if self.lower:
            text = text.lower()
        return b"".join(map(self.packed.__getitem__, self.pieces.findall(text)))

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_packed(text), self.dtype)

    @property
    def strings(self) -> list[str]:
        """Token strings by id."""
        if not hasattr(self, "_strings"):
            self._strings = [self.tok.id_to_token(i) for i in range(self.tok.get_vocab_size())]
        return self._strings

    @property
    def inner_model(self) -> models.BPE:
        """The same merges without the end-of-word mark, for text inside a piece."""
        if not hasattr(self, "_inner"):
            spec = json.loads(self.tok.to_str())["model"]
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["merges"]]
            self._inner = models.BPE(spec["vocab"], merges) if self.suffix else self.model
        return self._inner


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    return Encoder(path)
