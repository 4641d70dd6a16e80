"""Quality rules: counts on the whole text, and a linear-chain CRF over its lines.

Each line with a word is content or boilerplate.  A linear-chain conditional
random field scores the labels of a text's lines from features of each line and
from the labels of neighbouring lines; Viterbi decoding gives the best sequence.
A text stays if its content lines hold at least ``min_content`` of its words and
the base rules (number of words, repeated words) let it.

The CRF is fitted on at most ``max_train_docs`` labelled documents (all lines of
texts of at most ``max_train_chars`` characters, one text for each id): a line of a
document of good quality counts as content, of bad quality as boilerplate.  So the
chain's moves mainly learn that lines of one kind stand together.  Without labels
of both kinds the prior weights decide.

Words are ``[^\\x20\\x09-\\x0D]+``.  A null text counts as empty; a text without
words fails the base rules.  Repeated rows are judged alike.  Only the named
columns are read; other columns, whatever their names, have no effect.  An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.common import map_texts, per_text

SPACES = bytes([0x20, *range(0x09, 0x0E)])
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
CONTINUATION = bytes(range(0x80, 0xC0))  # bytes inside a UTF-8 code point
FEATURES = ["bias", "symbols", "capitals", "repeats", "bars", "no_letters", "marks", "short", "stops"]
#: Weights of content against boilerplate before any fitting.
PRIOR = np.array([2.0, -20.0, -4.0, -4.0, -20.0, -4.0, -8.0, 0.0, 0.5])
RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_words long"
)


# ---- counts and features -----------------------------------------------------

def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    size = len(seen)
    if size < 2_000_000:  # three numbers below 2**21 fit in 63 bits
        windows = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:
        pairs = np.unique(ids[:-2] * size + ids[1:-1], return_inverse=True)[1]
        windows = pairs * size + ids[2:]
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marked = np.zeros(n, bool)
    for shift in range(3):
        marked[shift : n - 2 + shift] |= twice
    return int(marked.sum())


def without(text: bytes, drop: bytes) -> int:
    """How many bytes of ``text`` are in ``drop``."""
    return len(text) - len(text.translate(None, drop))


def line_features(line: bytes, words: list[bytes]) -> list[float]:
    n, size = len(words), max(1, len(line) - without(line, SPACES))
    upper, lower = without(line, UPPER), without(line, LOWER)
    high = without(line, bytes(range(0x80, 0x100)))
    return [
        1.0,
        without(line, SYMBOLS) / size,
        upper / max(1, upper + lower),
        1.0 - len(set(words)) / n,
        line.count(b"|") / n,
        1.0 - (upper + lower + high) / size,
        (line.count(b"!") + line.count(b"?")) / n,
        1.0 if n < 4 else 0.0,
        (line.count(b". ") + line.endswith(b".")) * 10.0 / max(10, n),
    ]


def document(text: str | None) -> tuple[tuple, np.ndarray, np.ndarray]:
    """Base counts, features of the lines with a word, and their words' numbers."""
    raw = (text or "").encode("utf-8")
    words = raw.split()  # bytes.split() parts at x20 and x09-x0D, and nowhere else
    packed = b"".join(words)
    lines, features, sizes, n_dup = set(), [], [], 0
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            continue
        n_dup += line in lines
        lines.add(line)
        features.append(line_features(line, own))
        sizes.append(len(own))
    counts = (
        len(words),
        len(packed) - without(packed, CONTINUATION),
        without(raw, SYMBOLS),
        n_dup,
        repeated_words(words),
    )
    return counts, np.array(features).reshape(-1, len(FEATURES)), np.array(sizes, np.int64)


# ---- the chain ---------------------------------------------------------------

def viterbi(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best label sequence; emit: lines x 2, move[a, b]: from label a to b."""
    n = len(emit)
    back = np.zeros((n, 2), np.int8)
    score = emit[0].copy()
    m = move.tolist()
    a, b = float(score[0]), float(score[1])
    for i in range(1, n):
        from_a, from_b = a + m[0][0], b + m[1][0]
        to_a, to_b = a + m[0][1], b + m[1][1]
        back[i, 0], back[i, 1] = from_b > from_a, to_b > to_a
        a, b = max(from_a, from_b) + float(emit[i, 0]), max(to_a, to_b) + float(emit[i, 1])
    out = np.zeros(n, np.int8)
    out[-1] = b > a
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


class LineCrf:
    """Label 1 is content, 0 boilerplate; ``weights``: of content against boilerplate."""

    def __init__(self, weights: np.ndarray = PRIOR, move: np.ndarray | None = None):
        self.weights = np.asarray(weights, float)
        self.move = np.array([[0.5, 0.0], [0.0, 0.5]]) if move is None else move

    def labels(self, features: np.ndarray) -> np.ndarray:
        if not len(features):
            return np.zeros(0, np.int8)
        emit = np.zeros((len(features), 2))
        emit[:, 1] = features @ self.weights
        return viterbi(emit, self.move)

    def fit(self, chains: list[tuple[np.ndarray, int]], steps: int = 30, rate: float = 0.5, pull: float = 1e-3) -> LineCrf:
        """Gradient ascent on the likelihood of the labels (one for all lines of a
        chain), pulled towards the prior; chains of each class weigh alike."""
        n_good = sum(y for _, y in chains)
        if not 0 < n_good < len(chains):
            return self
        share = np.array([0.5 / (len(chains) - n_good), 0.5 / n_good])
        scale = np.maximum(np.abs(np.concatenate([x for x, _ in chains])).mean(axis=0), 1e-3)
        for _ in range(steps):
            grad_w, grad_m = np.zeros_like(self.weights), np.zeros((2, 2))
            for x, y in chains:
                node, pair = self._marginals(x)
                part = share[y] / len(x)
                grad_w += part * ((y - node) @ x)
                seen = np.zeros((2, 2))
                seen[y, y] = len(x) - 1
                grad_m += part * (seen - pair)
            self.weights = self.weights + rate * (grad_w / scale**2 * 0.2 - pull * (self.weights - PRIOR))
            self.move = self.move + rate * grad_m
        return self

    def _marginals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each line and the expected moves, by forward-backward."""
        emit = np.zeros((len(x), 2))
        emit[:, 1] = np.clip(x @ self.weights, -30, 30)
        e, t = np.exp(emit - emit.max(axis=1, keepdims=True)), np.exp(self.move)
        fore, back = np.zeros_like(e), np.ones_like(e)
        fore[0] = e[0] / e[0].sum()
        for i in range(1, len(x)):
            fore[i] = (fore[i - 1] @ t) * e[i]
            fore[i] /= fore[i].sum()
        for i in range(len(x) - 2, -1, -1):
            back[i] = t @ (e[i + 1] * back[i + 1])
            back[i] /= back[i].sum()
        node = fore * back
        node /= node.sum(axis=1, keepdims=True)
        pair = np.zeros((2, 2))
        for i in range(len(x) - 1):
            p = fore[i][:, None] * t * (e[i + 1] * back[i + 1])[None, :]
            pair += p / p.sum()
        return node[:, 1], pair


def verdict(crf: LineCrf, body: str | None, min_content: float, min_words: int = 50, max_repeat_percent: int = 50) -> tuple:
    """The columns of ``RESULT`` for one text."""
    counts, x, sizes = document(body)
    content = crf.labels(x)
    n_words, n_repeat = counts[0], counts[4]
    failed = n_words < min_words or 100 * n_repeat > max_repeat_percent * n_words
    good = int(sizes[content == 1].sum())
    return (*counts, failed, not failed and good >= min_content * n_words, len(sizes), int(content.sum()), good)


# ---- on DataFrames -----------------------------------------------------------

def train(
    df: DataFrame, labels: DataFrame, max_train_docs: int = 200, key: str = "doc_id", text: str = "text", label: str = "quality",
    max_train_chars: int = 20_000,
) -> LineCrf:
    """Fits on documents whose id hashes lowest, half of each quality at most; at
    most ``max_train_docs`` texts of ``max_train_chars`` characters reach the driver."""
    known = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    half = max_train_docs // 2
    by_hash = F.xxhash64("doc_id")
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).distinct().orderBy(by_hash, "doc_id").limit(half)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most max_train_docs rows
    fit = df.filter(F.length(text) <= max_train_chars).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    sample = fit.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def features(texts: list) -> list[tuple]:
        return [(document(t)[1].ravel().tolist(),) for t in texts]

    got = map_texts(sample, ["doc_id", "y"], features, "x array<double>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["y"], r["x"]))
    chains = [(np.array(r["x"]).reshape(-1, len(FEATURES)), r["y"]) for r in got if r["x"]]
    return LineCrf().fit(chains)


def judge(
    df: DataFrame, model: LineCrf | None = None, min_content: float = 0.5,
    min_words: int = 50, max_repeat_percent: int = 50, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Base counts, base_failed, kept and the content lines of every whole text."""
    crf = model or LineCrf()

    def rate(texts: list) -> list[tuple]:
        return [verdict(crf, body, min_content, min_words, max_repeat_percent) for body in texts]

    base = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_texts(base, ["doc_id"], rate, RESULT)


def label_lines(df: DataFrame, model: LineCrf | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no, line and is_content of every line (null: without a word)."""
    crf = model or LineCrf()

    def mark(texts: list) -> tuple[list, list]:
        index, rows = [], []
        for i, body in enumerate(texts):
            lines = (body or "").split("\n")
            labels = iter(crf.labels(document(body)[1]).tolist())
            index += [i] * len(lines)
            rows += [(n, x, bool(next(labels)) if x.encode("utf-8").split() else None) for n, x in enumerate(lines)]
        return index, rows

    base = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_texts(base, ["doc_id"], mark, "line_no long, line string, is_content boolean")


def keep_good(df: DataFrame, model: LineCrf | None = None, min_content: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``df`` that ``judge`` keeps, with all their columns, whatever their names."""
    crf = model or LineCrf()
    good = per_text(df.sparkSession, lambda body: verdict(crf, body, min_content)[6], "boolean")
    return df.filter(good(F.col(text)))
