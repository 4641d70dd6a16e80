"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles, hashed to 64 bits.  XOR-ing the
tokens' hashes into a sketch keeps of each position only the parity of how often
it was hit, so two sketches differ in at most as many positions as the sets'
symmetric difference has members.

Sets whose Jaccard similarity is 85 % or more differ in at most 3/17 of the
smaller one's members.  Sizes are dealt into bands; a set takes part in its own
band and in each band below that still holds a possible smaller partner.  In a
band whose largest size allows d differences, the sketch has k = d + c blocks,
c >= 3: a pair agrees in at least k - d(smaller size) blocks whole.  A block's
content is the XOR of its tokens' hashes; blocks are joined by content:

* empty blocks say nothing and are left out, unless a set has so many of them
  that it may agree with a partner in these alone;
* a set with fewer shared blocks than a partner needs has none and goes; of the
  others the blocks count that are rarest in the corpus, all but as many of the
  most frequent as a partner needs less one (frequent passages join nothing);
* within a block, each set is paired with the central one, whose blocks most other
  sets share; pairs are verified (sizes, Hamming distance of 512-bit parity
  sketches, then the exact intersection), and verified links make components;
* where a block still holds two components or more, its next central set has a
  round; after ``rounds`` of these the block is dealt into parts of ``part_sets``
  sets, parts meet parts, and pairs across components are held against sizes and
  sketches within the join; those that pass are verified.  No link between
  components is lost, and a group of near copies needs no pairs within it.

How often a key occurs is counted where its rows meet.  A key that a sample of the
sets shows to have more than its share of a task's rows is frequent: it is given
the sample's count and its rows stay dealt by a hash of the set (any order of the
keys is right, if it is one for all sets).  A key is frequent at one part in
``FREQUENT`` of all rows, so there are at most that many, and their table, which
goes to all tasks, has at most as many rows.

Equal texts met by one task send one set only and links for the others, so a
group of copies is combined before the shuffle.

A set is empty without words; then it is linked with nothing.  Rows with one id
are one node.  Null ids have a null component.  Only the two named columns are
read.  An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.llm.common import map_texts, stage_table
from triagelake.llm.idfiles import mix

STEP = np.uint64(0x9E3779B97F4A7C15)
FREQUENT, SAMPLE = 20_000, 16


# ---- sets and sketches -------------------------------------------------------

class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = value
        return value


_words = _Words()


def shingles(text: str | None, n: int = 4) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of the lower-cased (A-Z) text;
    fewer words make one shingle, no words none."""
    # bytes.lower() and bytes.split() know A-Z and x20, x09-x0D only
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    code = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    out = np.zeros(len(code) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = out * STEP + code[i : len(code) - width + 1 + i]
    return np.unique(mix(out, width))


@lru_cache(maxsize=8)
def bands(percent: int, up_to: int = 1 << 40, ratio: float = 1.4) -> tuple[tuple[int, int, int, int], ...]:
    """(lowest size, highest size, most differences, blocks) of each band."""
    out, lo = [], 1
    while lo < up_to:
        hi = max(lo, int(lo * ratio) - 1)
        d = differences(hi, percent)
        out.append((lo, hi, d, d + 3 + d // 10))
        lo = hi + 1
    return tuple(out)


def differences(smaller: int, percent: int) -> int:
    """Largest symmetric difference of two sets of ``percent`` similarity or more:
    I >= p U and U <= smaller / p give U - I <= (1 - p) / p * smaller."""
    return (100 - percent) * smaller // percent


def block_keys(tokens: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """(band, shared keys that a partner needs, keys of the blocks) for each
    band that the set takes part in."""
    size, out = len(tokens), []
    place, content = mix(tokens, 11) >> np.uint64(32), mix(tokens, 12)
    for g, (lo, hi, d, k) in enumerate(bands(percent)):
        if lo > size:
            break
        if 100 * hi < percent * size:
            continue
        block = (place * np.uint64(k)) >> np.uint64(32)
        order = np.argsort(block, kind="stable")
        ordered = block[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(ordered)) + 1])
        number, value = ordered[first], np.bitwise_xor.reduceat(content[order], first)
        need, blank = k - differences(min(size, hi), percent), k - len(number)
        if blank >= need:
            empty = np.setdiff1d(np.arange(k, dtype=np.uint64), number)
            number, value = np.concatenate([number, empty]), np.concatenate([value, np.zeros(len(empty), np.uint64)])
        keys = mix(value ^ mix(number + np.uint64(g << 40), 13), 14)
        # a partner may agree in empty blocks, too, which are not among the keys
        out.append((g, max(1, need - blank), keys.view(np.int64)))
    return out


def parity_sketch(tokens: np.ndarray, bits: int = 512) -> list[int]:
    """Parity of how many tokens hash to each of ``bits`` positions, as longs."""
    hits = np.bincount((mix(tokens, 15) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(hits.astype(bool)).view(np.int64).tolist()


# ---- components --------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of ``edges`` (a, b),
    by alternating large-star and small-star steps until each node has one edge to
    its smallest; each step is written to the shared folder.  Edges that are such
    stars already need no step."""
    spark = edges.sparkSession
    now = stage_table(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    while not are_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        now = stage_table(spark, small.filter("a <> b").distinct(), "edges")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def are_stars(edges: DataFrame) -> bool:
    """Whether each node of ``edges`` (a > b) has one smaller neighbour, or larger ones only."""
    ends = edges.selectExpr("a AS node", "1 AS up", "0 AS down").union(edges.selectExpr("b", "0", "1"))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count_if(F.expr("up > 1 or (up = 1 and down = 1)"))).first()[0] == 0


# ---- on DataFrames -----------------------------------------------------------

def jaccard_join(df: DataFrame, n: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every whole text."""
    sets, links = jaccard_links(df, n, percent, key, text)
    found = components(links)
    out = sets.join(found, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def jaccard_links(df: DataFrame, n: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text", rounds: int = 2, part_sets: int = 512) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles) of every row, and links (a, b) that join each pair of
    similar documents, directly or over others (over the smallest of their group)."""
    spark = df.sparkSession
    base = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    first_seen: dict[bytes, int] = {}

    def sketch(rows: list) -> tuple[list, list]:
        index, out = [], []
        for i, r in enumerate(rows):
            tokens = shingles(r["text"], n)
            doc_id, link, made = r["doc_id"], None, []
            if len(tokens) and doc_id is not None:
                if len(first_seen) > 200_000:
                    first_seen.clear()
                link = first_seen.setdefault(xxhash.xxh3_128_digest(tokens.tobytes()), doc_id)
                if link == doc_id:
                    link, made = None, block_keys(tokens, percent)
            index += [i] * max(1, len(made))
            out += [(len(tokens), link, g, need, keys.tolist(), len(keys)) for g, need, keys in made] or [(len(tokens), link, None, None, [], 0)]
        return index, out

    rows = base.select("doc_id", F.struct("doc_id", "text").alias("text"))
    made = stage_table(spark, map_texts(rows, ["doc_id"], sketch, "n_shingles long, link long, band int, need int, keys array<bigint>, n_keys long"), "sketches")
    # a row for each band: the first of a document stands for it
    first_band = "band is null or band = own"
    own = F.lit(0)
    for g, (lo, *_rest) in enumerate(bands(percent)):
        own = F.when(F.col("n_shingles") >= lo, F.lit(g)).otherwise(own)
    sets = made.withColumn("own", own).filter(first_band).select("doc_id", "n_shingles")
    equal = made.filter("link is not null").select(F.col("doc_id").alias("a"), F.col("link").alias("b"))

    blocks = made.filter("band is not null").select("doc_id", "band", "need", F.explode("keys").alias("k"))
    frequent = stage_table(spark, frequent_keys(made), "frequent")
    shared = counted(blocks, frequent).filter("m > 1")
    by_set = Window.partitionBy("doc_id", "band")
    weighed = shared.withColumns({
        "n": F.count("*").over(by_set), "w": F.sum("m").over(by_set), "rarer": F.row_number().over(by_set.orderBy("m", "k")),
    })
    # partners agree in `need` blocks or more, so among all but the need - 1 most frequent, too
    rare = weighed.filter("rarer <= n - need + 1").select("doc_id", "k", "w")
    buckets = stage_table(spark, counted(rare, frequent).filter("m > 1").select("doc_id", "k", "w"), "blocks")

    wanted = buckets.select("doc_id").distinct()
    tokens = map_texts(
        base.join(wanted, "doc_id", "left_semi"), ["doc_id"],
        lambda texts: [((s := shingles(t, n)).view(np.int64).tolist(), parity_sketch(s)) for t in texts],
        "s array<bigint>, p array<bigint>", rows=200,
    )
    tokens = stage_table(spark, tokens, "tokens")

    # In each round a block's central set (the one whose blocks most others share)
    # meets all others of the block that are not in its component yet.  Of the links
    # so far only the stars of their components go on.
    links, open_ = stage_table(spark, equal, "links"), buckets
    for _ in range(max(1, rounds)):
        head = open_.groupBy("k").agg(F.max(F.struct("w", (-F.col("doc_id")).alias("id"))).alias("h")).select("k", (-F.col("h.id")).alias("b"))
        met = open_.join(head, "k").filter("doc_id <> b").select("doc_id", "k", "w", "b")
        stars = met.select(F.col("doc_id").alias("a"), "b").distinct()
        found = components(links.unionByName(verify(stars, tokens, percent)))
        links = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        open_ = stage_table(spark, several_components(met.select("doc_id", "k", "w"), found), "open")
    # what is left: the pairs of a block across components that sizes and sketches allow
    rest = in_parts(open_.drop("w"), part_sets)
    sketches = tokens.select("doc_id", F.size("s").alias("size"), *[F.get("p", i).alias(f"p{i}") for i in range(8)])
    rest = rest.join(sketches, "doc_id")
    a, b = (rest.select(*[F.col(c).alias(f"{c}_{x}") for c in rest.columns]) for x in ("a", "b"))
    numbers = "sequence(0, n_{0} - 1)"
    a, b = a.withColumn("other", F.explode(F.expr(numbers.format("a")))), b.withColumn("other", F.explode(F.expr(numbers.format("b"))))
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    apart = sum((F.bit_count(F.col(f"p{i}_a").bitwiseXOR(F.col(f"p{i}_b"))) for i in range(1, 8)), F.bit_count(F.col("p0_a").bitwiseXOR(F.col("p0_b"))))
    may = (F.col("c_a") != F.col("c_b")) & (F.col("doc_id_a") > F.col("doc_id_b")) & (100 * small >= percent * large) & (apart * percent <= (100 - percent) * small)
    meet = (F.col("k_a") == F.col("k_b")) & (a["other"] == F.col("part_b")) & (F.col("part_a") == b["other"])
    across = a.join(b, meet & may).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()
    return sets, links.unionByName(verify(across, tokens, percent))


def frequent_keys(made: DataFrame) -> DataFrame:
    """k and m (estimated) of the keys with more than one part in ``FREQUENT`` of all
    rows, by the sets whose ids a hash puts into one part of ``SAMPLE``."""
    total = made.agg(F.sum("n_keys")).first()[0] or 0
    seen = made.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select(F.explode("keys").alias("k"))
    many = F.col("m") * SAMPLE > max(total / FREQUENT, 8 * SAMPLE)
    return seen.groupBy("k").agg(F.count("*").alias("m")).filter(many).select("k", (F.col("m") * SAMPLE).alias("often"))


def counted(blocks: DataFrame, frequent: DataFrame) -> DataFrame:
    """``blocks`` and m, how many sets have the key; rows of frequent keys stay apart."""
    known = blocks.join(F.broadcast(frequent), "k", "left")  # at most FREQUENT rows
    dealt = known.withColumn("at", F.when(F.col("often").isNotNull(), F.xxhash64("k", "doc_id")).otherwise(F.col("k")))
    by_key = Window.partitionBy("at", "k")
    return dealt.withColumn("m", F.coalesce("often", F.count("*").over(by_key))).drop("at", "often")


def in_parts(blocks: DataFrame, part_sets: int) -> DataFrame:
    """Adds n (how many parts of about ``part_sets`` sets the block has) and part."""
    sizes = blocks.groupBy("k").agg(F.ceil(F.count("*") / F.lit(part_sets)).cast("int").alias("n"))
    return blocks.join(sizes, "k").withColumn("part", F.pmod(F.xxhash64("doc_id", "k"), F.col("n").cast("long")).cast("int"))


def several_components(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """``blocks`` and the component c of each set, where a block holds more than one."""
    placed = blocks.join(found, F.col("doc_id") == F.col("node"), "left")
    placed = placed.select(*blocks.columns, F.coalesce("component", "doc_id").alias("c"))
    ends = placed.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("k")
    return placed.join(ends, "k", "left_semi")


def verify(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity: by size, by the sketches'
    Hamming distance, then by the exact intersection."""
    a = tokens.select(F.col("doc_id").alias("a"), F.col("s").alias("sa"), F.col("p").alias("pa"))
    b = tokens.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"), F.col("p").alias("pb"))
    both = pairs.join(a, "a").join(b, "b")
    small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = (100 * small >= percent * large) & (apart * percent <= (100 - percent) * small)
    same = F.size(F.array_intersect("sa", "sb")).cast("long")
    alike = F.when(near, 100 * same >= percent * (F.size("sa") + F.size("sb") - same)).otherwise(F.lit(False))
    return both.filter(alike).select("a", "b")
