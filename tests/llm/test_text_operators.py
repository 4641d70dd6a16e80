"""Sharding, line dedup, Jaccard join, quality, toxicity and URLs against plain loops."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plain_passages import clean
from triagelake.llm import jaccard, linededup, quality, shards, toxicity, urls

SF = "/root/testdata/sf0.001"


# ---- sharding ----------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(spark, n):
    assert sorted(shards.permute(x, n, 5) for x in range(n)) == list(range(n))
    got = [r[0] for r in spark.range(n).select(F.expr(shards.permuted_sql("id", n, 5))).collect()]
    assert got == [shards.permute(x, n, 5) for x in range(n)]


def test_shards(spark, odd_docs):
    rows = shards.assign_shards(odd_docs, n_shards=4, seed=9).collect()
    n = odd_docs.count()
    assert sorted(r.row_number for r in rows) == list(range(n))
    for r in rows:
        assert (r.shard, r.slot) == (shards.permute(r.row_number, n, 9) % 4, shards.permute(r.row_number, n, 9) // 4)
    per = collections.defaultdict(list)
    for r in rows:
        per[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    want = sorted((repr(r.doc_id), len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect())
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    again = shards.assign_shards(odd_docs.repartition(3), n_shards=4, seed=9).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    assert shards.assign_shards(odd_docs.limit(0)).count() == 0


# ---- line dedup --------------------------------------------------------------

def test_line_dedup(spark, odd_docs):
    for docs in (odd_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        got = linededup.dedup_lines(docs)
        assert set(docs.columns) | {"n_lines", "n_removed"} == set(got.columns)
        rows = sorted(((linededup.LAST_ID if r.doc_id is None else r.doc_id, r.text) for r in got.collect()), key=repr)
        plain = sorted(((linededup.LAST_ID if r.doc_id is None else r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
        assert rows == sorted(clean(plain, runs=False), key=repr)
    assert linededup.dedup_lines(odd_docs.limit(0)).count() == 0


def test_long_passage_goes_wherever_it_stands(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"own line {i}\n{'extra %d' % i}\n{passage}\nend {i}") for i in range(30)] + [(99, passage)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert passage in got[0] and not any(passage in got[i] for i in [*range(1, 30), 99])
    assert all(f"own line {i}" in got[i] and f"end {i}" in got[i] for i in range(30))


# ---- Jaccard -----------------------------------------------------------------

def brute_components(docs, n, percent):
    sets = collections.defaultdict(list)
    for r in docs.collect():
        w = re.findall(rb"[^\x20\x09-\x0d]+", (r.text or "").encode().lower())
        sets[r.doc_id].append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    nodes = [(d, s) for d, own in sets.items() for s in own]
    up = {d: d for d in sets if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(nodes):
        for b, t in nodes[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in nodes), key=repr)


def test_jaccard_join(spark, odd_docs):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    near = []
    for g in range(6):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 8, 40, 150]))]
        for k in range(15):
            t = list(base)
            for _ in range(rnd.randint(0, 4)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            near.append((1000 + 100 * g + k, " ".join(t)))
    made = spark.createDataFrame(near, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    for docs, n, percent in ((made, 4, 85), (made, 5, 80), (spark.read.parquet(f"{SF}/documents.parquet"), 4, 85)):
        got = jaccard.jaccard_join(docs, n, percent)
        assert sorted(map(tuple, got.collect()), key=repr) == brute_components(docs, n, percent)
    assert jaccard.jaccard_join(odd_docs.limit(0)).count() == 0


def test_jaccard_with_frequent_keys_and_parted_blocks(spark, monkeypatch):
    """A passage that all texts share, and blocks that keep many components: frequent keys
    and parts of blocks lose no link."""
    monkeypatch.setattr(jaccard, "SAMPLE", 2)
    monkeypatch.setattr(jaccard, "FREQUENT", 10**9)
    rnd = random.Random(12)
    head = " ".join(f"h{i}" for i in range(40))
    rows = []
    for i in range(120):
        own = " ".join(f"o{i // 3}x{j}" for j in range(rnd.choice([2, 4, 30])))
        rows.append((i, f"{head} {own}" if i % 4 else own))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = spark.createDataFrame([(i, [7, i], 2) for i in range(100)], "doc_id long, keys array<bigint>, n_keys long")
    assert [r.k for r in jaccard.frequent_keys(made).collect()] == [7]
    want = brute_components(docs, 4, 85)
    for rounds, part_sets in ((1, 7),):
        sets, links = jaccard.jaccard_links(docs, 4, 85, rounds=rounds, part_sets=part_sets)
        found = dict(jaccard.components(links).collect())
        assert sorted(((r.doc_id, r.n_shingles, found.get(r.doc_id, r.doc_id)) for r in sets.collect()), key=repr) == want


def test_blocks_keep_every_similar_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        size = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        most = jaccard.differences(len(a), 85)
        b = np.unique(np.concatenate([a[int(rng.integers(0, most // 2 + 1)):], rng.integers(0, 2**63, most // 2).astype(np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if 100 * inter < 85 * (len(a) + len(b) - inter):
            continue
        ka, kb = ({g: (need, set(k.tolist())) for g, need, k in jaccard.block_keys(x, 85)} for x in (a, b))
        assert any(len(ka[g][1] & kb[g][1]) >= max(ka[g][0], kb[g][0]) for g in ka.keys() & kb.keys()), (size, len(b))


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(80)]
    got = dict(jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect())
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    assert all(got.get(x, x) == find(x) for x in up)


# ---- quality -----------------------------------------------------------------

def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked)


def brute_labels(crf, x):
    best, out = -1e18, None
    for code in range(2 ** len(x)):
        y = [code >> i & 1 for i in range(len(x))]
        s = sum(f @ crf.weights for f, v in zip(x, y) if v) + sum(crf.move[a, b] for a, b in zip(y, y[1:]))
        if s > best + 1e-12:
            best, out = s, y
    return out


def test_quality_counts_and_viterbi(spark, odd_docs):
    crf = quality.LineCrf()
    texts = [r.text for r in odd_docs.collect()] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(80).collect()]
    for t in texts:
        counts, x, sizes = quality.document(t)
        assert counts == plain_counts(t) and sizes.sum() == counts[0]
        if 0 < len(x) <= 10:
            assert crf.labels(x).tolist() == brute_labels(crf, x)
    got = {repr((r.doc_id, r.n_words, r.base_failed)) for r in quality.judge(odd_docs).collect()}
    want = set()
    for r in odd_docs.collect():
        c = plain_counts(r.text)
        want.add(repr((r.doc_id, c[0], c[0] < 50 or 100 * c[4] > 50 * c[0])))
    assert got == want
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert quality.judge(odd_docs.limit(0)).count() == 0
    lines = quality.label_lines(odd_docs).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in lines} == {r.doc_id for r in odd_docs.collect()}


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels, max_train_docs=100)
    got = quality.judge(docs, model).join(labels, "doc_id").filter("not base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in got]) > 0.97
    assert quality.train(docs, labels.limit(0)).weights.tolist() == quality.PRIOR.tolist()


# ---- toxicity ----------------------------------------------------------------

def test_toxicity(spark, odd_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.ToxicityModel(docs, labels, max_train_docs=3000)
    got = model.score(docs.select("doc_id", "text"), ["doc_id"]).join(labels, "doc_id")
    held = got.filter(toxicity.is_held_out("doc_id")).collect()
    good, bad = ([r.score for r in held if r.toxic == y] for y in (0, 1))
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.97 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in held)
    odd = model.score(odd_docs.select("doc_id", "text"), ["doc_id"])
    assert odd.count() == odd_docs.count() and odd.filter("score is null").count() == 0
    none = toxicity.score_documents(odd_docs, labels.limit(0)).collect()
    assert len(none) == odd_docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in none)
    assert toxicity.drop_toxic(odd_docs, labels.limit(0)).columns == odd_docs.columns


def test_toxic_features():
    f = dict(zip(toxicity.FEATURES, toxicity.features("You are an 1d10t, LOSER!!")))
    assert f["any_insult"] == 2 and f["near_person"] > 0 and f["capitals"] > 0.2 and f["hidden"] > 0
    assert toxicity.features(None) == toxicity.features("") and not any(toxicity.features(""))


# ---- URLs --------------------------------------------------------------------

def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group(0)
    path = re.match(r"[^?#]*", rest[len(host):]).group(0)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def test_urls(spark):
    odd = [(1, None), (2, ""), (3, "no scheme/en/"), (4, "HTTP://A.Example.COM/en/71?x#y"), (5, "http://com/en/"), (6, "http://notcom/en/"),
           (7, "x://ÀB.net/de/8#a"), (8, "http://example.net/de/8"), (9, "a://b://c/d"), (10, "http://h\n.org/es/\nz?q"), (None, "http://casino.net/free-bonus/1"), (1, None)]
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = collections.Counter()
    for r in urls.judge_urls(spark.createDataFrame(odd + pages, "page_id long, url string")).collect():
        got[(r.page_id, r.host, r.path, r.rule, r.verdict)] += 1
        if r.rule is None:
            assert r.verdict == ("block" if r.score >= 0.5 else "allow")
    want = collections.Counter()
    for i, u in odd + pages:
        host, path = plain_url(u)
        fit = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[(i, host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else None)] += 1
    assert collections.Counter({(a, b, c, d): n for (a, b, c, d, _), n in got.items()}) == collections.Counter({(a, b, c, d): n for (a, b, c, d, _), n in want.items()})
    assert all(v == w[4] for w in want if w[4] for (a, b, c, d, v) in got if (a, b, c, d) == w[:4])
    model = urls.UrlModel(urls.labelled_urls(spark))
    table = urls.labelled_urls(spark)
    right = model.score(table).filter((F.col("score") >= 0.5).cast("int") == F.col("blocked")).count()
    assert right > 0.95 * table.count()


def test_url_rules_by_the_contract(spark):
    """Each rule's own word, written out here, at its host and a subdomain; the longest wins."""
    want = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    rows = [(i, f"http://{sub}{rule}") for i, rule in enumerate(want) for sub in ("", "casino.", "a.b.")]
    got = [(r.rule, r.verdict) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()]
    assert collections.Counter(got) == collections.Counter({pair: 3 for pair in want.items()})


def murmur3(data: bytes, seed: int = 42) -> int:
    """The 32-bit hash by its published definition, signed."""
    m, h = 0xFFFFFFFF, seed
    turn = lambda x, r: ((x << r) | (x >> (32 - r))) & m
    blend = lambda k: turn(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    for i in range(0, len(data) - len(data) % 4, 4):
        h = (turn(h ^ blend(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & m
    h ^= blend(int.from_bytes(data[len(data) - len(data) % 4 :], "little")) if len(data) % 4 else 0
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & m
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_url_scores_against_plain_sums(spark):
    """The model's half of a verdict: n-grams, their hashes and the logistic sum in plain
    Python; a table that has columns named as the model's own; an empty table."""
    model = urls.UrlModel(urls.labelled_urls(spark))
    weights, bias, n = model.model.coefficients.toArray(), model.model.intercept, len(model.model.coefficients)
    cases = [None, "", "no scheme", "http://", "https://Casino.EXAMPLE.net/de/8?x#y", "ftp://a.b/é\u3000/ü", "http://x/" + "long/" * 3000, "http://x", "http://x"]
    df = spark.createDataFrame([(i, u, "s", "g", 1.0) for i, u in enumerate(cases)], "page_id long, url string, score string, grams string, prediction double")
    got = {r.page_id: r for r in urls.judge_urls(df).collect()}
    assert len(got) == len(cases)
    for i, u in enumerate(cases):
        rest = (u or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        grams = [m + g[k : k + 3] for m, g in (("h:", f"^{host}$"), ("p:", f"^{path}$")) for k in range(max(1, len(g) - 2))]
        z = bias + sum(weights[murmur3(g.encode()) % n] for g in grams)
        want = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
        assert (got[i].host, got[i].path) == (host, path)
        assert abs(got[i].score - want) < 1e-6, (u, got[i].score, want)
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_urls_of_unseen_hosts(spark):
    right = urls.held_out_accuracy(urls.labelled_urls(spark))
    print(right)
    assert min(right.values()) >= 0.9
