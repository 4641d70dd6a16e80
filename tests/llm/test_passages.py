"""Repeated runs of lines against plain loops over all runs, and rows of one id or of none."""

import collections
import random

from pyspark.sql import functions as F

import corpus_pipeline

from plain_passages import clean, neighbour_lines_that_go
from triagelake.llm import linededup, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def check(spark, texts):
    """The texts as plain loops over all chunks and all runs leave them."""
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    want = dict(clean(list(enumerate(texts)), runs=True))
    got = {r.doc_id: r for r in linededup.dedup_passages(made).collect()}
    for d, text in enumerate(texts):
        assert got[d].text == want[d], d
        left = len(want[d].split("\n")) if got[d].n_removed < got[d].n_lines else 0
        assert got[d].n_lines == len(text.split("\n")) and got[d].n_removed == got[d].n_lines - left
    return {d: r.text for d, r in got.items()}


def test_runs_of_short_lines_go(spark):
    """Passages of over 50 words in lines of under 50, planted in unrelated texts."""
    rnd = random.Random(5)
    line = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    for n_lines, n_words in ((2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (8, 8), (55, 1)):
        passage = "\n".join(line(n_words) for _ in range(n_lines))
        texts = ["\n".join([*(line(9) for _ in range(rnd.randint(1, 4))), passage, *(line(9) for _ in range(rnd.randint(0, 3)))]) for _ in range(8)]
        got = check(spark, texts)
        assert passage in got[0]
        kept = [set(passage.split("\n")) & set(got[d].split("\n")) for d in range(1, 8)]
        assert not any(kept), (n_lines, n_words)


def test_runs_against_all_runs(spark):
    rnd = random.Random(6)
    pool = [" ".join(f"p{i}x{j}" for j in range(rnd.choice([1, 5, 12, 25, 49, 60]))) for i in range(12)] + ["", "  "]
    check(spark, ["\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 25))) for _ in range(40)])
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    check(spark, [r.text for r in docs.collect()])


def test_each_line_that_goes_has_one_that_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = linededup.dedup_passages(docs).collect()
    left = {x for r in rows for x in r.text.split("\n")}
    assert {x for r in docs.collect() for x in r.text.split("\n")} - left <= {""}
    assert linededup.dedup_passages(docs.limit(0)).count() == 0
    assert linededup.dedup_passages(spark.createDataFrame([(1, None), (None, None)], SCHEMA)).filter(F.col("text").isNull() & (F.col("n_removed") == 0)).count() == 2


def test_near_duplicates_of_one_id_or_none(spark):
    """One row of each group stays, though rows share an id or have none."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(80)) for x in "abcd")
    rows = [(7, a), (7, a), (7, a + " z"), (7, b), (3, b), (None, c), (None, c), (None, c + " z"), (None, a), (None, d), (9, d), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    alike = collections.Counter((r.doc_id, (r.text or "")[:1]) for r in got)
    assert alike == {(7, "a"): 1, (3, "b"): 1, (None, "c"): 1, (9, "d"): 1, (None, ""): 2}


def test_passages_of_one_id_or_none(spark):
    """A passage that only rows of one id share, or rows without an id, stays in one of them."""
    long, hot = (" ".join(f"{x}{i}" for i in range(60)) for x in "nh")
    rows = [(None, f"own {i}\n{long}\nend {i}") for i in range(6)] + [(5, f"my {i}\n{hot}\nend {i}") for i in range(6)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [r.text for r in linededup.dedup_lines(docs).collect()]
    assert sum(long in t for t in got) == sum(hot in t for t in got) == 1
    assert len(got) == 12 and sum(t.startswith(("own ", "my ")) for t in got) == 12


CLASHES = ["id", "_id", "row", "_row", "h", "s", "e", "_lines", "_ends", "_gone", "_kept", "_text", "at", "after", "x", "p", "features", "prediction",
           "probability", "rawPrediction", "n_shingles", "component_id", "k", "band", "node", "doc", "size", "score", "kept", "N_LINES", "n_removed"]


def stage_input(spark, rows):
    """documents with columns of every name that the stages use themselves."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


def test_stages_with_nulls_ties_and_clashing_names(spark):
    """Rows keep their other columns; null, empty, blank and repeated rows have the result stated."""
    word = lambda *at: "".join(chr(97 + int(c)) for c in "".join(map(str, at)))
    text = lambda x, n=70: "\n".join(" ".join(x + word(i, j) for j in range(7)) + "." for i in range(n // 7))
    rows = [(1, text("a"), 5), (1, text("a"), 6), (None, text("b"), 7), (None, text("b"), 8), (2, text("c") + "\n \n\n", 9), (3, text("c"), 1),
            (4, None, None), (None, None, None), (5, "", 0), (6, " \n\t\n", 3), (7, text("d", 40000), 2)]
    docs, empty = stage_input(spark, rows), stage_input(spark, [])
    left = {
        "quality": [1, 1, 2, 3, 7, None, None], "toxicity": [1, 1, 2, 3, 4, 5, 6, 7, None, None, None],
        "line_dedup": [1, 2, 4, 5, 6, 7, None, None], "near_duplicates": [1, 2, 4, 5, 6, 7, None, None],
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = out.collect()
        assert sorted((r.doc_id for r in got), key=lambda x: (x is None, x)) == left[name], name
        assert all(r[c] == f"own {c}" for r in got for c in CLASHES)
        assert stage(spark, empty, SF).count() == 0
    packed = corpus_pipeline.pack_sequences(spark, docs, SF)
    assert packed.filter("start = 0").count() == len(rows) and corpus_pipeline.pack_sequences(spark, empty, SF).count() == 0


def test_columns_that_are_not_asked_for(spark):
    """Any choice of the result's columns can be taken."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    cleaned = linededup.dedup_passages(docs)
    for columns in (["doc_id", "text", "n_lines", "n_removed"], ["n_removed"], ["lang"], ["text"], ["doc_id"]):
        assert len(cleaned.select(*columns).collect()) == n
    assert len(queries.op6_line_dedup(spark, SF).collect()) == n
    assert len(corpus_pipeline.line_dedup(spark, docs, SF).select("doc_id").collect()) <= n


def test_stages_delete_what_earlier_ones_staged(spark, tmp_path):
    """A stage whose input was written drops the tables before it; one that still reads them does not."""
    from triagelake.llm.common import staged_tables

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    stages = dict(corpus_pipeline.STAGES)
    stages["line_dedup"](spark, docs, SF).write.parquet(f"{tmp_path}/a")
    mine = set(staged_tables()) & set(corpus_pipeline._of_stages)
    lazy = stages["near_duplicates"](spark, spark.read.parquet(f"{tmp_path}/a"), SF)
    assert mine and not mine & set(staged_tables())
    n = lazy.count()
    assert stages["quality"](spark, lazy, SF).count() <= n and lazy.count() == n


def check_chunks(spark, texts, **bits):
    """The texts as a plain loop over all neighbouring lines leaves them."""
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    gone = neighbour_lines_that_go(texts)
    got = {r.doc_id: r for r in linededup.dedup_chunks(made, **bits).collect()}
    assert len(got) == len(texts)
    for d, text in enumerate(texts):
        lines = text.split("\n")
        left = [x for i, x in enumerate(lines) if (d, i) not in gone]
        assert (got[d].text, got[d].n_lines, got[d].n_removed) == ("\n".join(left), len(lines), len(lines) - len(left)), d
    return {d: r.text for d, r in got.items()}


def test_chunks_against_all_neighbours(spark):
    rnd = random.Random(8)
    pool = [" ".join(f"p{i}x{j}" for j in range(rnd.choice([1, 5, 12, 49, 60]))) for i in range(30)] + ["", "  "]
    texts = ["\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 12))) for _ in range(60)]
    texts += ["a a\na a\na a\na a\na a", "", "\n", "\n \n" + texts[0] + "\n\n", texts[1]]
    check_chunks(spark, texts)
    check_chunks(spark, texts, hash_bits=6)  # most hashes belong to several pairs of lines
    check_chunks(spark, [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()])


def test_chunks_know_no_number_of_words(spark):
    """A repeated line of 49 and one of 50 words fare alike, alone and with a neighbour."""
    rnd = random.Random(9)
    line = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    for n in (1, 49, 50, 200):
        one, two = line(n), line(n)
        alone = check_chunks(spark, [f"{line(6)}\n{one}\n{line(6)}" for _ in range(3)])
        assert all(one in alone[d] for d in range(3))
        both = check_chunks(spark, [f"{line(6)}\n{one}\n{two}\n{line(6)}" for _ in range(3)])
        assert one in both[0] and not any(x in both[d].split("\n") for d in (1, 2) for x in (one, two))


def test_planted_passages_in_chunks(spark):
    """Passages of over 50 words go at any number of lines from two, whatever stands around."""
    rnd = random.Random(10)
    line = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    for n_lines, n_words in ((2, 30), (3, 20), (5, 12), (55, 1)):
        passage = "\n".join(line(n_words) for _ in range(n_lines))
        texts = ["\n".join([*(line(9) for _ in range(rnd.randint(0, 4))), passage, *(line(9) for _ in range(rnd.randint(0, 3)))]) for _ in range(8)]
        got = check_chunks(spark, texts)
        assert passage in got[0]
        assert [got[d] for d in range(1, 8)] == [t.replace(passage, "").replace("\n\n", "\n").strip("\n") for t in texts[1:]]


def test_chunks_of_odd_rows(spark):
    """Nulls in both columns, repeated rows and ids, clashing names, an empty table."""
    text = "one a\ntwo b\nthree c"
    rows = [(5, text, 1), (5, text, 2), (None, text, 3), (None, None, 4), (6, None, 5), (7, "", 6), (8, "x\n" + text, 7)]
    df = stage_input(spark, rows)
    got = linededup.dedup_chunks(df)
    assert got.columns == [c for c in df.columns if c.lower() not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    got = sorted(got.collect(), key=lambda r: r.n_chars)
    assert [r.text for r in got if r.n_chars > 2] == ["", None, None, "", "x"] and sorted(r.text for r in got[:2]) == ["", text]
    assert linededup.dedup_chunks(df.limit(0)).count() == 0
