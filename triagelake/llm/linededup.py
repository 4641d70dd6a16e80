"""Removal of repeated passages in content-defined line chunks [native].

``dedup_chunks`` (the query ``op6_``) rolls a hash over the hashes of neighbouring
lines.  A text's borders are where that hash is one that no other place of the corpus
has: what the lines say decides, not where they stand, so lines put in before a chunk
move nothing.  Between borders lies a chunk of two lines or more, each with its
neighbour known from another place; the bytes of the neighbours are compared, and
lines of a chunk go as far as an earlier place has the same ones side by side.  No
number of words matters: a single line never goes, two lines that stand together
again always do.  Lines without a word are no neighbours and go with those before them.
Texts of rows without a chunk are not shuffled again after the first look.

The other functions (the pipeline uses ``keep_first``) cut by a divisor and take words
into account.  Two kinds of passages go (``dedup_passages``; ``dedup_lines`` takes the
first only):

* Chunks.  A rolling hash over the hashes of the last two lines ends a chunk where
  it is 0 modulo ``divisor``, and a long line (50 words or more) ends and begins
  one.  A chunk of two lines or more, or of one long line, that occurs again goes.
* Runs.  Any run of whole lines with 50 words or more that occurs again goes, at
  any length and wherever it begins; lines without a word do not count, and those
  in it and behind it go with it.  Such a run consists of shortest runs of 50 words, each of them
  repeated, too; these are compared (of each line the one that it starts and the
  one that it ends).  In one text, a place that overlaps the first does not count.

The first place stays, in the order of (id, row, line); so each line that goes has
an equal one that stays.  A row is what is staged once, whatever its id: rows of
one id, or of null (after the others), are texts like any others.

Passages are grouped by 128 bits of SHA-256.  Only these, numbers of rows and
lines are shuffled; a passage that a third of the documents share is combined
before the shuffle, and the join on it is one that adaptive execution splits.

Null texts stay null, texts without such passages stay as they are, and a text
whose lines all go becomes empty.  Other columns stay, whatever their names; only
an input column named n_lines or n_removed is replaced where these are returned
(``keep_first`` returns neither).  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.common import stage_table

LAST_ID = 2**63 - 1
HOT_KEYS = 20_000
NEWLINE = "\\n"
#: 128 bits of SHA-256: equal means equal bytes
DIGEST = "substring(unhex(sha2({}, 256)), 1, 16)"


def hold(df: DataFrame, **columns) -> DataFrame:
    """Adds columns behind a generator of one row, which the optimizer does not
    look through: else an array that a lambda reads would be made anew for each
    element."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_id(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("_id", F.coalesce(F.col(key).cast("long"), F.lit(LAST_ID)))


def with_chunks(df: DataFrame, key: str, text: str, divisor: int, long_words: int) -> DataFrame:
    """Adds _id, _lines, _ends (last line number of each chunk) and _chunks
    (struct<h: hash, ok: may be removed>)."""
    ends = f"""
        filter(sequence(1, size(_lines)), i ->
            i = size(_lines) or _long[i - 1] or _long[i]
            or pmod(xxhash64(_hashes[i - 1], if(i > 1, _hashes[i - 2], 0L)), {divisor}L) = 0)"""
    body = "array_join(slice(_lines, if(j > 1, _ends[j - 2], 0) + 1, _ends[j - 1] - if(j > 1, _ends[j - 2], 0)), '\\n')"
    chunks = f"transform(sequence(1, size(_ends)), j -> {body})"
    marked = """
        transform(_bodies, (b, j) -> named_struct(
            'h', """ + DIGEST.format("b") + """,
            'ok', (_ends[j] - if(j > 0, _ends[j - 1], 0) > 1 or _long[_ends[j] - 1]) and b rlike '[^\\\\s]'))"""
    out = with_id(df, key)
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    out = hold(
        out,
        _lines=lines,
        _hashes=F.transform(lines, lambda x: F.xxhash64(x)),
        _long=F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) >= long_words - 1),
    )
    out = hold(out, _ends=F.expr(ends))
    out = hold(out, _bodies=F.expr(chunks))
    return hold(out, _chunks=F.expr(marked))


def with_runs(cut: DataFrame, long_words: int) -> DataFrame:
    """Adds _w (words of each line, up to ``long_words``) and _runs: of each line with a word
    the shortest run of ``long_words`` words that starts with it, and the one that ends with it.

    Equal runs of ``long_words`` words or more consist of such runs, equal in both places."""
    base = long_words + 1  # a run has at most long_words lines with a word: place * base + lines
    count = f"0, (a, x) -> if(a >= {long_words * base}, a, a + x * {base} + 1)"
    starts = f"transform(_k, (w, i) -> named_struct('i', i, 'a', aggregate(slice(_k, i + 1, {long_words}), {count})))"
    ends = f"transform(_k, (w, i) -> named_struct('i', i, 'a', aggregate(slice(_r, size(_k) - i, {long_words}), {count})))"
    full = f"filter({{}}, c -> c.a >= {long_words * base})"
    places = f"""
        array_distinct(concat(
            transform({full.format('_starts')}, c -> c.i * {base}L + c.a % {base}),
            transform({full.format('_back')}, c -> (c.i - c.a % {base} + 1) * {base}L + c.a % {base})))"""
    runs = f"""
        transform(_places, v -> named_struct(
            'h', {DIGEST.format(f"array_join(slice(_b, cast(v div {base} as int) + 1, cast(v % {base} as int)), '{NEWLINE}')")},
            's', _at[cast(v div {base} as int)],
            'e', coalesce(get(_at, cast(v div {base} + v % {base} as int)), size(_lines)) - 1))"""
    out = hold(cut, _w=F.transform("_lines", lambda x: F.least(F.regexp_count(x, F.lit(r"\S+")), F.lit(long_words))))
    out = hold(out, _at=F.expr("filter(sequence(0, size(_w) - 1), i -> _w[i] > 0)"))
    out = hold(out, _k=F.expr("transform(_at, i -> _w[i])"), _b=F.expr("transform(_at, i -> _lines[i])"))
    out = hold(out, _r=F.reverse("_k"))
    out = hold(out, _starts=F.expr(starts), _back=F.expr(ends))
    out = hold(out, _places=F.expr(places))
    return hold(out, _runs=F.expr(runs))


def places(rows: DataFrame, key: str, text: str, divisor: int, long_words: int, runs: bool) -> DataFrame:
    """_id, _row, h, s, e (first and last line) of everything that may go; after: the last line
    of the row's first place of h, at its other places."""
    # under fixed names, so that no column of the input clashes
    base = rows.select(F.col("row").getField(key).alias("id"), F.col("_body").alias("text"), "_row")
    cut = with_chunks(base, "id", "text", divisor, long_words)
    spans = """
        transform(filter(transform(_chunks, (c, j) -> named_struct('h', c.h, 's', if(j > 0, _ends[j - 1], 0), 'e', _ends[j] - 1, 'ok', c.ok)),
            c -> c.ok{}), c -> named_struct('h', c.h, 's', c.s, 'e', c.e))"""
    if runs:
        # chunks of long_words words or more consist of runs
        short = f" and aggregate(slice(_w, c.s + 1, c.e - c.s + 1), 0, (a, x) -> a + x) < {long_words}"
        cut, spans = with_runs(cut, long_words), f"concat(_runs, {spans.format(short)})"
    else:
        spans = spans.format("")
    cut = hold(cut, _o=F.array_sort(F.expr(spans)))
    cut = hold(cut, _oh=F.expr("transform(_o, c -> c.h)"))
    first_end = "_o[cast(array_position(_oh, c.h) as int) - 1].e"
    each = f"transform(_o, (c, i) -> named_struct('h', c.h, 's', c.s, 'e', c.e, 'after', if(i > 0 and _oh[i - 1] = c.h, {first_end}, null)))"
    return cut.select("_id", "_row", F.explode(F.expr(each)).alias("c")).select("_id", "_row", "c.*")


def _cleaned(df: DataFrame, key: str, text: str, divisor: int, long_words: int, runs: bool) -> DataFrame:
    """row (the input's columns but the text), _text, n_lines and n_removed."""
    spark = df.sparkSession
    packed = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text]).alias("row")
    rows = stage_table(spark, df.select(packed, F.col(text).alias("_body"), F.monotonically_increasing_id().alias("_row")), "rows")
    refs = stage_table(spark, places(rows, key, text, divisor, long_words, runs), "places")
    repeated = refs.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("_id", "_row")).alias("first")).filter("n > 1")
    gone = refs.join(repeated.select("h", F.col("first._row").alias("first_row")), "h").filter("_row <> first_row or s > after")
    gone = gone.groupBy("_row").agg(F.collect_list(F.struct("s", "e")).alias("_gone"))

    body = F.col("_body")
    full = hold(rows.join(gone, "_row", "left"), _lines=F.split(F.coalesce(body, F.lit("")), "\n", -1))
    kept = "array_except(sequence(0, size(_lines) - 1), flatten(transform(_gone, g -> sequence(g.s, g.e))))"
    full = hold(full, _kept=F.when(F.col("_gone").isNotNull(), F.expr(kept)))
    full = hold(full, _text=F.when(F.col("_kept").isNull(), body).otherwise(F.expr("array_join(transform(_kept, i -> _lines[i]), '\\n')")))
    return full.select(
        "row", "_text", F.size("_lines").cast("long").alias("n_lines"),
        F.when(F.col("_kept").isNull(), 0).otherwise(F.size("_lines") - F.size("_kept")).cast("long").alias("n_removed"),
    )


def _columns(df: DataFrame, text: str) -> list:
    return [(F.col("_text") if c == text else F.col("row").getField(c)).alias(c) for c in df.columns]


# ---- chunks between borders where the rolling hash is nowhere else -------------

def with_neighbours(df: DataFrame) -> DataFrame:
    """Adds to a column _body _lines and _at (the places of lines with a word)."""
    out = hold(df, _lines=F.split(F.coalesce(F.col("_body"), F.lit("")), "\n", -1))
    return hold(out, _at=F.expr(r"filter(sequence(0, size(_lines) - 1), i -> _lines[i] rlike '\\S')"))


def rolled(rows: DataFrame, hash_bits: int) -> DataFrame:
    """_id, _row, i, h: the rolling hash of each line with a word (the i-th) and the next."""
    out = hold(with_neighbours(rows), _hashes=F.expr("transform(_at, i -> xxhash64(_lines[i]))"))
    both = lambda i: F.xxhash64(F.get("_hashes", i - 1), F.get("_hashes", i))
    each = F.transform(F.sequence(F.lit(1), F.size("_at") - 1), lambda i: F.shiftrightunsigned(both(i), 64 - hash_bits))
    return out.filter(F.size("_at") > 1).select("_id", "_row", F.posexplode(each).alias("i", "h"))


def meet(rows: DataFrame, keyed: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``keyed`` (a staged table of ``on`` and n, how many of the rows have
    it).  Keys of more than 1/20,000 of these rows, fewer than 20,000, go to all tasks, so
    no task gets all rows of a frequent one; the others are shuffled."""
    total = keyed.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(keyed.filter(F.col("n") * HOT_KEYS > total))
    others = rows.join(hot.select(*on), on, "left_anti").join(keyed.filter(F.col("n") * HOT_KEYS <= total), on)
    return rows.join(hot, on).unionByName(others)


def _unchained(df: DataFrame, key: str, text: str, hash_bits: int) -> DataFrame:
    """row (the input's columns but the text), _text, n_lines and n_removed."""
    spark = df.sparkSession
    packed = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text]).alias("row")
    rows = stage_table(spark, with_id(df, key).select(packed, "_id", F.col(text).alias("_body"), F.monotonically_increasing_id().alias("_row")), "rows")
    refs = stage_table(spark, rolled(rows.select("_id", "_row", "_body"), hash_bits), "neighbours")
    known = stage_table(spark, refs.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "known")
    chunks = meet(refs, known, ["h"]).groupBy("_row").agg(F.collect_list(F.struct("i", "h")).alias("_near"))
    marked = stage_table(spark, rows.join(chunks, "_row", "left"), "marked")

    near = with_neighbours(marked.filter("_near is not null"))
    spots = near.select("_id", "_row", F.explode("_near").alias("c"), "_lines", "_at").select(
        "_id", "_row", "c.i", "c.h", F.expr("_lines[_at[c.i]] || '\n' || _lines[_at[c.i + 1]]").alias("bytes"))
    # one hash, one pair of lines: the aggregation compares their bytes
    clashes = stage_table(spark, spots.select("h", "bytes").distinct().groupBy("h").count().filter("count > 1").select("h"), "clashes")
    if clashes.isEmpty():
        spots, same = marked.select("_id", "_row", F.explode("_near").alias("c")).select("_id", "_row", "c.*"), ["h"]
    else:
        told = spots.join(clashes.withColumn("clash", F.lit(True)), "h", "left")
        spots, same = told.withColumn("bytes", F.when(F.col("clash"), F.col("bytes")).otherwise("")).drop("clash"), ["h", "bytes"]
    first = spots.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("_id", "_row", "i")).alias("first")).filter("n > 1")
    first = stage_table(spark, first.select(*same, "n", F.col("first._row").alias("first_row"), F.col("first.i").alias("first_i")), "first")
    gone = meet(spots, first, same).filter("_row <> first_row or i > first_i + 1").groupBy("_row").agg(F.collect_list("i").alias("_gone"))

    cut = with_neighbours(marked.filter("_near is not null").drop("_near").join(gone, "_row", "left"))
    out = "flatten(transform(_gone, i -> sequence(_at[i], coalesce(get(_at, i + 2), size(_lines)) - 1)))"
    cut = hold(cut, _kept=F.when(F.col("_gone").isNotNull(), F.expr(f"array_except(sequence(0, size(_lines) - 1), {out})")))
    n = F.size("_lines").cast("long")
    left = F.when(F.col("_kept").isNull(), F.col("_body")).otherwise(F.expr("array_join(transform(_kept, i -> _lines[i]), '\n')"))
    cut = cut.select("row", left.alias("_text"), n.alias("n_lines"), F.when(F.col("_kept").isNull(), 0).otherwise(n - F.size("_kept")).cast("long").alias("n_removed"))
    whole = marked.filter("_near is null")
    n = F.size(F.split(F.coalesce(F.col("_body"), F.lit("")), "\n", -1)).cast("long")
    return cut.unionByName(whole.select("row", F.col("_body").alias("_text"), n.alias("n_lines"), F.lit(0).cast("long").alias("n_removed")))


def dedup_chunks(df: DataFrame, key: str = "doc_id", text: str = "text", hash_bits: int = 64) -> DataFrame:
    """``df`` with what repeats of its multi-line chunks taken out of ``text``, n_lines (of the
    input) and n_removed (lines taken out).  ``hash_bits`` (up to 64) has no effect on the result."""
    df = df.drop("n_lines", "n_removed")
    return _unchained(df, key, text, hash_bits).select(*_columns(df, text), "n_lines", "n_removed")


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", divisor: int = 3, long_words: int = 50, runs: bool = False) -> DataFrame:
    """``df`` with the repeated chunks (with ``runs``, and the repeated runs) taken out of
    ``text``, n_lines (of the input) and n_removed (lines taken out)."""
    df = df.drop("n_lines", "n_removed")
    return _cleaned(df, key, text, divisor, long_words, runs).select(*_columns(df, text), "n_lines", "n_removed")


def dedup_passages(df: DataFrame, key: str = "doc_id", text: str = "text", divisor: int = 3, long_words: int = 50) -> DataFrame:
    """``dedup_lines`` that takes out all repeated runs, too."""
    return dedup_lines(df, key, text, divisor, long_words, runs=True)


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", divisor: int = 3, long_words: int = 50) -> DataFrame:
    """The columns of ``df``, with ``text`` as ``dedup_passages`` leaves it; rows that lose
    lines and have no word left go."""
    cleaned = _cleaned(df, key, text, divisor, long_words, True)
    return cleaned.filter((F.col("n_removed") == 0) | F.col("_text").rlike(r"\S")).select(*_columns(df, text))
