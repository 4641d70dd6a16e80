"""Many patterns at once: Aho-Corasick automata over dealt parts of the patterns.

Texts meet each part of at most about ``PART`` patterns; a task builds its part's
automaton and reads each of its texts once.  What is asked is the best match of a text or
of a pattern, so a task keeps one row for each, however many matches there are.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.sources.staging import staged

#: Patterns of a part; texts of a bucket at most and, where there are tasks enough, at least.
PART, MOST_TEXTS, LEAST_TEXTS = 100_000, 500_000, 1000


def automaton(names: list[str], ids: list) -> ahocorasick.Automaton:
    """Of each name the smallest id; values: (length, name, id)."""
    least: dict[str, object] = {}
    for name, one in zip(names, ids):
        if name not in least or one < least[name]:
            least[name] = one
    out = ahocorasick.Automaton()
    for name, one in least.items():
        out.add_word(name, (len(name), name, one))
    out.make_automaton()
    return out


def grid(n_texts: int, n_patterns: int, tasks: int) -> tuple[int, int]:
    """Parts of the patterns and buckets of the texts: as few as memory and ``tasks`` ask for,
    because each bucket builds the automaton of each part, and each part reads each text."""
    parts = max(1, -(-n_patterns // PART))
    return parts, max(1, -(-n_texts // MOST_TEXTS), min(-(-tasks // parts), -(-n_texts // LEAST_TEXTS)))


def _meet(texts: DataFrame, patterns: DataFrame, of_text: bool) -> DataFrame:
    """texts: tid, tname; patterns: pid, pname (no nulls, not empty).  tid, pid, pname: of
    each text its longest pattern, then the first by name and id; or, not ``of_text``,
    pid, tid, tname: of each pattern the longest text that holds it.  Equal names meet once."""
    asked, given = (texts, patterns) if of_text else (patterns, texts)
    whose, key, other, name = ("tid", "tname", "pid", "pname") if of_text else ("pid", "pname", "tid", "tname")
    asked_names = staged(asked.select(key).distinct(), "names")
    given_names = staged(given.groupBy(name).agg(F.min(other).alias(other)), "names")
    t, p = (asked_names, given_names) if of_text else (given_names, asked_names)
    parts, buckets = grid(t.count(), p.count(), int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    t = t.withColumn("bucket", F.pmod(F.xxhash64("tname"), F.lit(buckets)).cast("int")).withColumn("part", each(parts))
    p = p.withColumn("part", F.pmod(F.xxhash64("pname"), F.lit(parts)).cast("int")).withColumn("bucket", each(buckets))
    schema = f"{key} string, {other} {given.schema[other].dataType.simpleString()}, {name} string"

    def find(read: pa.Table, known: pa.Table) -> pa.Table:
        names, patterns_here = read.column("tname").to_pylist(), known.column("pname").to_pylist()
        ids = read.column("tid").to_pylist() if not of_text else names
        best: dict = {}
        if len(read) and len(known):
            tree = automaton(patterns_here, known.column("pid").to_pylist() if of_text else patterns_here)
            for text, one in zip(names, ids):
                for _, (size, pattern, pattern_id) in tree.iter(text):
                    mine, rank = (text, (-size, pattern, pattern_id)) if of_text else (pattern, (-len(text), text, one))
                    if mine not in best or rank < best[mine]:
                        best[mine] = rank
        kind = (known if of_text else read).schema.field(other).type
        return pa.table({key: pa.array(best, pa.string()), other: pa.array([r[2] for r in best.values()], kind), name: pa.array([r[1] for r in best.values()], pa.string())})

    found = t.groupBy("part", "bucket").cogroup(p.groupBy("part", "bucket")).applyInArrow(find, schema)
    rank = F.struct((-F.length(name)).alias("n"), F.col(name), F.col(other))
    of_name = found.groupBy(key).agg(F.min(rank).alias("_best"))
    return asked.join(of_name, key).groupBy(whose).agg(F.min("_best").alias("_best")).select(whose, f"_best.{other}", f"_best.{name}")


def longest_pattern(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """tid, pid, pname: of each text the longest pattern in it (then by name and id)."""
    return _meet(_sound(texts, "tid", "tname"), _sound(patterns, "pid", "pname"), True)


def longest_text(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """pid, tid, tname: of each pattern the longest text that holds it (then by name and id)."""
    return _meet(_sound(texts, "tid", "tname"), _sound(patterns, "pid", "pname"), False)


def _sound(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.select(key, name).filter(F.col(key).isNotNull() & (F.length(name) > 0))
