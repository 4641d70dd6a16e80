"""Repair of conversations: the cheapest edits that give ``system? (user assistant)+`` or nothing.

A row is blank (no character besides ``\\x20\\x09-\\x0D``), else a duplicate (its role and
text were seen earlier in the conversation), else truncated (its last such character is
none of ``.!?``), else sound.  Edits: Keep (0), Rerole to user or assistant (3), Delete (4;
blank and duplicate rows must go), Insert an empty text of user or assistant anywhere (3);
a truncated row that stays adds 3.  Of the cheapest edits those with the least audit (the
edits' initials in order, by ASCII) are taken.

The search is a depth-first branch and bound with an explicit stack.  Edits are tried in
the order of their letters, so prefixes come in the order of audits.  A suffix bound adds
what each row costs at least and, over disjoint neighbours that cannot both stay as they
are, what parting them costs at least.  The incumbent (cost, audit) starts from one greedy
pass; at each node (rows consumed, role before) a table keeps the least cost that got
there, and a later prefix that is not cheaper is dominated (its audit is larger: prefixes
of one node and one cost have as many letters as each other).  The end of the stack proves
the incumbent.

Conversations of at most ``block_rows`` rows are solved whole, by one task each, with one
shuffle.  A longer one is parted into blocks of consecutive rows: each block is searched
for every pair of roles before and after it, in tasks of its own, and the blocks' audits
are chained from the last to the first, which gives the same edits as one search.  Its
audit (a letter for each row) must fit in one task; its texts stream by to be hashed.

Rows count by turn, null turns first, then by role and text.  A null role or text is one
space.  A role with another initial than s, u or a, or without a letter, is never kept.
A null conversation id is a conversation of its own.  Only the named columns are read.  An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.llm.common import bound_batches, slices, stage_table

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
SPACES = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: Role before: none, system, user, assistant; where a kept initial leads, and what may be put in.
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = (USER, USER, ASSISTANT, USER)
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = ("", "system", "user", "assistant")
LEGAL = {"su", "ua", "au"}
WHOLE, EARLY = frozenset({START, ASSISTANT}), frozenset({START, SYSTEM})
LARGEST = 2**63 - 1


# ---- the search --------------------------------------------------------------

class Suffixes:
    """Lower bounds of the cost of rows from a place on, given the role before them."""

    def __init__(self, rows: list[tuple[str, int, int]], ends: frozenset[int]):
        n = len(rows)
        self.ends, self.fixed, self.first, self.gone = ends, [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        chain: list[tuple[str, int]] = []  # from the last: initial ('' if it can't stay) and the least further cost of changing it
        pairs = [0]  # by the number of rows in the chain: what its disjoint pairs cost at least
        self.pairs, self.chain = pairs, chain
        for i in range(n - 1, -1, -1):
            initial, fault, extra = rows[i]
            goes, known = fault in (BLANK, DUPLICATE), initial in AFTER
            cut = fault == TRUNCATED
            base = DELETE if goes else min(DELETE, (0 if known else REROLE) + cut * CUT)
            self.fixed[i] = self.fixed[i + 1] + base + extra * DELETE
            self.gone[i] = self.gone[i + 1] + (1 + extra) * DELETE
            if not goes:
                change = min(DELETE, REROLE + cut * CUT) - base if known else 0
                near = 0
                if known and not chain:
                    near = 0 if AFTER[initial] in ends else min(INSERT, change)
                elif known and chain[-1][0] and initial + chain[-1][0] not in LEGAL:
                    near = min(INSERT, change, chain[-1][1])
                skipped = pairs[-2] if len(pairs) > 1 else 0
                pairs.append(max(pairs[-1], near + skipped))
                chain.append((initial if known else "", change))
            self.first[i] = len(chain)

    def bound(self, i: int, role: int) -> int:
        if self.ends <= EARLY:  # before the first user: all goes, but for a system row
            if role not in EARLY or not any(role <= end for end in self.ends):
                return LARGEST
            return self.gone[i] if role in self.ends else max(0, self.gone[i] - DELETE)
        k = self.first[i]
        if not k:
            return self.fixed[i] + (0 if role in self.ends else INSERT)
        initial, change = self.chain[k - 1]
        apart = min(INSERT, change) if initial and (role, initial) not in KEPT else 0
        return self.fixed[i] + max(self.pairs[k], apart + self.pairs[k - 1])


def greedy(rows: list[tuple[str, int, int]], role: int, ends: frozenset[int]) -> tuple[int, str] | None:
    """Edits that are legal, row by row without a look ahead."""
    cost, audit = 0, []
    for initial, fault, extra in rows:
        cut = CUT if fault == TRUNCATED else 0
        if fault in (BLANK, DUPLICATE) or initial == "s" and role != START:
            cost, edit = cost + DELETE, "D"
        elif (role, initial) in KEPT:
            cost, edit, role = cost + cut, "K", KEPT[role, initial]
        elif (NEXT[role], initial) in KEPT and not cut:
            cost, edit, role = cost + INSERT, "IK", KEPT[NEXT[role], initial]
        elif cut:
            cost, edit = cost + DELETE, "D"
        else:
            cost, edit, role = cost + REROLE, "R", NEXT[role]
        cost += extra * DELETE
        audit.append(edit + "D" * extra)
    for _ in range(3):
        if role in ends:
            return cost, "".join(audit)
        cost, role = cost + INSERT, NEXT[role]
        audit.append("I")
    return None


def search(rows: list[tuple[str, int, int]], role: int = START, ends: frozenset[int] = WHOLE) -> tuple[int, str] | None:
    """Least (cost, audit) from ``role`` to one of ``ends``; None if there is no way.

    ``rows``: initial, fault and the number of further copies, which all must go."""
    n, suffix = len(rows), Suffixes(rows, ends)
    best = greedy(rows, role, ends)
    reached = [[LARGEST] * 4 for _ in range(n + 1)]
    stack = [(0, role, 0, "")]
    while stack:
        i, at, cost, audit = stack.pop()
        if cost >= reached[i][at]:
            continue
        least = suffix.bound(i, at)
        if least == LARGEST:
            continue
        if best is not None and (cost + least > best[0] or cost + least == best[0] and audit > best[1][: len(audit)]):
            continue
        reached[i][at] = cost
        if i == n:
            if at in ends and (best is None or (cost, audit) < best):
                best = cost, audit
            stack.append((n, NEXT[at], cost + INSERT, audit + "I"))
            continue
        initial, fault, extra = rows[i]
        tail, more = "D" * extra, extra * DELETE
        if fault not in (BLANK, DUPLICATE):
            stay = cost + more + (CUT if fault == TRUNCATED else 0)
            stack.append((i + 1, NEXT[at], stay + REROLE, audit + "R" + tail))
            if (at, initial) in KEPT:
                stack.append((i + 1, KEPT[at, initial], stay, audit + "K" + tail))
        stack.append((i, NEXT[at], cost + INSERT, audit + "I"))
        stack.append((i + 1, at, cost + DELETE + more, audit + "D" + tail))
    return best


def applied(audit: str, role: int, rows: Iterator[tuple[str, str, int]]) -> Iterator[tuple[int, str, str]]:
    """(role before the next, role, text) of the conversation that the edits leave."""
    skip = 0
    for edit in audit:
        if skip:
            skip -= 1  # a further copy
        elif edit == "I":
            role = NEXT[role]
            yield role, NAMES[role], ""
        else:
            name, text, skip = next(rows)
            if edit == "K":
                role = KEPT[role, name[:1]]
                yield role, name, text
            elif edit == "R":
                role = NEXT[role]
                yield role, NAMES[role], text


# ---- blocks ------------------------------------------------------------------

SUMMARY = "blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, first_turn long, last_turn long, n_turns long"


def summary(rows: list[tuple]) -> tuple:
    """Counts of consecutive rows (turn, initial, fault, copies beyond the first)."""
    blank = sum(1 + x for _, _, f, x in rows if f == BLANK)
    duplicate = sum((f == DUPLICATE) + x for _, _, f, x in rows if f != BLANK)
    illegal = sum(x for *_, x in rows) + sum(a[1] + b[1] not in LEGAL for a, b in zip(rows, rows[1:]))
    turns = [t for t, *_ in rows if t is not None]
    n_turns = len(turns) and 1 + sum(a != b for a, b in zip(turns, turns[1:]))
    ends = (turns[0], turns[-1]) if turns else (None, None)
    return blank, duplicate, sum(f == TRUNCATED for _, _, f, _ in rows), illegal, rows[0][1], rows[-1][1], *ends, n_turns


def totals(parts: list[tuple]) -> tuple[int, int, int, int, int]:
    """gaps, blank, duplicate, truncated, illegal of consecutive blocks' summaries."""
    blank, duplicate, truncated, illegal = (sum(p[i] for p in parts) for i in range(4))
    illegal += sum(a[5] + b[4] not in LEGAL for a, b in zip(parts, parts[1:]))
    timed = [p for p in parts if p[8]]
    n_turns = sum(p[8] for p in timed) - sum(a[7] == b[6] for a, b in zip(timed, timed[1:]))
    gaps = timed[-1][7] - timed[0][6] + 1 - n_turns if timed else 0
    return min(gaps, LARGEST), blank, duplicate, truncated, illegal


def chain(tables: list[tuple[list[int | None], list[str | None]]]) -> tuple[int, list[tuple[int, str]]]:
    """Cost, and of each block the role before it and its audit.

    ``tables``: of each block the costs and audits by role before * 4 + role after."""
    after: dict[int, tuple[int, str]] = {s: (0, "") for s in WHOLE}
    choices = []
    for costs, audits in reversed(tables):
        before, choice = {}, {}
        for s in range(4):
            ways = [(costs[4 * s + t] + c, audits[4 * s + t] + a, t) for t, (c, a) in after.items() if costs[4 * s + t] is not None]
            if ways:
                cost, audit, t = min(ways)
                before[s], choice[s] = (cost, audit), (t, audits[4 * s + t])
        choices.append(choice)
        after = before
    out, role = [], START
    for choice in reversed(choices):
        to, audit = choice[role]
        out.append((role, audit))
        role = to
    return after[START][0], out


# ---- rows --------------------------------------------------------------------

def last_letter(text: Column) -> Column:
    """The last character that is no white space, or the empty text."""
    return F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1)


def fault_of(last: Column) -> Column:
    return F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)


def damage(df: DataFrame) -> DataFrame:
    """The test's faults, by the CRC-32 of ``conv_id:turn`` modulo 20; a dropped row stays
    with 0 ``copies``, a repeated one has 2."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.encode(F.concat(shown[0], F.lit(":"), shown[1]), "UTF-8")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return df.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _rows(df: DataFrame, copies: str | None) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return df.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        (F.col(copies) if copies else F.lit(1)).cast("long").alias("copies"),
    )


def _batches(out: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*out)) if out else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True)], names=[n for n, _ in types])


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
RESULT_TYPES = [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in RESULT.split(", ")]


def _conversations(frames: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Sorted rows, in lists of one conversation each."""
    rows: list[tuple] = []
    for frame in frames:
        for part in slices(frame):
            for row in zip(*(part.column(c).to_pylist() for c in part.schema.names)):
                if rows and row[0] != rows[0][0]:
                    yield rows
                    rows = []
                rows.append(row)
    if rows:
        yield rows


def _sorted(df: DataFrame) -> DataFrame:
    return df.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")


# A repaired conversation comes as events: ("begin", conv_id, counts), ("audit", letters)
# once for each block, and ("line", role, text) for each of its rows.

def _short_events(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for rows in _conversations(frames):
        seen, flat = set(), []
        for _, _, turn, role, text, copies, fault in rows:
            if (role, text) in seen and fault != BLANK:
                fault = DUPLICATE
            seen.add((role, text))
            flat.append((turn, role[:1], fault, copies - 1))
        cost, audit = search([x[1:] for x in flat])
        yield "begin", rows[0][1], (*totals([summary(flat)]), cost)
        yield "audit", audit
        for _, role, text in applied(audit, START, ((r[3], r[4], r[5] - 1) for r in rows)):
            yield "line", role, text


def _short(rows: DataFrame) -> DataFrame:
    """Conversations that come whole, sorted in their tasks."""
    own = rows.select("conv", "conv_id", "turn", "role", "text", "copies", fault_of(last_letter(F.col("text"))).alias("fault"))
    return _sorted(own.repartition("conv"))


def _numbered(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows of long conversations, alike rows as one, with their fault and a place: task,
    block of that task, number.  Ranges of rows go to tasks, so that one conversation
    may lie in many."""
    spark = rows.sparkSession
    alike = rows.filter("copies > 0").groupBy("conv", "conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    alike = stage_table(spark, alike.withColumn("digest", F.sha2(F.encode("text", "UTF-8"), 256)), "alike")
    placed = F.struct(F.col("turn").isNotNull().alias("timed"), "turn")
    firsts = alike.groupBy("conv", "role", "digest").agg(F.min(placed).alias("first"))
    own = fault_of(last_letter(F.col("text")))
    fault = F.when(own == BLANK, BLANK).when(F.col("first") < placed, DUPLICATE).otherwise(own)
    known = stage_table(spark, alike.join(firsts, ["conv", "role", "digest"]).select("conv", "conv_id", "turn", "role", "text", "copies", fault.alias("fault")), "faults")
    ranged = _sorted(known.repartitionByRange("conv", F.col("turn").asc_nulls_first(), "role", "text"))
    schema = "conv string, conv_id long, turn long, role string, text string, copies long, fault int, task int, block long, number long"

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, conv, block, number = TaskContext.get().partitionId(), None, -1, 0
        for frame in frames:
            blocks, numbers = [], []
            for c in frame.column("conv").to_pylist():
                if c != conv or number == block_rows:
                    conv, block, number = c, block + 1, 0
                blocks.append(block)
                numbers.append(number)
                number += 1
            yield pa.RecordBatch.from_arrays(
                [*frame.columns, pa.array([task] * len(frame), pa.int32()), pa.array(blocks, pa.int64()), pa.array(numbers, pa.int64())],
                names=[*frame.schema.names, "task", "block", "number"],
            )

    return stage_table(spark, ranged.mapInArrow(run, schema), "numbered")


def _solved(numbered: DataFrame) -> DataFrame:
    """Of each block its summary and its least costs and audits by the roles around it."""
    entry = F.struct("number", "turn", F.substring("role", 1, 1).alias("initial"), "fault", (F.col("copies") - 1).alias("extra"))
    blocks = numbered.groupBy("conv", "task", "block").agg(F.sort_array(F.collect_list(entry)).alias("rows"))
    fields = [f.split() for f in SUMMARY.split(", ")]
    types = [("conv", pa.string()), ("task", pa.int32()), ("block", pa.int64())]
    types += [(n, pa.string() if t == "string" else pa.int64()) for n, t in fields]
    types += [("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            out = []
            for row in frame.to_pylist():
                rows = [(r["turn"], r["initial"], r["fault"], r["extra"]) for r in row["rows"]]
                found = [search([x[1:] for x in rows], s, frozenset({t})) for s in range(4) for t in range(4)]
                out.append((row["conv"], row["task"], row["block"], *summary(rows), [f and f[0] for f in found], [f and f[1] for f in found]))
            yield _batches(out, types)

    return blocks.mapInArrow(run, f"conv string, task int, block long, {SUMMARY}, costs array<long>, audits array<string>")


def _chained(solved: DataFrame) -> DataFrame:
    """Of each block the role before it and its audit; with the first the conversation's counts."""
    schema = "conv string, task int, block long, before int, part string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    types = [(c.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[c.split()[1]]) for c in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["task"], r["block"]))
        names = [f.split()[0] for f in SUMMARY.split(", ")]
        cost, parts = chain([(r["costs"], r["audits"]) for r in rows])
        counts = (*totals([tuple(r[n] for n in names) for r in rows]), cost)
        out = [(r["conv"], r["task"], r["block"], *p, *(counts if not i else [None] * 6)) for i, (r, p) in enumerate(zip(rows, parts, strict=True))]
        return pa.Table.from_batches([_batches(out, types)])

    return solved.groupBy("conv").applyInArrow(run, schema)


def _long_events(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """From the rows of ``_long``; texts of one block are held at a time."""
    conv, block, waiting = None, None, []

    def edited() -> Iterator[tuple]:
        for _, role, text in applied(block[2], block[1], iter(waiting)):
            yield "line", role, text

    for frame in frames:
        for part in slices(frame):
            for row in zip(*(part.column(c).to_pylist() for c in part.schema.names)):
                if block is None or row[0] != conv or row[5:7] != block[0]:
                    yield from edited() if block is not None else ()
                    waiting, block = [], (row[5:7], row[8], row[9])
                    if row[0] != conv:
                        conv = row[0]
                        yield "begin", row[1], row[10:]
                    yield "audit", row[9]
                waiting.append((row[2], row[3], row[4] - 1))
    yield from edited() if block is not None else ()


def _long(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows of conversations in blocks, in order, each with its block's audit."""
    numbered = _numbered(rows, block_rows)
    chained = stage_table(rows.sparkSession, _chained(_solved(numbered)), "chained")
    return numbered.join(chained, ["conv", "task", "block"]).select(
        "conv", "conv_id", numbered["role"], "text", "copies", "task", "block", "number", "before", "part",
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
    ).repartition("conv").sortWithinPartitions("conv", "task", "block", "number")


# ---- on DataFrames -----------------------------------------------------------

def _digests(events) -> callable:
    """RESULT of the events of a task."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head, audit, digest, lines = [], None, [], None, 0
        for kind, *what in events(frames):
            if kind == "begin":
                if head is not None:
                    out.append((head[0], *head[1], "".join(audit), digest.hexdigest()))
                    if len(out) >= 1000:
                        yield _batches(out, RESULT_TYPES)
                        out = []
                head, audit, digest, lines = what, [], hashlib.sha256(), 0
            elif kind == "audit":
                audit += what
            else:
                digest.update((("\n" if lines else "") + ":".join(what)).encode("utf-8"))
                lines += 1
        if head is not None:
            out.append((head[0], *head[1], "".join(audit), digest.hexdigest()))
        yield _batches(out, RESULT_TYPES)

    return run


LINE_TYPES = [("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())]


def _lines(events) -> callable:
    """The repaired rows of the events of a task."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv_id, place, size = [], None, 0, 0
        for kind, *what in events(frames):
            if kind == "begin":
                conv_id, place = what[0], 0
            elif kind == "line":
                out.append((conv_id, place, *what))
                place, size = place + 1, size + len(what[1])
                if len(out) >= 1000 or size > 1 << 20:
                    yield _batches(out, LINE_TYPES)
                    out, size = [], 0
        yield _batches(out, LINE_TYPES)

    return run


def _parted(df: DataFrame, copies: str | None, block_rows: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Sizes of the conversations, rows of short ones, and of long ones, if there are any."""
    spark = df.sparkSession
    bound_batches(spark)
    rows = _rows(df, copies)
    sizes = stage_table(spark, rows.groupBy("conv").agg(F.min("conv_id").alias("conv_id"), F.sum("copies").alias("n")), "sizes")
    live, long = rows.filter("copies > 0"), sizes.filter(F.col("n") > block_rows).select("conv")
    if long.isEmpty():
        return sizes, _short(live), None
    return sizes, _short(live.join(long, "conv", "left_anti")), _long(live.join(long, "conv", "left_semi"), block_rows)


def repair(df: DataFrame, copies: str | None = None, block_rows: int = 64) -> DataFrame:
    """RESULT for every conversation of ``df`` (conv_id, turn, role, text): the counts of
    what was wrong, the cost and audit of the edits, and the SHA-256 of the rows that
    they leave, ``role:text`` joined by line feeds.

    ``copies`` names a column with the number of times that a row counts (0: it only
    tells that its conversation exists).  Conversations without rows have zeros, the
    empty audit and the hash of the empty text."""
    sizes, short, long = _parted(df, copies, block_rows)
    out = short.mapInArrow(_digests(_short_events), RESULT)
    if long is not None:
        out = out.unionByName(long.mapInArrow(_digests(_long_events), RESULT))
    zeros = [F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = sizes.filter("n = 0").select("conv_id", *zeros, F.lit("").alias("audit"), F.sha2(F.lit("").cast("binary"), 256).alias("repaired_sha256"))
    return out.unionByName(none)


def repaired_rows(df: DataFrame, copies: str | None = None, block_rows: int = 64) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text."""
    schema = "conv_id long, place long, role string, text string"
    _, short, long = _parted(df, copies, block_rows)
    out = short.mapInArrow(_lines(_short_events), schema)
    return out if long is None else out.unionByName(long.mapInArrow(_lines(_long_events), schema))
