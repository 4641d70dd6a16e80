"""Repair of conversations against exhaustive search and plain loops."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from triagelake.llm import conversations as conv
from triagelake.llm.queries import QUERIES

FORM = re.compile(r"(s?(ua)+)?")
SPACES = " \t\n\x0b\x0c\r"


def exhaustive(rows: list[tuple[str, str]], faults: list[str], most_inserts: int = 3):
    """Least (cost, audit) over all edits, by enumeration."""
    best = None
    choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in faults]
    slots = list(itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1))
    for edits in itertools.product(*choices):
        for put in slots:
            if sum(map(len, put)) > most_inserts:
                continue
            initials, audit, cost, out = "", "", 0, []
            for i in range(len(rows) + 1):
                for x in put[i]:
                    initials, audit, cost = initials + x, audit + "I", cost + 3
                    out.append(({"u": "user", "a": "assistant"}[x], ""))
                if i == len(rows):
                    break
                (role, text), e = rows[i], edits[i]
                audit += e[0]
                cost += {"D": 4, "K": 0, "R": 3}[e[0]] + (3 if e != "D" and faults[i] == "truncated" else 0)
                if e != "D":
                    role = {"Ru": "user", "Ra": "assistant"}.get(e, role)
                    initials += role[:1] or "?"
                    out.append((role, text))
            if FORM.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, out
    return best


def faults_of(rows: list[tuple[str, str]]) -> list[str]:
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def by_table(rows: list[tuple[str, str]], faults: list[str]):
    """Least (cost, audit, rows) by plain recursion over suffixes."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    new = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    least: dict = {}
    for i in range(len(rows), -1, -1):
        for puts in (2, 1, 0):  # at most two rows put in here: the third would be a detour
            for at in ("", "s", "u", "a"):
                ways = []
                if i == len(rows) and at in ("", "a"):
                    ways.append((0, "", ()))
                if puts < 2:
                    c, a, o = least[i, puts + 1, new[at]]
                    ways.append((c + 3, "I" + a, ((name[new[at]], ""), *o)))
                if i < len(rows):
                    role, text = rows[i]
                    c, a, o = least[i + 1, 0, at]
                    ways.append((c + 4, "D" + a, o))
                    if faults[i] not in ("blank", "duplicate"):
                        cut = 3 if faults[i] == "truncated" else 0
                        if (at, role[:1]) in step:
                            c, a, o = least[i + 1, 0, step[at, role[:1]]]
                            ways.append((c + cut, "K" + a, ((role, text), *o)))
                        c, a, o = least[i + 1, 0, new[at]]
                        ways.append((c + cut + 3, "R" + a, ((name[new[at]], text), *o)))
                least[i, puts, at] = min(ways, default=(10**9, "", ()))
    return least[0, 0, ""]


def plain_result(conv_id, rows: list[tuple]) -> tuple:
    """The row of ``repair`` for (turn, role, text) in order."""
    said = [(r, t) for _, r, t in rows]
    faults = faults_of(said)
    cost, audit, out = by_table(said, faults)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in out)
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return conv_id, gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def plain_repair(rows: list[tuple]) -> dict:
    """conv_id -> result for (conv_id, turn, role, text, copies)."""
    groups: dict = {}
    for conv_id, turn, role, text, copies in rows:
        one = (turn, " " if role is None else role, " " if text is None else text)
        groups.setdefault(conv_id, []).extend([one] * copies)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {c: plain_result(c, sorted(g, key=order)) for c, g in groups.items()}


def plain_damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv_id, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv_id, turn)]
        kind = zlib.crc32(":".join(shown).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out.append((conv_id, turn, "user" if kind == 4 else role, text, {0: 0, 3: 2}.get(kind, 1)))
    return out


def some_rows(seed: int, n: int, turns: int) -> list[tuple]:
    rnd, out = random.Random(seed), []
    for c in range(n):
        for t in range(rnd.randint(1, turns)):
            role = rnd.choice(["user", "assistant"] * 6 + ["system", "user", "", "tool", "assist", None])
            role = role if rnd.random() < 0.4 else ("user", "assistant")[t % 2]
            text = rnd.choice([f"Line {rnd.randrange(8)}.", f"So {rnd.randrange(900)}!", "cut off", "", " \n\t", " ", "end.\x0b ", "日本語。", None])
            out.append((c, rnd.choice([t, t, t, t, t, t + 1, 3, None]), role, text))
    return out


def result(df) -> dict:
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r for r in rows}


def test_search_against_enumeration_and_recursion():
    rnd = random.Random(3)
    for n in range(0, 5):
        for _ in range(40 if n < 4 else 12):
            rows = [(rnd.choice(["user", "assistant", "system", "x", ""]), rnd.choice(["a.", "b.", "", "cut", "c."])) for _ in range(n)]
            faults = faults_of(rows)
            flat = [(r[:1], ["", "blank", "duplicate", "truncated"].index(f), 0) for (r, _), f in zip(rows, faults)]
            want = exhaustive(rows, faults)
            got = conv.search(flat)
            assert got == want[:2] == by_table(rows, faults)[:2]
            assert [x[1:] for x in conv.applied(got[1], conv.START, iter([(*r, 0) for r in rows]))] == want[2]


def test_search_between_any_roles():
    rnd = random.Random(6)
    roles = ["", "s", "u", "a"]
    for _ in range(150):
        flat = [(rnd.choice("suax"), rnd.choice([0, 0, 0, conv.BLANK, conv.TRUNCATED]), rnd.choice([0, 0, 0, 2])) for _ in range(rnd.randint(0, 7))]
        for start in range(4):
            least = {roles[start]: (0, "")}  # by role, over all prefixes of edits
            for row in [*flat, None]:
                for _ in range(2):  # rows put in
                    for r, (c, a) in list(least.items()):
                        to = {"": "u", "s": "u", "u": "a", "a": "u"}[r]
                        least[to] = min(least.get(to, (999, "")), (c + 3, a + "I"))
                if row is None:
                    break
                (initial, fault, extra), now = row, {}
                for r, (c, a) in least.items():
                    ways = [(r, 4, "D")]
                    if fault != conv.BLANK:
                        cut = 3 if fault == conv.TRUNCATED else 0
                        ways.append(({"": "u", "s": "u", "u": "a", "a": "u"}[r], 3 + cut, "R"))
                        if r + initial in ("s", "u", "su", "ua", "au"):
                            ways.append((initial, cut, "K"))
                    for to, cost, edit in ways:
                        now[to] = min(now.get(to, (999, "")), (c + cost + 4 * extra, a + edit + "D" * extra))
                least = now
            for end in range(4):
                assert conv.search(flat, start, frozenset({end})) == least.get(roles[end]), (flat, start, end)


def test_search_of_many_rows_and_bounds_that_hold():
    rnd = random.Random(4)
    for n in (30, 120, 400):
        roles = [("user", "assistant")[i % 2] if rnd.random() < 0.8 else rnd.choice(["user", "system", "assistant", "q"]) for i in range(n)]
        rows = [(r, rnd.choice([f"{i}.", f"{i}.", f"{i}.", "", f"{i}"])) for i, r in enumerate(roles)]
        faults = faults_of(rows)
        flat = [(r[:1], ["", "blank", "duplicate", "truncated"].index(f), 0) for (r, _), f in zip(rows, faults)]
        want = by_table(rows, faults)
        assert conv.search(flat) == want[:2]
        assert conv.Suffixes(flat, conv.WHOLE).bound(0, conv.START) <= want[0]


@pytest.mark.parametrize("block_rows", [256, 64, 3])
def test_repair_with_any_block_size(spark, block_rows):
    rows = some_rows(11, 60, 14) + [(None, None, "user", "Hi."), (None, 2, "assistant", "Yo."), (900, None, None, None)] * 3
    rows += [(901, i, ("user", "assistant")[i % 2], f"Long {i}" + "." * (i % 5 > 0)) for i in range(90) if i % 11]
    damaged = plain_damage(rows) + [(902, 1, "user", "gone", 0)]
    df = spark.createDataFrame([(*r, "x", 5) for r in damaged], "conv_id long, turn long, role string, text string, times int, audit string, cost int").repartition(5)
    want = plain_repair(damaged)
    assert result(conv.repair(df, copies="times", block_rows=block_rows)) == want
    lines: dict = {}
    for r in sorted(conv.repaired_rows(df, copies="times", block_rows=block_rows).collect(), key=lambda r: (str(r["conv_id"]), r["place"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert all(hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == w[-1] for c, w in want.items())


def test_damage_and_query(spark):
    rows = some_rows(12, 50, 8) + [(None, 4, "user", "A. B!"), (7, None, None, None)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "conv_id long, turn long, role string, text string, copies int")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, conv.damage(df).collect()), key=key) == sorted(plain_damage(rows), key=key)
    sf = "/root/testdata/sf0.001"
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op13_branch_repair"](spark, sf)) == plain_repair(plain_damage(table))


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conv.repair(df).collect() == [] and conv.repaired_rows(df).collect() == []
