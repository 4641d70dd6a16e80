"""Fields of a JSON answer as its text arrives in pieces.

A field (a key of small letters and underscores) counts as complete once its value
has ended and a comma or a closing brace follows; each key is given once per session,
keys of nested objects too.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SOLID, STRING_MARK, WORD_END = re.compile(r"\S"), re.compile(r'["\\]'), re.compile(r'[\s{}\[\],:"]')
FIELD = re.compile(r"[a-z_]+")
OUTPUT = "session string, field string, value string"


class FieldScanner:
    """Reads JSON text piece by piece, each character once.

    ``open``: the containers around the place reached, as [bracket, key of its value,
    where the value begins]; ``done``: the value that ended last and waits for a comma
    or a closing brace; ``token``: the string or word that is not ended yet, as [kind,
    where it begins, whether its next character is escaped].  Places count from the
    first character; ``parts`` are the pieces that open values still need, ``starts``
    their places."""

    def __init__(self, known: set[str] | None = None):
        self.parts, self.starts, self.size = [], [], 0
        self.open, self.key, self.done, self.token, self.known = [], None, None, None, set(known or ())

    def feed(self, piece: str) -> list[tuple[str, str]]:
        """(key, value as JSON) of the fields that this piece completes."""
        base, at, out = self.size, 0, []
        self.parts.append(piece)
        self.starts.append(base)
        self.size += len(piece)
        while at < len(piece):
            if self.token is None:
                m = SOLID.search(piece, at)
                if m is None:
                    break
                at = m.start()
                if m[0] in "{}[],:":
                    at += 1
                    out += self._mark(m[0], base + at)
                    continue
                self.token = ["string" if m[0] == '"' else "word", base + at, False]
                at += m[0] == '"'
            elif self.token[2]:
                self.token[2], at = False, at + 1
            else:
                m = (STRING_MARK if self.token[0] == "string" else WORD_END).search(piece, at)
                if m is None:
                    break  # it goes on in the next piece, from there
                if m[0] == "\\" and self.token[0] == "string":
                    self.token[2], at = True, m.end()
                    continue
                at = m.end() if self.token[0] == "string" else m.start()
                self.done, self.key, self.token = [self.key, self.token[1], base + at], None, None
        self._forget()
        return out

    def _mark(self, mark: str, end: int) -> list[tuple[str, str]]:
        out = []
        if mark in "{[":
            self.open.append([mark, self.key, end - 1])
            self.key = None
        elif mark == ":":
            if self.done and self.done[0] is None and self.open and self.open[-1][0] == "{":
                name = self._text(self.done[1], self.done[2])
                self.key = name[1:-1] if name[0] == '"' else None
            self.done = None
        else:
            if self.done and mark != "]":
                out = self._give(*self.done)
            self.done, self.key = None, None
            if mark != "," and self.open:
                _, key, begin = self.open.pop()
                self.done = [key, begin, end]
        return out

    @property
    def ended(self) -> bool:
        """The outermost value is closed."""
        return not self.open and self.done is not None

    def _text(self, start: int, end: int) -> str:
        first, last = bisect_right(self.starts, start) - 1, bisect_left(self.starts, end)
        return "".join(self.parts[first:last])[start - self.starts[first] : end - self.starts[first]]

    def _give(self, key: str | None, start: int, end: int) -> list[tuple[str, str]]:
        if key is None or key in self.known or not FIELD.fullmatch(key):
            return []
        try:
            value = json.loads(self._text(start, end))
        except ValueError:
            return []
        self.known.add(key)
        return [(key, json.dumps(value, ensure_ascii=False))]

    def _forget(self) -> None:
        needed = [x[2] for x in self.open if x[1] is not None][:1] + [x[1] for x in (self.done, self.token) if x]
        first = bisect_right(self.starts, min([self.size, *needed])) - 1
        if first > 0 or not needed:
            keep = first if needed else len(self.parts)
            del self.parts[:keep], self.starts[:keep]

    def dump(self) -> str:
        return json.dumps([self.starts[:1], "".join(self.parts), self.size, self.open, self.key, self.done, self.token, sorted(self.known)])

    @classmethod
    def load(cls, state: str) -> FieldScanner:
        out = cls()
        out.starts, text, out.size, out.open, out.key, out.done, out.token, known = json.loads(state)
        out.parts, out.known = [text] if out.starts else [], set(known)
        return out


def complete_fields(raw: str, known: set[str]) -> list[tuple[str, str]]:
    """The fields that are complete in ``raw`` and not known yet, in the order of their ends."""
    scanner = FieldScanner(known)
    out = scanner.feed(raw)
    known |= scanner.known
    return out


def field_events(chunks: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Streaming chunks (session, seq, chunk) to events (session, field, value).  The
    state of a session goes with the end of its answer; with ``idle_ms``, that of one
    without chunks for so long goes, too (such a query runs batches without new data)."""
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        scanner, rows = FieldScanner.load(state.get[0]) if state.exists else FieldScanner(), []
        for frame in frames:
            for chunk in frame.sort_values("seq")["chunk"]:
                rows += scanner.feed(chunk)
        if scanner.ended:
            if state.exists:
                state.remove()
        else:
            state.update((scanner.dump(),))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["session", "field", "value"])

    return chunks.groupBy("session").applyInPandasWithState(step, OUTPUT, "scanner string", "append", timeout)


def settled_events(events: DataFrame, end: str = "done", error: str = "error", idle_ms: int | None = None) -> DataFrame:
    """Streaming events (session, seq, kind, field, value): fields are withheld in state
    until their session's ``end`` event, which releases them in the order of seq, or its
    ``error`` event, which drops them and gives one row of kind ``error``.  Fields behind
    an end or error, and repeated ones (of a field the last stays, by seq), begin a new
    answer of the session.  With ``idle_ms`` a session that stays silent so long is
    rolled back as ``error`` with the value ``timeout``.

    Rows: session, kind (field or error), field, value."""
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    columns = ["session", "kind", "field", "value"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], "error", None, "timeout")], columns=columns)
            return
        held: dict = json.loads(state.get[0]) if state.exists else {}
        came, out = pd.concat(list(frames)).sort_values("seq", kind="stable"), []
        for kind, field, value in zip(came["kind"], came["field"], came["value"]):
            if kind == end:
                out += [(key[0], "field", f, v) for f, v in held.items()]
                held = {}
            elif kind == error:
                out.append((key[0], "error", None, value))
                held = {}
            else:
                held.pop(field, None)
                held[field] = value
        if held:
            state.update((json.dumps(held, ensure_ascii=False),))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=columns)

    return events.groupBy("session").applyInPandasWithState(step, "session string, kind string, field string, value string", "held string", "append", timeout)


def fold_events(events: DataFrame, order: str = "seq") -> DataFrame:
    """The last value of each (session, field)."""
    return events.groupBy("session", "field").agg(F.max_by("value", order).alias("value"))


def frames_to_events(frames: DataFrame, text: str = "frame") -> DataFrame:
    """``data: {...}`` frames to their JSON text; other lines carry nothing."""
    line = F.explode(F.split(F.col(text), "\n"))
    body = F.regexp_extract("line", r"^data: (.*)$", 1)
    return frames.select("*", line.alias("line")).withColumn("data", body).filter("data <> ''").drop("line")


def error_frames(events: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(sessions without an error, error events): a session with one is rolled back."""
    bad = events.filter(F.col(error).isNotNull())
    return events.join(bad.select("session").distinct(), "session", "left_anti"), bad
