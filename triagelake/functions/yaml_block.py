"""The values of a YAML block: maps, lists and scalars by indentation.

Read are block and flow maps and lists, plain and quoted scalars (also over several
lines), literal and folded text, comments, nulls, booleans, numbers and dates (as text).
Anchors, aliases, tags and several documents are YAML, but not read: ``Unread``.
"""

from __future__ import annotations

import json
import re

KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\-?:,\[\]{}#&*!|>'"%@`][^#]*?|[-?:][^\s,\[\]{}#][^#]*?)\s*:(?:\s+|$)""")
NUMBER = re.compile(r"[-+]?(?:0|[1-9][0-9_]*)$")
FLOAT = re.compile(r"[-+]?(?:[0-9][0-9_]*\.[0-9_]*(?:[eE][-+][0-9]+)?|\.[0-9_]+)$")
# The words of YAML 1.1 for null, true and false.
NULLS = {"", "~", "null", "Null", "NULL"}
TRUE = {x for w in ("yes", "true", "on") for x in (w, w.capitalize(), w.upper())}
FALSE = {x for w in ("no", "false", "off") for x in (w, w.capitalize(), w.upper())}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "e": "\x1b", " ": " "}


class Invalid(ValueError):
    """Not YAML."""


class Unread(ValueError):
    """YAML that is not read here."""


def scalar(text: str):
    """The value of a plain scalar."""
    if text in NULLS:
        return None
    if text in TRUE or text in FALSE:
        return text in TRUE
    if NUMBER.match(text):
        return int(text.replace("_", ""))
    if FLOAT.match(text):
        return float(text.replace("_", ""))
    return text


def unquoted(text: str) -> str:
    """The text of a quoted scalar."""
    body = re.sub(r"[ \t]*\n[ \t]*", " ", text[1:-1])
    if text[0] == "'":
        return body.replace("''", "'")

    def escape(m: re.Match) -> str:
        if m[1] in "xuU":
            return chr(int(m[2], 16))
        if m[1] not in ESCAPES:
            raise Invalid(f"escape {m[1]}")
        return ESCAPES[m[1]]

    return re.sub(r"\\(?:(x)([0-9a-fA-F]{2})|(u)([0-9a-fA-F]{4})|(.))", lambda m: escape(re.match(r"(.)(.*)", (m[1] or m[3] or m[5]) + (m[2] or m[4] or ""))), body)


class Flow:
    """A flow list or map, from its bracket."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def skip(self) -> None:
        self.at = re.compile(r"(?:\s|(?<=\s)#[^\n]*)*").match(self.text, self.at).end()

    def value(self, stops: str = ",]}"):
        self.skip()
        c = self.text[self.at : self.at + 1]
        if c in ("[", "{"):
            return self.items(c)
        m = re.compile(r""""(?:[^"\\]|\\.)*"|'(?:[^']|'')*'""", re.S).match(self.text, self.at)
        if m:
            self.at = m.end()
            return unquoted(m[0])
        if c in ("&", "*", "!"):
            raise Unread(c)
        m = re.compile(rf"(?:[^{re.escape(stops)}\[{{:#]|:(?![\s{re.escape(stops)}])|(?<!\s)#)*").match(self.text, self.at)
        self.at = m.end()
        return scalar(" ".join(m[0].split()))

    def items(self, opening: str):
        closing, out = {"[": ("]", []), "{": ("}", {})}[opening]
        self.at += 1
        while True:
            self.skip()
            if self.text[self.at : self.at + 1] == closing:
                self.at += 1
                return out
            item = self.value()
            self.skip()
            if self.text[self.at : self.at + 1] == ":":
                self.at += 1
                pair = {key_text(item): self.value()}
                self.skip()
                out.update(pair) if closing == "}" else out.append(pair)
            elif closing == "}":
                out[key_text(item)] = None
            else:
                out.append(item)
            c = self.text[self.at : self.at + 1]
            if c == ",":
                self.at += 1
            elif c != closing:
                raise Invalid("flow collection")


def key_text(key) -> str:
    if isinstance(key, (list, dict)):
        raise Invalid("key")
    return key if isinstance(key, str) else json.dumps(key)


class Block:
    """Lines with their indentation, read by one pass; nesting is the recursion's stack."""

    def __init__(self, text: str):
        self.lines, self.at = text.split("\n"), 0

    def peek(self) -> tuple[int, str] | None:
        """Indentation and text of the next line that is more than a comment."""
        while self.at < len(self.lines):
            line = self.lines[self.at].rstrip()
            bare = line.lstrip(" ")
            if bare and not bare.startswith("#"):
                if bare[0] == "\t":
                    raise Invalid("tab")
                return len(line) - len(bare), bare
            self.at += 1
        return None

    def node(self, least: int):
        """The value that begins at the next line, if it is indented by ``least`` or more."""
        line = self.peek()
        if line is None or line[0] < least:
            return None
        indent, text = line
        if text == "-" or text.startswith("- "):
            return self.sequence(indent)
        if KEY.match(text) and text[0] not in "[{":
            return self.mapping(indent)
        self.at += 1
        return self.inline(text, indent - 1)

    def sequence(self, indent: int) -> list:
        out = []
        while (line := self.peek()) and line[0] == indent and (line[1] == "-" or line[1].startswith("- ")):
            rest = line[1][1:]
            inner = rest.lstrip(" ")
            if not inner or inner.startswith("#"):
                self.at += 1
                out.append(self.node(indent + 1))
            else:  # what stands behind the dash is a node of its own, indented by so much
                self.lines[self.at] = " " * (indent + 1 + len(rest) - len(inner)) + inner
                out.append(self.node(indent + 1))
        if (line := self.peek()) and line[0] > indent:
            raise Invalid("indentation")
        return out

    def mapping(self, indent: int) -> dict:
        out = {}
        while (line := self.peek()) and line[0] == indent:
            m = KEY.match(line[1])
            if not m:
                raise Invalid("no key")
            name = m[1]
            key = key_text(unquoted(name) if name[0] in "\"'" else scalar(name))
            rest = line[1][m.end() :].strip()
            self.at += 1
            if not rest or rest.startswith("#"):
                after = self.peek()
                dash = after and after[0] == indent and (after[1] == "-" or after[1].startswith("- "))
                out[key] = self.sequence(indent) if dash else self.node(indent + 1)
            else:
                out[key] = self.inline(rest, indent)
        if (line := self.peek()) and line[0] > indent:
            raise Invalid("indentation")
        return out

    def inline(self, text: str, indent: int):
        """A value that begins behind a key or dash; more of it may be indented deeper."""
        if text[0] in "&*!":
            raise Unread(text[0])
        if text[0] in "|>":
            return self.literal(text, indent)
        if text[0] in "@`%":
            raise Invalid(text[0])
        if text[0] in "\"'":
            whole = re.compile(r""""(?:[^"\\]|\\.)*"|'(?:[^']|'')*'""", re.S)
            while not (m := whole.match(text)):
                text += "\n" + self.more(indent)
            if text[m.end() :].strip() and not re.match(r"\s+#", text[m.end() :]):
                raise Invalid("text behind a quote")
            return unquoted(m[0])
        if text[0] in "[{":
            while True:
                flow = Flow(text)
                try:
                    value = flow.value()
                    break
                except Invalid:
                    text += "\n" + self.more(indent)
            if re.sub(r"(^|\s)#.*", "", text[flow.at :]).strip():
                raise Invalid("text behind a bracket")
            return value
        parts = [re.sub(r"\s#.*", "", text)]
        while (line := self.peek()) and line[0] > indent and parts[-1] == text:
            if re.search(r":(\s|$)", line[1]):
                raise Invalid("key in a scalar")
            text = line[1]
            parts.append(re.sub(r"\s#.*", "", text))
            self.at += 1
        if any(re.search(r":(\s|$)", p) for p in parts):
            raise Invalid("key in a scalar")
        return scalar(" ".join(p.strip() for p in parts))

    def more(self, indent: int) -> str:
        line = self.peek()
        if line is None or line[0] <= indent:
            raise Invalid("not closed")
        self.at += 1
        return line[1]

    def literal(self, head: str, indent: int) -> str:
        m = re.fullmatch(r"([|>])([1-9]?)([+-]?)([1-9]?)\s*(#.*)?", head)
        if not m:
            raise Invalid("text header")
        deep, rows = int(m[2] or m[4] or 0) and max(indent, 0) + int(m[2] or m[4]), []
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if line.strip():
                own = len(line) - len(line.lstrip(" "))
                deep = deep or own
                if own < deep or own <= indent:
                    break
            rows.append(line[deep:] if line.strip() else "")
            self.at += 1
        tail = 0
        while rows and not rows[-1]:
            rows.pop()
            tail += 1
        text = "\n".join(rows)
        if m[1] == ">":
            text = re.sub(r"(?<=[^\n])\n(?=[^\s])", " ", text)
            text = re.sub(r"\n\n", "\n", text)
        return text + {"-": "", "+": "\n" * (tail + bool(rows))}.get(m[3], "\n" if rows else "")


def read(text: str):
    """The value of a block; Invalid or Unread if there is none."""
    block = Block(text)
    value = block.node(0)
    if (line := block.peek()) is not None:
        if line[1] in ("---", "..."):
            raise Unread(line[1])
        raise Invalid("text behind the value")
    return value


def as_json(text: str | None) -> str | None:
    """The block as a JSON object; ``{}`` where it is YAML but no map or not read, null where it is not YAML."""
    try:
        value = read(text or "")
    except Unread:
        return "{}"
    except (Invalid, RecursionError):
        return None
    return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else "{}"
