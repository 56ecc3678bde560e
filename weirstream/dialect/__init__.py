"""The dialect's three statements: CREATE STREAM, CREATE VIEW, PRINT, each a chain of operators from a source."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..registry import operator_names


class ParseError(SyntaxError):
    """A statement that is not in the dialect; says where."""


@dataclass
class Op:
    type: str
    options: dict[str, str] = field(default_factory=dict)
    source: str | None = None
    source_options: dict[str, str] = field(default_factory=dict)


@dataclass
class Statement:
    type: str  # STREAM, VIEW or PRINT
    name: str | None
    source: str
    ops: list[Op]
    options: dict[str, str] = field(default_factory=dict)
    source_options: dict[str, str] = field(default_factory=dict)


_TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:\\.|''|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<name>`[^`]+`|[\w.$]+)|(?P<sign>[(),=;]))""", re.S)
#: Operators that read a second stream; TRANSFORM may.
_SECOND = {"UNION", "JOIN", "INTERVAL JOIN", "CONNECT", "TRANSFORM"}


class _Reader:
    def __init__(self, text: str):
        self.text, self.items, i = text, [], 0
        while text[i:].strip():
            m = _TOKEN.match(text, i)
            if not m:
                self.fail("unexpected character", i + len(text[i:]) - len(text[i:].lstrip()))
            self.items.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
            i = m.end()
        if self.items and self.items[-1][1] == ";":
            self.items.pop()
        self.at = 0

    def fail(self, what: str, place: int | None = None):
        place = place if place is not None else self.items[self.at][2] if self.at < len(self.items) else len(self.text)
        line = self.text.count("\n", 0, place) + 1
        raise ParseError(f"line {line}:{place - (self.text.rfind(chr(10), 0, place) + 1)} {what}")

    def word(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.items[i][1].upper() if i < len(self.items) and self.items[i][0] == "name" and self.items[i][1][0] != "`" else ""

    def sign(self, mark: str) -> bool:
        if self.at < len(self.items) and self.items[self.at][:2] == ("sign", mark):
            self.at += 1
            return True
        return False

    def take(self, *words: str) -> None:
        for w in words:
            if self.word() != w:
                self.fail(f"expected {w}")
            self.at += 1

    def name(self) -> str:
        if self.at >= len(self.items) or self.items[self.at][0] != "name":
            self.fail("expected a name")
        self.at += 1
        return self.items[self.at - 1][1].strip("`")

    def options(self) -> dict[str, str]:
        """WITH ('k' = 'v', ...), if there; values must be quoted."""
        out: dict[str, str] = {}
        if self.word() != "WITH":
            return out
        self.at += 1
        if not self.sign("("):
            self.fail("expected (")
        while True:
            key = self._string("an option name")
            if not self.sign("="):
                self.fail("expected =")
            out[key] = self._string("a quoted value")
            if self.sign(")"):
                return out
            if not self.sign(","):
                self.fail("expected , or )")

    def _string(self, what: str) -> str:
        if self.at >= len(self.items) or self.items[self.at][0] != "string":
            self.fail(f"expected {what} in quotes")
        raw = self.items[self.at][1]
        self.at += 1
        return raw[1:-1].replace("\\'", "'").replace('\\"', '"')


def parse(text: str) -> Statement:
    """Parse a statement; keywords in any case, names and values as written."""
    r = _Reader(text)
    if r.word() == "CREATE" and r.word(1) in ("STREAM", "VIEW"):
        kind = r.word(1)
        r.at += 2
        name = r.name()
        options = r.options()
    elif r.word() == "PRINT":
        r.at += 1
        kind, name, options = "PRINT", None, {}
    else:
        r.fail("expected CREATE STREAM, CREATE VIEW or PRINT")
    r.take("FROM")
    source, source_options, ops = r.name(), r.options(), []
    known = [x.split() for x in operator_names()]
    while r.at < len(r.items):
        words = next((w for w in sorted(known, key=len, reverse=True) if [r.word(i) for i in range(len(w))] == w), None)
        if words:
            r.at += len(words)
            op = Op(" ".join(words))
        else:
            op = Op(r.name().upper())
        if op.type in _SECOND and r.at < len(r.items) and r.items[r.at][0] == "name" and r.word() != "WITH" and not _starts_operator(r, known, op.type):
            op.source = r.name()
            if op.type == "TRANSFORM":
                op.type = "TRANSFORM_WITH"
            if op.type == "UNION":
                op.source_options = r.options()
                ops.append(op)
                continue
        if op.type in _SECOND - {"TRANSFORM"} and op.source is None:
            r.fail("expected a stream's name")
        op.options = r.options()
        ops.append(op)
    return Statement(kind, name, source, ops, options, source_options)


def _starts_operator(r: _Reader, known: list[list[str]], of: str) -> bool:
    """Whether the next words are an operator rather than a stream's name; only TRANSFORM may go without one."""
    return of == "TRANSFORM" and any([r.word(i) for i in range(len(w))] == w for w in known)
