"""The query language: a lexer and a recursive-descent parser to a tree of frozen nodes.

Operators are flat, not by precedence: AND makes its two neighbours required, OR leaves them
optional, NOT (or !, -) excludes, + requires. Text that doesn't parse is escaped and read again
as plain words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

SPECIAL = r'+-!(){}[]^"~*?:\/&|'
MUST, SHOULD, NOT = "must", "should", "not"


class QueryError(ValueError):
    """The query can't be read, not even as plain words."""


@dataclass(frozen=True)
class Term:
    text: str
    field: str | None = None
    boost: float = 1.0


@dataclass(frozen=True)
class Phrase:
    text: str
    slop: int = 0
    field: str | None = None
    boost: float = 1.0


@dataclass(frozen=True)
class Pattern:
    """A constant-score match of dictionary terms against a regular expression."""

    regex: str
    field: str | None = None
    boost: float = 1.0


@dataclass(frozen=True)
class Range:
    low: str | None
    high: str | None
    low_in: bool = True
    high_in: bool = True
    field: str | None = None
    boost: float = 1.0


@dataclass(frozen=True)
class Fuzzy:
    text: str
    edits: int = 2
    field: str | None = None
    boost: float = 1.0


@dataclass(frozen=True)
class Everything:
    boost: float = 1.0


@dataclass(frozen=True)
class Bool:
    clauses: tuple = field(default=())  # of (occur, node)
    boost: float = 1.0


Node = Term | Phrase | Pattern | Range | Fuzzy | Everything | Bool

_TOKEN = re.compile(
    r"""\s*(?:
    (?P<and>AND\b|&&)|(?P<or>OR\b|\|\|)|(?P<not>NOT\b|!)
    |(?P<plus>\+)|(?P<minus>-)|(?P<open>\()|(?P<close>\))
    |(?P<all>\*:\*)
    |(?P<field>(?:\\.|[^\s+\-!(){}\[\]^"~*?:\\/&|])+(?=:)):
    |"(?P<phrase>(?:\\.|[^"\\])*)"
    |/(?P<regex>(?:\\.|[^/\\])*)/
    |(?P<range>[\[{]\s*(?:"(?:\\.|[^"\\])*"|[^\s\]}]+)\s+TO\s+(?:"(?:\\.|[^"\\])*"|[^\s\]}]+)\s*[\]}])
    |\^(?P<boost>\d+(?:\.\d+)?)
    |~(?P<tilde>\d+(?:\.\d+)?)?
    |(?P<word>(?:\\.|[^\s+\-!(){}\[\]^"~:\\/&|])(?:\\.|[^\s!(){}\[\]^"~:\\/&|])*)
    )""",
    re.X | re.S,
)


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


def escape(s: str) -> str:
    return re.sub(r'([+\-!(){}\[\]^"~*?:\\/&|])', r"\\\1", s)


def _lex(text: str) -> list[tuple[str, str | None]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise QueryError(f"unexpected input at {at}: {text[at:]!r}")
        out.append((m.lastgroup or "tilde", m.group(m.lastgroup) if m.lastgroup else None))
        at = m.end()
    return out


def _wild(word: str) -> str:
    out, i = "", 0
    while i < len(word):
        c = word[i]
        if c == "\\" and i + 1 < len(word):
            out, i = out + re.escape(word[i + 1]), i + 2
            continue
        out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        i += 1
    return out


class _Parser:
    def __init__(self, tokens: list[tuple[str, str | None]]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str | None:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else None

    def take(self) -> tuple[str, str | None]:
        self.at += 1
        return self.tokens[self.at - 1]

    def clauses(self, name: str | None, nested: bool) -> Bool:
        found: list[list] = []
        while (kind := self.peek()) is not None and kind != "close":
            joined = None
            if kind in ("and", "or"):
                if not found:
                    raise QueryError("an operator needs something before it")
                joined = self.take()[0]
            occur = SHOULD
            while self.peek() in ("plus", "minus", "not"):
                occur = MUST if self.take()[0] == "plus" else NOT
            if self.peek() in (None, "close", "and", "or"):
                raise QueryError("an operator needs something after it")
            if joined == "and":
                if found[-1][0] == SHOULD:
                    found[-1][0] = MUST
                occur = MUST if occur == SHOULD else occur
            found.append([occur, self.item(name)])
        if nested and self.peek() != "close":
            raise QueryError("a bracket isn't closed")
        if not found:
            raise QueryError("empty query")
        return Bool(tuple((o, n) for o, n in found))

    def item(self, name: str | None) -> Node:
        kind, value = self.take()
        if kind == "field":
            if self.peek() is None:
                raise QueryError("a field needs a value")
            return self.item(unescape(value or ""))
        if kind == "open":
            node: Node = self.clauses(name, True)
            self.take()
        elif kind == "all":
            node = Everything()
        elif kind == "phrase":
            slop = int(float(self.take()[1] or 0)) if self.peek() == "tilde" else 0
            node = Phrase(unescape(value or ""), slop, name)
        elif kind == "regex":
            node = Pattern((value or "").replace("\\/", "/"), name)
        elif kind == "range":
            low, high = re.split(r"\s+TO\s+", value[1:-1].strip())  # type: ignore[index]
            plain = lambda s: None if s == "*" else unescape(s.strip('"')).lower()
            node = Range(plain(low), plain(high), value[0] == "[", value[-1] == "]", name)  # type: ignore[index]
        elif kind == "word":
            wild = re.search(r"(?<!\\)[*?]", value or "")
            if wild and value[0] in "*?":  # type: ignore[index]
                raise QueryError("a pattern can't begin with a wildcard")
            if self.peek() == "tilde" and not wild:
                n = self.take()[1]
                edits = 2 if n is None else int(float(n)) if float(n) >= 1 else int((1 - float(n)) * len(value or ""))
                node = Fuzzy(unescape(value or "").lower(), min(2, edits), name)
            elif wild:
                node = Pattern(_wild((value or "").lower()), name)
            else:
                node = Term(unescape(value or ""), name)
        else:
            raise QueryError(f"unexpected {kind}")
        if self.peek() == "boost":
            node = replace(node, boost=float(self.take()[1] or 1))
        return node


def parse(text: str) -> Node:
    """The tree of a query; raises QueryError."""
    p = _Parser(_lex(text))
    tree = p.clauses(None, False)
    if p.peek() is not None:
        raise QueryError("a bracket isn't open")
    return tree


def read(text: str) -> Node:
    """As parse, but text that doesn't parse is read again with its special characters escaped."""
    try:
        return parse(text)
    except QueryError:
        return parse(escape(text))
