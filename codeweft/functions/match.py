"""The full-text match language: parsed on the driver, compiled to one Column over the positions of its tokens.

    expr    = not {OR not}         OR binds least, then AND, then NOT, then juxtaposition
    and     = not {AND not}
    not     = juxt {NOT juxt}
    juxt    = item {item}          an implicit AND
    item    = [-] cols : item | ( expr ) | NEAR( phrase phrase .. [, n] ) | [^] phrase
    cols    = name | { name .. }
    phrase  = string {+ string} [*]
    string  = bareword | "quoted, with doubled quotes"
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeweft.functions.text import tokens_of

COLUMNS = ("name", "signature", "doc_comment")
#: Other columns of the index that hold no tokens.
UNINDEXED = ("id",)
NEAR_DEFAULT = 10

_LEX = re.compile(r'\s*(?:("(?:[^"]|"")*")|([A-Za-z0-9_\x1a\x80-\U0010FFFF]+)|([():{}+*^,-]))')


class MatchError(ValueError):
    """A query that doesn't parse."""


@dataclass
class Phrase:
    tokens: list[str]
    prefix: bool = False
    initial: bool = False


@dataclass
class Near:
    phrases: list[Phrase]
    distance: int = NEAR_DEFAULT
    columns: tuple[str, ...] = COLUMNS


@dataclass
class Op:
    name: str
    items: list = field(default_factory=list)


def _lex(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while query[at:].strip():
        m = _LEX.match(query, at)
        if not m:
            raise MatchError(f"syntax error near {query[at:].strip()[:1]!r}")
        if m[1] is not None:
            out.append(("string", m[1][1:-1].replace('""', '"')))
        elif m[2] is not None:
            out.append((m[2] if m[2] in ("AND", "OR", "NOT") else "word", m[2]))
        else:
            out.append((m[3], m[3]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, query: str):
        self.toks, self.at = _lex(query), 0

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.toks[i][0] if i < len(self.toks) else "end"

    def take(self, kind: str | None = None) -> str:
        if self.peek() == "end" or (kind and self.peek() != kind):
            near = self.toks[self.at][1] if self.at < len(self.toks) else ""
            raise MatchError(f"syntax error near {near!r}")
        self.at += 1
        return self.toks[self.at - 1][1]

    def chain(self, kind: str, below):
        left = below()
        while self.peek() == kind:
            self.take()
            left = Op(kind, [left, below()])
        return left

    def expr(self):
        return self.chain("OR", lambda: self.chain("AND", lambda: self.chain("NOT", self.juxt)))

    def juxt(self):
        items = [self.item()]
        while self.peek() in ("string", "word", "^", "(", "{", "-"):
            items.append(self.item())
        full = [i for i in items if not (isinstance(i, Near) and not any(p.tokens for p in i.phrases))]
        return reduce(lambda a, b: Op("AND", [a, b]), full) if full else items[0]

    def item(self):
        cols = self.columns()
        if cols is not None:
            return _limit(self.item(), cols)
        if self.peek() == "(":
            self.take()
            inner = self.expr()
            self.take(")")
            return inner
        if self.peek() == "word" and self.toks[self.at][1] == "NEAR" and self.peek(1) == "(":
            self.at += 2
            phrases = [self.phrase()]
            while self.peek() in ("string", "word"):
                phrases.append(self.phrase())
            distance = NEAR_DEFAULT
            if self.peek() == ",":
                self.take()
                number = self.take()
                if not number.isascii() or not number.isdigit():
                    raise MatchError(f"expected integer, got {number!r}")
                distance = int(number)
            self.take(")")
            return Near(phrases, distance)
        initial = self.peek() == "^"
        if initial:
            self.take()
        phrase = self.phrase()
        phrase.initial = initial
        return Near([phrase])

    def columns(self) -> tuple[str, ...] | None:
        """A column filter at this place, if there is one."""
        at = self.at
        negated = self.peek() == "-"
        if negated:
            self.take()
        names: list[str] = []
        if self.peek() == "{":
            self.take()
            while self.peek() in ("word", "string"):
                names.append(self.take())
            self.take("}")
        elif self.peek() in ("word", "string") and self.peek(1) == ":":
            names.append(self.take())
        elif negated:
            # a - b reads as a column filter on a: there is no such column
            raise MatchError(f"no such column: {self.toks[self.at][1] if self.at < len(self.toks) else ''}")
        else:
            self.at = at
            return None
        self.take(":")
        known = {c: c for c in (*COLUMNS, *UNINDEXED)}
        for n in names:
            if n.lower() not in known:
                raise MatchError(f"no such column: {n}")
        chosen = {n.lower() for n in names}
        return tuple(c for c in COLUMNS if (c in chosen) != negated)

    def phrase(self) -> Phrase:
        if self.peek() not in ("string", "word"):
            self.take("string")
        out = Phrase(tokens_of(self.take()))
        while self.peek() in ("+", "*"):
            if self.take() == "*":
                out.prefix = bool(out.tokens)
                if self.peek() == "+":
                    self.take("string")
                break
            if self.peek() not in ("string", "word"):
                self.take("string")
            out.tokens += tokens_of(self.take())
        return out


def _limit(node, cols: tuple[str, ...]):
    if isinstance(node, Near):
        node.columns = tuple(c for c in node.columns if c in cols)
    else:
        node.items = [_limit(i, cols) for i in node.items]
    return node


def parse(query: str):
    p = _Parser(query)
    if not p.toks:
        raise MatchError("syntax error near ''")
    tree = p.expr()
    if p.peek() != "end":
        p.take("end")
    return tree


@dataclass(frozen=True)
class Token:
    """A token, or all that begin with it, in one column."""

    column: str
    text: str
    prefix: bool = False


def wanted(tree) -> list[Token]:
    """The tokens that a parsed query asks for, each once."""
    if isinstance(tree, Near):
        if any(not p.tokens for p in tree.phrases):
            return []
        every = [(t, p.prefix and k == len(p.tokens) - 1) for p in tree.phrases for k, t in enumerate(p.tokens)]
        return list(dict.fromkeys(Token(c, t, x) for c in tree.columns for t, x in every))
    return list(dict.fromkeys(t for i in tree.items for t in wanted(i)))


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def _places(at: Callable[[Token], Column], column: str, phrase: Phrase) -> Column:
    """Start positions, from 1, of a phrase: those of its first token at which the others follow."""
    last = len(phrase.tokens) - 1
    out = None
    for k, t in enumerate(phrase.tokens):
        here = at(Token(column, t, phrase.prefix and k == last))
        starts = _moved(here, k) if k else here
        out = starts if out is None else F.array_intersect(out, starts)
    return F.filter(out, lambda x: x == 1) if phrase.initial else out


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where plans merge and inline it."""
    return F.exists(F.array(value), body)


def _near(at: Callable[[Token], Column], column: str, node: Near) -> Column:
    places = [_places(at, column, p) for p in node.phrases]
    if len(places) == 1:
        return F.size(places[0]) > 0
    return _bound(F.array(*places), lambda found: _close(found, node))


def _close(at: Column, node: Near) -> Column:
    places = [F.get(at, F.lit(k)) for k in range(len(node.phrases))]

    def led_by(k: int) -> Column:
        """Some place of phrase k has every other phrase begin at or behind it, within the distance of its end."""

        def fits(s: Column) -> Column:
            reach = s + len(node.phrases[k].tokens) + node.distance
            return reduce(lambda a, b: a & b, [F.exists(p, lambda x: (x >= s) & (x <= reach)) for j, p in enumerate(places) if j != k])

        return F.exists(places[k], fits)

    return reduce(lambda a, b: a | b, [led_by(k) for k in range(len(places))])


def compile_match(tree, at: Callable[[Token], Column]) -> Column:
    """A parsed query as a condition on the positions of the tokens it asks for."""
    if isinstance(tree, Near):
        if any(not p.tokens for p in tree.phrases):
            return F.lit(False)
        return reduce(lambda a, b: a | b, [_near(at, c, tree) for c in tree.columns], F.lit(False))
    a, b = (compile_match(i, at) for i in tree.items)
    return a & b if tree.name == "AND" else a | b if tree.name == "OR" else a & ~b
