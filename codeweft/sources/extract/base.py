"""What the language scanners share: masking, nesting, and the recorder of symbols and edges.

Scanners work on a masked copy of a file in which comments and string contents
are blanks, so that offsets and lines agree with the source while braces and words
inside strings mean nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from functools import cache

from codeweft.functions.ids import symbol_id

IDENT = r"[A-Za-z_$][\w$]*"


@dataclass
class Extracted:
    symbols: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)


def mask(src: str, line: str = "//", block: tuple[str, str] | None = ("/*", "*/"), quotes: str = "\"'`", raw: str = "`", multiline: str = "`") -> str:
    """``src`` with comments and string contents as blanks; quotes in ``raw`` know no backslash, others end with their line unless ``multiline``."""
    out, done, n = [], 0, len(src)
    found = _starts(line, block[0] if block else "", quotes).search(src)
    while found:
        i = k = found.start()
        if line and src.startswith(line, i):
            k = src.find("\n", i)
            k = n if k < 0 else k
            after = k
        elif block and src.startswith(block[0], i):
            k = src.find(block[1], i + len(block[0]))
            k = n if k < 0 else k + len(block[1])
            after = k
        else:
            q, i, k = src[i], i + 1, i + 1
            while k < n and src[k] != q:
                if src[k] == "\n" and q not in multiline:
                    break
                k += 2 if src[k] == "\\" and q not in raw else 1
            after = k + 1
        out += (src[done:i], _SEEN.sub(" ", src[i:k]))
        done = min(k, n)
        found = _starts(line, block[0] if block else "", quotes).search(src, after)
    return "".join((*out, src[done:]))


_SEEN = re.compile(r"[^\n]")


@cache
def _starts(line: str, block: str, quotes: str) -> re.Pattern:
    """What comments and strings begin with."""
    return re.compile("|".join(re.escape(x) for x in (line, block, *quotes) if x))


_PAIRS = {"(": ")", "[": "]", "{": "}"}
_ENDS = {a: re.compile(f"[{re.escape(a + z)}]") for a, z in _PAIRS.items()}
_BRACES = re.compile("[{}]")


def closing(text: str, at: int) -> int:
    """The offset behind the bracket that closes the one at ``at``; the end of the text if none does."""
    opened, depth = text[at], 0
    for m in _ENDS[opened].finditer(text, at):
        depth += 1 if m[0] == opened else -1
        if not depth:
            return m.end()
    return len(text)


_ITEM = re.compile(r"[;{(\[]")


def item_end(text: str, at: int) -> int:
    """The offset behind an item's semicolon or body, brackets before it aside."""
    while (m := _ITEM.search(text, at)) and m[0] in "([":
        at = closing(text, m.start())
    if not m:
        return len(text) + 1
    return closing(text, m.start()) if m[0] == "{" else m.end()


class Depths:
    """Brace depth before every offset that isn't a brace itself."""

    def __init__(self, text: str):
        self.at, self.depth = [], [0]
        for m in _BRACES.finditer(text):
            self.at.append(m.start())
            self.depth.append(self.depth[-1] + 1 if m[0] == "{" else max(self.depth[-1] - 1, 0))

    def __getitem__(self, offset: int) -> int:
        return self.depth[bisect_left(self.at, offset)]


def squeezed(text: str) -> str:
    return " ".join(text.split())


class Recorder:
    """Collects one file's symbols and edges; knows which names are seen and which span encloses an offset."""

    def __init__(self, path: str, src: str):
        self.path, self.out = path, Extracted()
        self.breaks = [m.start() for m in re.finditer("\n", src)]
        self.ids: dict[str, str] = {}
        self.spans: list[tuple[int, int, str]] = []
        self.module = symbol_id(path, path, "module")
        self.has_module = False

    def line(self, offset: int) -> int:
        return bisect_right(self.breaks, offset - 1) + 1

    def symbol(self, name: str, kind: str, start: int, end: int, signature: str = "", encloses: bool = False, path: str | None = None) -> str:
        """``start`` and ``end`` are offsets of the declaration, the end behind it."""
        sid = symbol_id(self.path if path is None else path, name, kind)
        row = {
            "id": sid, "name": name, "kind": kind, "file": self.path, "start_line": self.line(start),
            "end_line": self.line(max(start, end - 1)), "signature": signature, "doc_comment": "",
        }
        self.out.symbols.append(row)
        if kind != "module":
            self.ids[name] = sid
        if encloses:
            self.spans.append((start, end, sid))
        return sid

    def file_module(self) -> str:
        if not self.has_module:
            self.has_module = True
            self.symbol(self.path, "module", 0, 1)
        return self.module

    def edge(self, a: str, b: str, kind: str, at: int) -> None:
        self.out.edges.append({"from_id": a, "to_id": b, "kind": kind, "file": self.path, "line": self.line(at)})

    def imports(self, target: str, start: int, end: int) -> None:
        """An imported module is one node, whoever imports it."""
        here = self.file_module()
        self.edge(here, self.symbol(target, "module", start, end, path=target), "imports", start)

    def resolve(self, name: str, kind: str = "function") -> str:
        """The id of a name seen in this file, or the one it would have here."""
        return self.ids.get(name) or symbol_id(self.path, name, kind)

    def caller(self, at: int) -> str:
        """The innermost recorded span around an offset, or the file."""
        best = max(((s, i) for s, e, i in self.spans if s <= at < e), default=None)
        return best[1] if best else self.module

    def call(self, name: str, at: int, kind: str = "function") -> None:
        self.edge(self.caller(at), self.resolve(name, kind), "calls", at)


CALL = re.compile(rf"({IDENT})\s*\(")
#: A name is tried from its first letter only: a later one is followed by the same.
_CALL = re.compile(rf"(?<![A-Za-z_$])({IDENT})\s*\(")
_GENERIC_CALL = re.compile(rf"(?<![A-Za-z_$])({IDENT})\s*(?:<[\w\s,.<>\[\]?]*>)?\s*\(")
_BEFORE = re.compile(rf"({IDENT})\s*$")
_HEAD = re.compile(rf"(?:(?:{IDENT}|[)\]])(?:\s*(?:\?\.|\.|::)\s*))+$")


def calls(text: str, skip: frozenset[str], not_after: frozenset[str] = frozenset(), generics: bool = False):
    """``(name, offset of the callee expression)`` of call expressions: a plain name, or the last part of a dotted one."""
    words = tuple(not_after)
    for m in (_GENERIC_CALL if generics else _CALL).finditer(text):
        name, at = m[1], m.start()
        if name in skip:
            continue
        start = at
        ahead = text[max(0, at - 200) : at]
        head = _HEAD.search(ahead) if ahead.rstrip().endswith((".", "::")) else None
        if head:
            start = at - len(head[0])
        if words and (ahead := text[max(0, start - 40) : start]).rstrip().endswith(words):
            before = _BEFORE.search(ahead)
            if before and before[1] in not_after:
                continue
        yield name, start, at
