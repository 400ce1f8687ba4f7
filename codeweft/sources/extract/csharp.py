"""C#: one pass in source order."""

from __future__ import annotations

import re

from codeweft.sources.extract.base import IDENT, Extracted, Recorder, calls, closing, mask

LANGUAGE, EXTENSIONS = "csharp", (".cs",)
_NOT_CALLS = frozenset("if for foreach while switch catch using lock fixed return typeof sizeof nameof default checked unchecked when base this new await throw in out ref is as".split())
_MODIFIER = r"(?:(?:public|private|protected|internal|static|virtual|override|abstract|sealed|async|extern|unsafe|new|partial|readonly)\s+)"
_MODIFIERS = _MODIFIER + "*"
_RETURNED = r"[\w.<>\[\],?]+(?:\s*<[^(){};]*>)?[?\[\]]*\s+"
#: Without modifiers a type or a name is tried from where it begins, so that a long word isn't tried from each of its letters.
_MEMBER = re.compile(rf"((?:{_MODIFIER}+(?:{_RETURNED})?|(?<![\w.<>\[\],?]){_RETURNED}|(?<![A-Za-z_$]))({IDENT})\s*(?:<[^(){{}};]*>)?\s*)\(")
_TYPE = re.compile(rf"({_MODIFIERS})\b(class|interface)\s+({IDENT})\s*(?:<[^{{}};:]*>)?([^{{;]*)\{{")
_USING = re.compile(r"^[ \t]*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;", re.M)
_LISTED = re.compile(r"\s*:(.*?)(?:\bwhere\b|$)", re.S)
_INITIALIZER = re.compile(r"\s*(?::\s*(?:base|this)\s*\()?")
_BODY = re.compile(r"\s*(?:where[^{;]*)?(\{|=>|;)")
_BREAK = re.compile(r"[(){};]")


def _members(text: str, at: int, end: int):
    """What ``_MEMBER`` finds from ``at`` on: it holds none of ``(){};`` but its last, so each stretch up to a parenthesis is looked at by itself."""
    for m in _BREAK.finditer(text, at, end):
        if m[0] == "(" and (found := _MEMBER.search(text, at, m.end())):
            yield found
        at = m.end()


def extract(path: str, src: str) -> Extracted:
    text, rec = mask(src, quotes="\"'"), Recorder(path, src)
    declared: set[int] = set()
    events: list = [(m.start(), _using, m) for m in _USING.finditer(text)]
    events += [(m.start(2), _type, m) for m in _TYPE.finditer(text)]
    events += [(start, None, (name, start, at)) for name, start, at in calls(text, _NOT_CALLS, frozenset(("new",)), generics=True)]
    for _, run, what in sorted(events, key=lambda e: e[0]):
        if run:
            run(rec, text, what, declared)
        elif what[2] not in declared:
            rec.call(what[0], what[1], "method")
    return rec.out


def _using(rec: Recorder, text: str, m: re.Match, declared: set[int]) -> None:
    at = m.start() + len(m[0]) - len(m[0].lstrip())
    rec.imports(m[1], at, m.end())


def _base_name(item: str) -> str:
    item = item.strip()
    plain = re.match(r"[\w.]+", item)
    return plain[0].split(".")[-1] if plain else ""


def _type(rec: Recorder, text: str, m: re.Match, declared: set[int]) -> None:
    start, end, kind, name = m.start(), closing(text, m.end() - 1), m[2], m[3]
    start += len(m[0]) - len(m[0].lstrip())
    sid = rec.symbol(name, kind, start, end, f"{kind} {name}", encloses=kind == "class")
    listed = _LISTED.match(m[4])
    bases = [b for b in map(_base_name, _split(listed[1])) if b] if listed else []
    for i, base in enumerate(bases):
        looks = base.startswith("I") and base != "I"
        edge = "extends" if i == 0 and not looks else "implements"
        rec.edge(sid, rec.resolve(base, "interface" if base.startswith("I") else "class"), edge, start)
    if kind == "interface":
        k = m.end()
        for d in _members(text, k, end):
            declared.add(d.start(2))
        return
    k = m.end()
    while k < end - 1:
        found, inner = next(_members(text, k, end), None), text.find("{", k, end)
        if found and (inner < 0 or found.start(2) < inner):
            stop = closing(text, found.end() - 1)
            after = _INITIALIZER.match(text, stop)
            if after[0].rstrip().endswith("("):
                stop = closing(text, after.end() - 1)
            body = _BODY.match(text, stop)
            if body and found[2] not in _NOT_CALLS:
                stop = closing(text, body.end() - 1) if body[1] == "{" else text.find(";", body.start(1)) + 1 or end
                declared.add(found.start(2))
                at = found.start(1) + len(found[1]) - len(found[1].lstrip())
                rec.symbol(f"{name}.{found[2]}", "method", at, stop, f"{name}.{found[2]}()", encloses=True)
            k = max(stop, found.end())
        elif inner >= 0:
            k = closing(text, inner)
        else:
            break


def _split(text: str) -> list[str]:
    """Comma-separated parts, commas in angle brackets aside."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
