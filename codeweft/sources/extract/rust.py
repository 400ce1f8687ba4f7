"""Rust: two passes over the items at the top level."""

from __future__ import annotations

import re

from codeweft.functions.ids import symbol_id
from codeweft.sources.extract.base import Depths, Extracted, Recorder, calls, closing, item_end, mask

LANGUAGE, EXTENSIONS = "rust", (".rs",)
_NOT_CALLS = frozenset("if for while match fn return loop in let as move impl struct enum trait use where unsafe else mut ref pub crate".split())
_VIS = r"(?:pub(?:\s*\([^)]*\))?\s+)?"
_FN = re.compile(rf"{_VIS}(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(\w+)")
_ITEM = re.compile(rf"^[ \t]*({_VIS}(?:(?:const|async|unsafe)\s+)*)(fn|struct|enum|trait|use|impl)\b", re.M)
_NAME = re.compile(r"\s+(\w+)")
_CHARACTER = re.compile(r"'(?:\\.[^']*|[^'\\\n])'")


def _mask(src: str) -> str:
    """Character literals are masked, lifetimes are not."""
    src = _CHARACTER.sub(lambda m: " " * len(m[0]), src)
    return mask(src, quotes='"', raw="", multiline='"')


def extract(path: str, src: str) -> Extracted:
    text, rec = _mask(src), Recorder(path, src)
    depth, declared = Depths(text), set()
    rec.file_module()
    for m in _ITEM.finditer(text):
        if depth[m.start(2)]:
            continue
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        word, end = m[2], item_end(text, m.end())
        name = _NAME.match(text, m.end())
        if word == "use":
            end = text.find(";", m.end()) + 1 or len(text)
            rec.imports(src[at:end].strip().removeprefix("use ").removesuffix(";").strip(), at, end)
        elif word == "impl":
            _impl(rec, text, m, at, declared)
        elif name and word == "fn":
            declared.add(name.start(1))
            rec.symbol(name[1], "function", at, end, f"fn {name[1]}", encloses=True)
        elif name:
            rec.symbol(name[1], "interface" if word == "trait" else "type", at, end, f"{word} {name[1]}")
            if word == "trait":
                declared.update(f.start(1) for f in _FN.finditer(text, at, end))
    for name, start, at in calls(text, _NOT_CALLS):
        if at not in declared:
            rec.call(name, start)
    return rec.out


def _plain(name: str) -> str:
    return name.strip().split("<")[0].strip()


def _impl(rec: Recorder, text: str, m: re.Match, at: int, declared: set[int]) -> None:
    brace = text.find("{", m.end())
    if brace < 0:
        return
    end, head = closing(text, brace), text[m.end() : brace].split(" where ")[0].strip()
    if head.startswith("<"):
        depth = 0
        for k, c in enumerate(head):
            depth += (c == "<") - (c == ">" and head[k - 1 : k] != "-")
            if not depth:
                head = head[k + 1 :].strip()
                break
    trait, split, owner = head.partition(" for ")
    owner = _plain(owner if split else head)
    if split:
        rec.edge(symbol_id(rec.path, owner, "type"), symbol_id(rec.path, _plain(trait), "interface"), "implements", at)
    k = brace + 1
    while found := _FN.search(text, k, end):
        inner = text.find("{", k, end)
        if 0 <= inner < found.start():
            k = closing(text, inner)
            continue
        stop = item_end(text, found.end())
        declared.add(found.start(1))
        rec.symbol(f"{owner}.{found[1]}", "method", found.start(), stop, f"fn {found[1]}", encloses=True)
        k = stop
