"""Zig: two passes over the declarations at the top level."""

from __future__ import annotations

import re

from codeweft.sources.extract.base import Depths, Extracted, Recorder, calls, closing, item_end, mask

LANGUAGE, EXTENSIONS = "zig", (".zig",)
_NOT_CALLS = frozenset("if for while switch fn return catch orelse and or const var pub struct enum union error defer errdefer try else test comptime inline".split())
_FN = re.compile(r"(?:pub\s+|export\s+|inline\s+|extern\s+(?:\"[^\"]*\"\s+)?)*fn\s+(\w+)")
_DECLARED = re.compile(r"^[ \t]*((?:pub\s+|export\s+|inline\s+|extern\s+)*)(fn|const|var)\s+(\w+)", re.M)
_HELD = re.compile(r"\b(struct|enum|union)\b\s*(?:\([^)]*\)\s*)?\{")
_IMPORT = re.compile(r'@import\(\s*"([^"\n]*)"')
_STOP = re.compile(r"[;(\[{]")


def _statement(text: str, at: int) -> int:
    while (m := _STOP.search(text, at)) and m[0] != ";":
        at = closing(text, m.start())
    return m.end() if m else len(text)


def extract(path: str, src: str) -> Extracted:
    text, rec = mask(src, block=None, quotes="\"'"), Recorder(path, src)
    depth, declared = Depths(text), set()
    rec.file_module()
    for m in _DECLARED.finditer(text):
        if depth[m.start(2)]:
            continue
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        if m[2] == "fn":
            declared.add(m.start(3))
            rec.symbol(m[3], "function", at, item_end(text, m.end()), f"fn {m[3]}", encloses=True)
            continue
        end = _statement(text, m.end())
        held = _HELD.search(text[m.end() : end])
        if held:
            rec.symbol(m[3], "type", at, end, f"const {m[3]}")
            if held[1] != "enum":
                _methods(rec, text, m[3], m.end() + held.end() - 1, declared)
        elif found := _IMPORT.search(src[m.end() : end]):
            rec.imports(found[1], at, end)
    for name, start, at in calls(text, _NOT_CALLS):
        if at not in declared and text[at - 1 : at] != "@":
            rec.call(name, start)
    return rec.out


def _methods(rec: Recorder, text: str, owner: str, brace: int, declared: set[int]) -> None:
    end, k = closing(text, brace), brace + 1
    while found := _FN.search(text, k, end):
        inner = text.find("{", k, end)
        if 0 <= inner < found.start():
            k = closing(text, inner)
            continue
        stop = item_end(text, found.end())
        declared.add(found.start(1))
        rec.symbol(f"{owner}.{found[1]}", "method", found.start(), stop, f"fn {found[1]}", encloses=True)
        k = stop
