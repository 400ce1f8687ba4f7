"""Python: one pass over logical lines by indentation; nothing fails on broken files."""

from __future__ import annotations

import re

from codeweft.sources.extract.base import Extracted, Recorder, calls

LANGUAGE, EXTENSIONS = "python", (".py",)
_NOT_CALLS = frozenset("if elif while for in is not and or return lambda def class print_ with as assert del except import from yield await async else raise global nonlocal pass".split())


def _masked(src: str) -> str:
    out, i, n = list(src), 0, len(src)
    while i < n:
        if src[i] == "#":
            end = src.find("\n", i)
            end = n if end < 0 else end
        elif src[i] in "'\"":
            q = src[i : i + 3] if src[i : i + 3] in ("'''", '"""') else src[i]
            k = i + len(q)
            while k < n and not src.startswith(q, k) and not (len(q) == 1 and src[k] == "\n"):
                k += 2 if src[k] == "\\" else 1
            end = min(k + len(q), n)
        else:
            i += 1
            continue
        for k in range(i, end):
            if out[k] != "\n":
                out[k] = " "
        i = end
    return "".join(out)


def _logical(text: str):
    """``(start, end, indent)`` of logical lines: brackets and backslashes join lines."""
    start, depth = 0, 0
    for k, c in enumerate(text + "\n"):
        depth += (c in "([{") - (c in ")]}" and depth > 0)
        if c == "\n" and not depth and not text[start:k].endswith("\\"):
            line = text[start:k]
            if line.strip():
                yield start, k, len(line) - len(line.lstrip())
            start = k + 1
    if start < len(text) and text[start:].strip():
        yield start, len(text), 0


def extract(path: str, src: str) -> Extracted:
    text, rec = _masked(src), Recorder(path, src)
    lines = list(_logical(text))
    ends = []
    for i, (_, end, indent) in enumerate(lines):
        last = end
        for start2, end2, indent2 in lines[i + 1 :]:
            if indent2 <= indent:
                break
            last = end2
        ends.append(last)
    classes: list[tuple[int, int, str]] = []
    for i, (start, end, indent) in enumerate(lines):
        line = text[start:end]
        at = start + indent
        while classes and classes[-1][1] <= start:
            classes.pop()
        if m := re.match(r"\s*(?:async\s+)?def\s+(\w+)", line):
            owner = classes[-1][2] if classes else ""
            name = f"{owner}.{m[1]}" if owner else m[1]
            rec.symbol(name, "method" if owner else "function", at, ends[i], f"def {m[1]}(...)")
            inside = (start + m.end(), end)
            skipped = inside[0]
        elif m := re.match(r"\s*class\s+(\w+)", line):
            rec.symbol(m[1], "class", at, ends[i], f"class {m[1]}")
            classes.append((start, ends[i], m[1]))
            colon = re.search(r":\s*\S", line[m.end() :])
            inside = (start + m.end() + colon.start() if colon else end, end)
            skipped = -1
        elif re.match(r"\s*(import|from)\b", line):
            _import(rec, src[start:end], at, end)
            continue
        else:
            inside, skipped = (start, end), -1
        part = text[inside[0] : inside[1]]
        for name, head, where in calls(part, _NOT_CALLS):
            if inside[0] + where != skipped:
                rec.edge(rec.module, rec.resolve(name), "calls", inside[0] + head)
    return rec.out


def _import(rec: Recorder, statement: str, start: int, end: int) -> None:
    rec.file_module()
    flat = re.sub(r"#[^\n]*", " ", statement).replace("\\\n", " ").strip()
    if m := re.match(r"from\s+(\S+)\s+import\b", flat):
        target = m[1].removeprefix(".")
        if target:
            rec.imports(target, start, end)
    elif m := re.match(r"import\s+(.*)", flat, re.S):
        for item in m[1].split(","):
            name = item.split(" as ")[0].strip()
            if name:
                rec.imports(name, start, end)
