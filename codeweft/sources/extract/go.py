"""Go: two passes, so that calls resolve to any declaration of the file."""

from __future__ import annotations

import re

from codeweft.sources.extract.base import CALL, Depths, Extracted, Recorder, calls, closing, mask

LANGUAGE, EXTENSIONS = "go", (".go",)
_NOT_CALLS = frozenset("if for switch select func return go defer case range var const type struct interface map chan else import package".split())


def receiver(text: str) -> str:
    """The type name of a method's receiver: what follows the receiver's name, without the pointer mark."""
    parts = text.strip("()").split()
    return parts[-1].removeprefix("*") if len(parts) >= 2 else ""


def extract(path: str, src: str) -> Extracted:
    text, rec = mask(src), Recorder(path, src)
    depth = Depths(text)
    declared: list[int] = []
    for m in re.finditer(r"^(func|type|var|const|import)\b", text, re.M):
        if depth[m.start()]:
            continue
        {"func": _func, "import": _imports}.get(m[1], _specs)(rec, src, text, m, declared)
    for name, start, at in calls(text, _NOT_CALLS):
        if at not in declared:
            rec.call(name, start)
    return rec.out


def _body(text: str, at: int) -> int:
    """The offset of a function's opening brace, past types with braces of their own; -1 without a body."""
    k = at
    while k < len(text) and text[k] != "\n":
        if text[k] in "([":
            k = closing(text, k)
        elif text[k] == "{":
            if re.search(r"\b(interface|struct)\s*$", text[at:k]):
                k = closing(text, k)
            else:
                return k
        else:
            k += 1
    return -1


def _func(rec: Recorder, src: str, text: str, m: re.Match, declared: list[int]) -> None:
    at, owner = m.end(), ""
    while at < len(text) and text[at] in " \t":
        at += 1
    method = text[at : at + 1] == "("
    if method:
        end = closing(text, at)
        owner, at = receiver(src[at:end]), end
    name = re.compile(r"\s*([A-Za-z_]\w*)").match(text, at)
    if not name:
        return
    declared.append(name.start(1))
    brace = _body(text, name.end())
    end = closing(text, brace) if brace >= 0 else (text + "\n").index("\n", name.end())
    signature = src[m.start() : brace if brace >= 0 else end].strip()
    full = f"{owner}.{name[1]}" if owner else name[1]
    rec.symbol(full, "method" if method else "function", m.start(), end, signature, encloses=True)


def _entries(text: str, at: int):
    """``(start, end)`` of the specs of a declaration, grouped or single."""
    while at < len(text) and text[at] in " \t":
        at += 1
    if text[at : at + 1] != "(":
        yield at, _spec_end(text, at)
        return
    stop = closing(text, at) - 1
    k = at + 1
    while k < stop:
        if text[k].isspace() or text[k] == ";":
            k += 1
            continue
        end = min(_spec_end(text, k), stop)
        yield k, end
        k = max(end, k + 1)


def _spec_end(text: str, at: int) -> int:
    while at < len(text) and text[at] not in "\n;":
        at = closing(text, at) if text[at] in "([{" else at + 1
    return at


def _specs(rec: Recorder, src: str, text: str, m: re.Match, declared: list[int]) -> None:
    for start, end in _entries(text, m.end()):
        name = re.compile(r"([A-Za-z_]\w*)(\s*\[[^\]]*\])?\s*(=?)\s*(interface\b)?").match(text, start)
        if not name:
            continue
        if m[1] != "type":
            rec.symbol(name[1], "variable", start, end, name[1])
        elif not name[3]:
            rec.symbol(name[1], "interface" if name[4] else "type", start, end, name[1])
            if name[4]:  # its methods are declared, not called
                declared.extend(c.start(1) for c in CALL.finditer(text, name.end(), end))


def _imports(rec: Recorder, src: str, text: str, m: re.Match, declared: list[int]) -> None:
    """A grouped import names the file's module and no targets."""
    rec.file_module()
    single = re.compile(r'[ \t]*(?:[\w.]+[ \t]+)?["`]([^"`\n]*)["`]').match(src, m.end())
    if single:
        rec.imports(single[1], m.start(), single.end())
