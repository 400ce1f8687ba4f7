"""TypeScript and JavaScript: one pass in source order, so that calls resolve to what comes before them."""

from __future__ import annotations

import re

from codeweft.sources.extract.base import IDENT, Extracted, Recorder, calls, closing, mask

_NOT_CALLS = frozenset("if for while switch catch function return typeof await constructor super import new delete void in of do else yield async get set static".split())
_NOT_AFTER = frozenset(("new", "function"))
_METHOD = re.compile(
    rf"(?:^|(?<=[\n;}}{{]))[ \t]*((?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*\*?\s*(#?{IDENT})\s*(?:<[^>(){{}}]*>)?\s*\()", re.M
)
_ARROW = re.compile(rf"(?:async\s+)?(?:<[^>(){{}}]*>\s*)?(?:\((?P<open>)|{IDENT}\s*=>)")
_ARROW_HEAD = re.compile(r"\s*(?::[^={};\n]*)?=>")
_FUNCTION = re.compile(rf"\bfunction\b\s*\*?\s*({IDENT})\s*(?:<[^>(){{}}]*>)?\s*\(")
_FUNCTION_VALUE = re.compile(rf"(?:async\s+)?function\b\s*\*?\s*(?:{IDENT})?\s*\(")
_VARIABLE = re.compile(rf"\b(?:const|let|var)\s+({IDENT})\s*(?::[^=;\n]*(?:=>[^=;\n]*)?)?=(?!=|>)\s*")
_CLASS = re.compile(rf"(?<!abstract )\bclass\s+({IDENT})([^{{;]*)\{{")
_INTERFACE = re.compile(rf"\binterface\s+({IDENT})[^{{;]*\{{")
_IMPORT = re.compile(r"^[ \t]*import\b(?!\s*\()", re.M)
_IMPORTED = re.compile(r"""import\b[^;'"`]*['"]([^'"\n]*)['"]""")
_BODY = re.compile(r"\s*(?::[^={};]*(?:\{[^{}]*\}[^={};]*)?)?\s*\{")
_BRACE = re.compile(r"\s*\{")
_STOP = re.compile(r"[;\n)(\[{]")


class _Scan:
    def __init__(self, path: str, src: str, typescript: bool):
        self.src, self.text, self.ts = src, mask(src), typescript
        self.rec = Recorder(path, src)
        self.declared: set[int] = set()

    def run(self) -> Extracted:
        events = [(m.start(), self._function, m) for m in _FUNCTION.finditer(self.text)]
        events += [(m.start(), self._variable, m) for m in _VARIABLE.finditer(self.text)]
        events += [(m.start(), self._class, m) for m in _CLASS.finditer(self.text)]
        if self.ts:
            events += [(m.start(), self._interface, m) for m in _INTERFACE.finditer(self.text)]
        events += [(m.start(), self._import, m) for m in _IMPORT.finditer(self.text)]
        events += [(start, self._call, (name, start, at)) for name, start, at in calls(self.text, _NOT_CALLS, _NOT_AFTER, generics=self.ts)]
        for _, run, what in sorted(events, key=lambda e: e[0]):
            run(what)
        return self.rec.out

    def _end(self, at: int) -> int:
        """The end of a function from its parameter list at ``at``: behind its body, or its line."""
        k = closing(self.text, at)
        brace = _BODY.match(self.text, k)
        return closing(self.text, brace.end() - 1) if brace else k

    def _function(self, m: re.Match) -> None:
        self.declared.add(m.start(1))
        self.rec.symbol(m[1], "function", m.start(), self._end(m.end() - 1), f"function {m[1]}", encloses=True)

    def _variable(self, m: re.Match) -> None:
        """Only variables that hold an arrow function (in JavaScript a function expression as well)."""
        text, at = self.text, m.end()
        a = _ARROW.match(text, at)
        arrow = -1
        if a and a["open"] is None:
            arrow = a.end()
        elif a:
            found = _ARROW_HEAD.match(text, closing(text, a.end() - 1))
            arrow = found.end() if found else -1
        body = -1
        if arrow >= 0:
            brace = _BRACE.match(text, arrow)
            body = closing(text, brace.end() - 1) if brace else self._statement_end(arrow)
        elif not self.ts:
            f = _FUNCTION_VALUE.match(text, at)
            if f:
                body = self._end(f.end() - 1)
        if body >= 0:
            self.rec.symbol(m[1], "function", m.start(1), body, f"const {m[1]} = () => ...", encloses=True)

    def _statement_end(self, at: int) -> int:
        text = self.text
        while (m := _STOP.search(text, at)) and m[0] in "([{":
            at = closing(text, m.start())
        return m.start() if m else len(text)

    def _class(self, m: re.Match) -> None:
        text, rec = self.text, self.rec
        end = closing(text, m.end() - 1)
        start = m.start()
        sid = rec.symbol(m[1], "class", start, end, f"class {m[1]}", encloses=True)
        if self.ts:
            head = m[2]
            base = re.search(rf"\bextends\s+({IDENT})\s*(?:\bimplements\b|$)", head.rstrip())
            if base:
                rec.edge(sid, rec.resolve(base[1], "class"), "extends", start)
            listed = re.search(r"\bimplements\b(.*)$", head, re.S)
            for item in (listed[1].split(",") if listed else ()):
                if re.fullmatch(IDENT, item.strip()):
                    rec.edge(sid, rec.resolve(item.strip(), "interface"), "implements", start)
        k = m.end()
        while k < end - 1:  # members stand directly in the body
            found = _METHOD.search(text, k, end)
            inner = text.find("{", k, end)
            if found and (inner < 0 or found.start(1) < inner):
                open_at = found.end() - 1
                stop = self._end(open_at)
                if text[stop - 1] == "}":
                    self.declared.add(found.start(2))
                    at = found.start(1) + len(found[1]) - len(found[1].lstrip())
                    rec.symbol(f"{m[1]}.{found[2]}", "method", at, stop, f"{m[1]}.{found[2]}()", encloses=True)
                k = stop
            elif inner >= 0:
                k = closing(text, inner)
            else:
                break

    def _interface(self, m: re.Match) -> None:
        self.rec.symbol(m[1], "interface", m.start(), closing(self.text, m.end() - 1), f"interface {m[1]}")

    def _import(self, m: re.Match) -> None:
        at = m.start() + len(m[0]) - len(m[0].lstrip())
        found = _IMPORTED.match(self.src, at)
        self.rec.file_module()
        if found:
            self.rec.imports(found[1].strip("'\"`"), at, found.end())

    def _call(self, what: tuple[str, int, int]) -> None:
        name, start, at = what
        if at not in self.declared:
            self.rec.call(name, start)


def typescript(path: str, src: str) -> Extracted:
    return _Scan(path, src, True).run()


def javascript(path: str, src: str) -> Extracted:
    return _Scan(path, src, False).run()
