"""Language scanners, by file extension."""

from __future__ import annotations

import os
from collections.abc import Callable

from codeweft.sources.extract import csharp, ecma, go, python, rust, zig
from codeweft.sources.extract.base import Extracted

Scanner = Callable[[str, str], Extracted]

_REGISTRY: dict[str, Scanner] = {}


def register(extensions: tuple[str, ...], scan: Scanner) -> None:
    """A later registration of an extension replaces an earlier one."""
    for e in extensions:
        _REGISTRY[e.lower()] = scan


for _module in (go, python, csharp, rust, zig):
    register(_module.EXTENSIONS, _module.extract)
register((".ts", ".tsx"), ecma.typescript)
register((".js", ".jsx", ".mjs", ".cjs"), ecma.javascript)


def extensions() -> tuple[str, ...]:
    return tuple(sorted(_REGISTRY))


def extract(path: str, src: str) -> Extracted:
    """Symbols and edges of one file; nothing for an extension that isn't registered."""
    scan = _REGISTRY.get(os.path.splitext(path)[1].lower())
    return scan(path, src) if scan else Extracted()
