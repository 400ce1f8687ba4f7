"""Identity of symbols."""

from __future__ import annotations

import hashlib
import posixpath
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=256)
def clean_path(path: str) -> str:
    """Relative paths lexically cleaned, absolute ones as given; always with forward slashes."""
    path = path.replace("\\", "/")
    return path if path.startswith("/") else posixpath.normpath(path) if path else "."


def symbol_id(path: str, name: str, kind: str, project: str = "") -> str:
    """The first 16 bytes, in hex, of SHA-256 over project, path, name and kind."""
    return hashlib.sha256("|".join((project, clean_path(path), name, kind)).encode()).hexdigest()[:32]


def symbol_id_column(path: Column, name: Column, kind: Column, project: Column | None = None) -> Column:
    """As symbol_id, for paths that are clean already."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit("") if project is None else project, path, name, kind), 256), 1, 32)
