"""Text functions: folding, tokens and contains-patterns."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and their base letters, by canonical decomposition."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        if c == c.lower() and (base := unicodedata.normalize("NFD", c))[0].isascii() and base != c:
            pairs.append((c, base[0]))
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


MARKED, BASE = _accents()
_FOLD = str.maketrans(MARKED, BASE)
_TOKEN = re.compile(r"[^\W_]+")


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), MARKED, BASE)


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits, in order; null has none."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), 1)


def tokens_of(text: str) -> list[str]:
    """As tokens, for one string."""
    return _TOKEN.findall(text.lower().translate(_FOLD))


def contains(column: Column, part: str) -> Column:
    """ASCII case-insensitive ``LIKE '%part%'``; ``%`` and ``_`` in ``part`` are wildcards, nothing escapes them."""
    fold_ascii = str.maketrans(UPPER, LOWER)
    pattern = f"%{part.translate(fold_ascii)}%"
    text = F.translate(column, UPPER, LOWER)
    return F.like(text, F.lit(pattern), F.lit("\u0001"))


def shortened(text: Column, length: int) -> Column:
    """The text, or its first ``length - 1`` characters and an ellipsis if it is longer than ``length``; null stays null."""
    return F.when(F.char_length(text) > length, F.concat(F.substring(text, 1, length - 1), F.lit("\u2026"))).otherwise(text)
