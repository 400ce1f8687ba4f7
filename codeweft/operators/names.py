"""Names by part: an index of trigrams that finds candidates, which the pattern itself then verifies.

The index has a row for each symbol and each three characters of its folded name. A
pattern's literal stretches of three characters or more name the trigrams that every
match has; a pattern without such a stretch has no candidates to offer, and all names
are scanned.
"""

from __future__ import annotations

import re
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.text import LOWER, UPPER

GRAMS = "gram string, id string"
GRAMS_KEY = ("gram", "id")
SIZE = 3


class Index(Protocol):
    """Rows of GRAMS, found by trigram."""

    def near(self, keys: list[str]) -> DataFrame: ...


def index(symbols: DataFrame) -> DataFrame:
    """The rows of GRAMS of all symbols; names of fewer than three characters have none."""
    folded = symbols.where(F.char_length("name") >= SIZE).select("id", F.translate("name", UPPER, LOWER).alias("name"))
    starts = F.sequence(F.lit(1), F.char_length("name") - (SIZE - 1))
    return folded.select(F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("name"), i, F.lit(SIZE))))).alias("gram"), "id")


def grams_of(part: str) -> list[str]:
    """The trigrams of a pattern's literal stretches; ``%`` and ``_`` part them."""
    stretches = re.split("[%_]", part.translate(str.maketrans(UPPER, LOWER)))
    return sorted({s[i : i + SIZE] for s in stretches for i in range(len(s) - SIZE + 1)})


def candidates(indexed: Index | DataFrame, part: str) -> DataFrame | None:
    """``id`` of the names that hold all trigrams of the pattern; None if it has none."""
    grams = grams_of(part)
    if not grams:
        return None
    rows = indexed.where(F.col("gram").isin(grams)) if isinstance(indexed, DataFrame) else indexed.near(grams)
    if len(grams) == 1:
        return rows.select("id")
    return rows.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("id")
