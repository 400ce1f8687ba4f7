"""Joins whose left side may hold one key in a large share of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", salt: Column | None = None) -> DataFrame:
    """``left`` joined to ``right`` on column ``on``, each key's rows of ``left`` dealt to SALTS groups.

    ``right``, the smaller side, is repeated for every group. ``salt`` is a hash of the
    whole row unless given; give another one where whole rows repeat, and where it
    isn't a function of the row's values, only on rows that are read from a table.
    """
    dealt = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]) if salt is None else salt
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    parts = left.withColumn("_salt", F.pmod(dealt, F.lit(SALTS)).cast("int"))
    return parts.join(right.withColumn("_salt", every), [on, "_salt"], how).drop("_salt")
