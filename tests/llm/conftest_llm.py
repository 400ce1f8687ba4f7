"""Small tables with every awkward case the operators define."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rnd: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rnd.randrange(vocabulary)}é" if rnd.random() < 0.1 else f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def make(spark, rows):
    """Documents from (id, text), with columns whose names clash with what operators compute."""
    full = [(i, t, "en", "s", 0, "k", 1, "x") for i, t in rows]
    return spark.createDataFrame(full, f"{SCHEMA}, kept string, n_words int, component_id string")


def awkward(seed: int = 1) -> list[tuple]:
    rnd = random.Random(seed)
    base = [words(rnd, rnd.choice((6, 15, 40, 120))) for _ in range(14)]
    rows = [(i + 10, t) for i, t in enumerate(base)]
    near = base[3].split()
    rows += [(100, base[3]), (101, base[3].upper()), (102, " ".join(near[:-1] + ["changed"])), (102, base[4]), (103, base[4]), (103, base[4])]
    rows += [(104, base[5] + " " + base[6]), (105, words(rnd, 30) + "\n" + base[7] + "\t" + base[7])]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "one"), (204, "one two"), (205, "one two"), (None, base[8]), (None, None)]
    rows += [(300, words(rnd, 6000)), (301, "x" * 30_000), (302, "a\x85b c \x1c d"), (303, "\n".join(["same line here"] * 9))]
    return rows

