"""Full-text search over symbols by an inverted index.

The index has a row for each token, column and symbol, with the token's positions.
Kept as a table sorted by token, a query reads the files that may hold its own
tokens and prefixes, and nothing of other texts. Ids are taken to be unique.
"""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.match import COLUMNS, Token, compile_match, parse, wanted
from codeweft.functions.text import tokens
from codeweft.operators.search import read_symbols

DEFAULT_LIMIT = 20
POSTINGS = "term string, field string, id string, positions array<int>"
#: What the index is sorted by: a token of most symbols has many rows, which several files hold.
POSTINGS_KEY = ("term", "id", "field")


class Index(Protocol):
    """Rows of POSTINGS, found by term."""

    def near(self, keys: list[str], prefixes: list[str]) -> DataFrame: ...


def _placed(found: Column) -> Column:
    """``(term, positions)`` of each token of a text, from its tokens in order: they are sorted and cut where the term changes."""
    own = F.sort_array(F.transform(found, lambda x, i: F.struct(x.alias("term"), (i + 1).alias("at"))))

    def cut(every: Column) -> Column:
        first = F.transform(every, lambda x, i: F.when(~x["term"].eqNullSafe(F.get(every, i - 1)["term"]), i))
        return _held(F.filter(first, lambda i: i.isNotNull()), lambda starts: runs(every, starts))

    def runs(every: Column, starts: Column) -> Column:
        def one(at: Column, k: Column) -> Column:
            length = F.coalesce(F.get(starts, k + 1), F.size(every)) - at
            places = F.transform(F.slice(every, at + 1, length), lambda x: x["at"])
            return F.struct(F.get(every, at)["term"].alias("term"), places.alias("positions"))

        return F.transform(starts, one)

    return _held(own, cut)


def _held(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def index(symbols: DataFrame) -> DataFrame:
    """The rows of POSTINGS of all symbols; absent texts have none. A text's rows are made where it is read: nothing is shuffled."""
    fields = [F.struct(F.lit(c).alias("field"), _placed(tokens(F.col(c))).alias("held")) for c in COLUMNS]
    each = symbols.select("id", F.inline(F.array(*fields)))
    return each.select("id", "field", F.inline("held")).select("term", "field", "id", "positions")


def matches(indexed: DataFrame | Index, query: str) -> DataFrame:
    """``id`` of what matches, each once; a query that doesn't parse raises MatchError."""
    tree = parse(query)
    asked = wanted(tree)
    exact = sorted({t.text for t in asked if not t.prefix})
    starts = sorted({t.text for t in asked if t.prefix})
    if isinstance(indexed, DataFrame):
        tests = [F.col("term").isin(exact)] if exact else []
        tests += [F.col("term").startswith(p) for p in starts]
        rows = indexed.where(reduce(lambda a, b: a | b, tests, F.lit(False)))
    else:
        rows = indexed.near(exact, starts)

    def fits(t: Token) -> Column:
        own = F.col("term").startswith(t.text) if t.prefix else F.col("term") == t.text
        return (F.col("field") == t.column) & own

    if not asked:
        return rows.select("id").limit(0)
    names = {t: f"p{i}" for i, t in enumerate(asked)}
    rows = rows.where(reduce(lambda a, b: a | b, [fits(t) for t in asked]))
    held = [F.flatten(F.collect_list(F.when(fits(t), F.col("positions")))).alias(n) for t, n in names.items()]
    return rows.groupBy("id").agg(*held).where(compile_match(tree, lambda t: F.col(names[t]))).select("id")


def search(symbols: DataFrame, query: str, limit: int = 0, indexed: DataFrame | Index | None = None) -> DataFrame:
    """Symbols that match, each once, by id; a limit of 0 or less means 20."""
    hits = matches(index(symbols) if indexed is None else indexed, query)
    found = read_symbols(symbols.join(hits, "id", "left_semi"))
    return found.orderBy("id").limit(limit if limit > 0 else DEFAULT_LIMIT)
