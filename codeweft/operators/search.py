"""Filters, lookups, counts, pages and statistics over the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.text import contains, shortened

DEFAULT_LIMIT = 100
COUNTS = ("symbol_count", "edge_count", "file_count")


def read_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols with absent signatures and comments as empty strings."""
    blank = {c: F.coalesce(c, F.lit("")) for c in ("signature", "doc_comment")}
    return symbols.withColumns(blank)


def matching(
    symbols: DataFrame, name: str = "", kind: str = "", exclude_kind: str = "", project_id: str = "", file: str = ""
) -> DataFrame:
    """Symbols that meet every filter that is set."""
    tests: list[Column] = []
    if name:
        tests.append(contains(F.col("name"), name))
    if kind:
        tests.append(F.col("kind") == kind)
    if exclude_kind:
        tests.append(F.col("kind") != exclude_kind)
    if project_id:
        tests.append(F.col("project_id") == project_id)
    if file:
        tests.append(F.col("file") == file)
    for t in tests:
        symbols = symbols.where(t)
    return symbols


def search(symbols: DataFrame, limit: int = 0, offset: int = 0, **filters: str) -> DataFrame:
    """A page of the matches by (name, id); a limit of 0 or less means 100, a negative offset 0."""
    found = read_symbols(matching(symbols, **filters)).orderBy("name", "id")
    return found.offset(max(offset, 0)).limit(limit if limit > 0 else DEFAULT_LIMIT)


def page(symbols: DataFrame, number: int = 1, size: int = 100, **filters: str) -> DataFrame:
    """Page ``number`` from 1, of 1 to 500 symbols."""
    size = min(max(size, 1), 500)
    return search(symbols, size, (max(number, 1) - 1) * size, **filters)


def lookup(symbols: DataFrame, symbol_id: str) -> DataFrame:
    """The symbol with this id; no row if there is none."""
    return read_symbols(symbols.where(F.col("id") == symbol_id)).limit(1)


def file_state(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == path).select("path", "hash", "mod_time").limit(1)


def count_symbols(symbols: DataFrame, **filters: str) -> DataFrame:
    return matching(symbols, **filters).agg(F.count("*").alias("n"))


def count_edges(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("n"))


def valid_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with both ends present."""
    out = edges
    for end in ("from_id", "to_id"):
        out = out.join(symbols.select(F.col("id").alias(end)), end, "left_semi")
    return out.select(*edges.columns)


def orphan_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with an end missing."""
    ids = symbols.select("id").distinct()
    a = ids.select(F.col("id").alias("from_id"), F.lit(True).alias("has_from"))
    b = ids.select(F.col("id").alias("to_id"), F.lit(True).alias("has_to"))
    out = edges.join(a, "from_id", "left").join(b, "to_id", "left")
    return out.where("has_from is null or has_to is null").select(*edges.columns)


def edges_from(edges: DataFrame, symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that leave the nodes for a symbol that exists."""
    out = edges.join(nodes.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    return out.join(symbols.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(*edges.columns)


def edges_within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    out = edges
    for end in ("from_id", "to_id"):
        out = out.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return out.select(*edges.columns)


def display_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (from, to, kind)."""
    return edges.select("from_id", "to_id", "kind").distinct()


def with_ghosts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(id, name, kind, ghost)``: the nodes, and one ghost of kind unknown for each link's target that isn't among them.

    A ghost is named by the first eight characters of its id. Links without a target give none.
    """
    have = nodes.select("id", "name", "kind", F.lit(False).alias("ghost"))
    absent = links.where("to_id is not null").select(F.col("to_id").alias("id")).distinct().join(have.select("id"), "id", "left_anti")
    return have.union(absent.select("id", F.substring("id", 1, 8).alias("name"), F.lit("unknown").alias("kind"), F.lit(True).alias("ghost")))


def drawn_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Links that can be drawn among the nodes and their ghosts: those whose source is a node or a ghost."""
    return edges_within(links, with_ghosts(nodes, links))


def labelled(nodes: DataFrame, length: int = 18) -> DataFrame:
    """Nodes with a ``label`` of at most ``length`` characters."""
    return nodes.withColumn("label", shortened(F.col("name"), length))


def highlighted(links: DataFrame, symbol_id: str) -> DataFrame:
    """All links, and whether they touch the symbol; an absent end doesn't."""
    touches = F.col("from_id").eqNullSafe(symbol_id) | F.col("to_id").eqNullSafe(symbol_id)
    return links.withColumn("highlighted", touches)


def project_stats(projects: DataFrame, symbols: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols, edges by the project of their source, and files of each registered project; 0 where there are none."""
    per = lambda df, name: df.groupBy("project_id").agg(F.count("*").alias(name))
    owner = symbols.select(F.col("id").alias("from_id"), "project_id")
    counts = (per(symbols, "symbol_count"), per(edges.join(owner, "from_id"), "edge_count"), per(files, "file_count"))
    out = projects.select(F.col("id").alias("project_id"))
    for c in counts:
        out = out.join(c, "project_id", "left")
    return out.fillna(0, list(COUNTS))


def counted_stats(projects: DataFrame, totals: DataFrame) -> DataFrame:
    """As project_stats, from counts that are kept: one row a project is read."""
    own = projects.select(F.col("id").alias("project_id"))
    return own.join(totals.select("project_id", *COUNTS), "project_id", "left").fillna(0, list(COUNTS))
