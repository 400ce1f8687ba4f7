"""Mutations and change detection as pure functions from old tables to new ones.

Nothing is updated in place: a store commits what these return as a new snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.operators.search import valid_edges
from codeweft.plans.model import EDGE_KEY, Graph


def winners(symbols: DataFrame) -> DataFrame:
    """One row for each id: of several the one last by (file, start_line, project); added up before the shuffle."""
    key = F.struct("file", "start_line", "project_id", "end_line", "signature")
    last = F.max_by(F.struct(*symbols.columns), key).alias("row")
    return symbols.groupBy("id").agg(last).select(*[F.col(f"row.{c}").alias(c) for c in symbols.columns])


def upsert_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same id."""
    new = winners(new)
    return old.join(new.select("id"), "id", "left_anti").select(*old.columns).unionByName(new)


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old edges equal to a new one go; all new ones come in, repeated or not."""
    return old.join(new.select(*EDGE_KEY).distinct(), EDGE_KEY, "left_anti").select(*old.columns).unionByName(new)


def upsert_projects(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("id"), "id", "left_anti").select(*old.columns).unionByName(new)


def upsert_files(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("path"), "path", "left_anti").select(*old.columns).unionByName(new)


def delete_files(graph: Graph, paths: DataFrame) -> Graph:
    """Without the files of ``paths(file)``: their symbols, edges they hold or that touch those symbols, and their index rows."""
    gone = graph.symbols.join(paths, "file", "left_semi").select("id")
    edges = graph.edges.join(paths, "file", "left_anti")
    for end in ("from_id", "to_id"):
        edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return Graph(
        projects=graph.projects,
        symbols=graph.symbols.join(paths, "file", "left_anti").select(*graph.symbols.columns),
        edges=edges.select(*graph.edges.columns),
        files=graph.files.join(paths.select(F.col("file").alias("path")), "path", "left_anti").select(*graph.files.columns),
    )


def prune(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges whose both ends exist; what was pruned is the difference of the counts."""
    return valid_edges(edges, symbols)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, change)`` between two file indexes with ``path, hash``: added, modified or deleted; equal files aren't listed.

    Presence is the row, not its hash: a listed file without a hash isn't absent.
    """
    a = old.select("path", F.col("hash").alias("old_hash"), F.lit(True).alias("was"))
    b = new.select("path", F.col("hash").alias("new_hash"), F.lit(True).alias("now"))
    both = a.join(b, "path", "full")
    change = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("now").isNull(), "deleted")
        .when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "modified")
    )
    return both.select("path", change.alias("change")).where("change is not null")


def unread(listed: DataFrame, index: DataFrame) -> DataFrame:
    """Listed files that must be read: unknown, or changed in time by a second or more."""
    known = index.select("path", F.date_trunc("second", "mod_time").alias("known"))
    out = listed.join(known, "path", "left")
    same = F.col("known") == F.date_trunc("second", "mod_time")
    return out.where(~F.coalesce(same, F.lit(False))).select(*listed.columns)
