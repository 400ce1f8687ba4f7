"""Depth-bounded traversal by frontier.

What a walk of at most ``depth`` edges reaches is what breadth-first search reaches
within ``depth`` levels, so visited ids are never expanded again and dense or
cyclic graphs cost no more than their edges. Edges may be a table or an Adjacency,
whose levels read only the files that may hold the frontier, in either direction.
A frontier beyond SMALL ids is a written table that edges join. Many starts are
searched at once, 64 to a word of bits, so that a row is an id and a word and not an
id and a start. Ids need not have a symbol: paths run through them, results don't
show them.
"""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators.search import read_symbols
from codeweft.sources.scratch import Workspace
from codeweft.sources.segments import ROWS, Segment

#: Ids of a frontier, and of all levels so far, that the driver holds.
SMALL = 10_000
#: Ids of a frontier, or seeds of a search from many starts, that are sent to all executors (about 100 bytes each); beyond that tables are joined.
SENT = 500_000
#: Starts of one word of bits.
WORD = 64


class Steps(Protocol):
    """Single steps ``(at, id)`` along edges of one kind in one direction."""

    def near(self, ids: list[str]) -> DataFrame:
        """Those that leave the given ids."""

    def all(self) -> DataFrame: ...


class TableSteps:
    """Steps of a plain table of edges."""

    def __init__(self, edges: DataFrame, forward: bool, kind: str):
        a, b = ("from_id", "to_id") if forward else ("to_id", "from_id")
        self.rows = edges.where(F.col("kind") == kind).select(F.col(a).alias("at"), F.col(b).alias("id"))

    def near(self, ids: list[str]) -> DataFrame:
        return self.rows.where(F.col("at").isin(ids))

    def all(self) -> DataFrame:
        return self.rows


class Adjacency:
    """Edges written twice, sorted by either end."""

    def __init__(self, out: Segment, back: Segment):
        self.out, self.back = out, back

    @classmethod
    def write(cls, edges: DataFrame, path: str, rows: int = ROWS) -> Adjacency:
        ends = ("from_id", "to_id")
        ws = Workspace(edges.sparkSession, "edges")
        given = ws.put(edges)
        both = [Segment.write(given, f"{path}/{e}", (e, "kind", *(x for x in ends if x != e)), rows, ready=True) for e in ends]
        ws.drop(given)
        return cls(*both)

    def steps(self, forward: bool, kind: str) -> Steps:
        return _AdjacentSteps(self.out if forward else self.back, forward, kind)


class _AdjacentSteps:
    def __init__(self, segment: Segment, forward: bool, kind: str):
        self.segment, self.forward, self.kind = segment, forward, kind

    def near(self, ids: list[str]) -> DataFrame:
        return TableSteps(self.segment.near(ids), self.forward, self.kind).all()

    def all(self) -> DataFrame:
        return TableSteps(self.segment.all(), self.forward, self.kind).all()


def stepping(edges: DataFrame | Adjacency, forward: bool, kind: str) -> Steps:
    """Steps over a table of edges, or over anything that has ``steps`` of its own."""
    return TableSteps(edges, forward, kind) if isinstance(edges, DataFrame) else edges.steps(forward, kind)


def reach(edges: DataFrame | Adjacency, seeds: DataFrame, depth: int, forward: bool, kind: str) -> DataFrame:
    """``(seed, id)``: what each seed reaches in 1 to max(depth, 1) steps, itself left out unless a cycle returns to it."""
    ws = Workspace(seeds.sparkSession, "reach")
    # consecutive numbers of a partition: the seeds of a word are numbered together, and in the order of
    # their ids, as neighbours by id often reach the same and then share rows
    number = F.monotonically_increasing_id()
    named = ws.put(seeds.where("id is not null").select("id").distinct())
    size = F.char_length("id")
    named = named.repartitionByRange(size, F.col("id")).sortWithinPartitions(size, "id")
    named = ws.put(named.select(F.col("id").alias("seed"), number.alias("n")).selectExpr("seed", f"n div {WORD} as word", f"cast(n % {WORD} as int) as bit"))
    _, seen = reach_bits(stepping(edges, forward, kind).all(), named, depth, ws)
    # rows become (seed, id) behind the join, not before it
    words = named.groupBy("word").agg(F.collect_list(F.struct("bit", "seed")).alias("seeds"))
    words = F.broadcast(words) if named.count() <= SENT else words
    each = F.filter("seeds", lambda s: F.getbit("bits", s["bit"]) == 1)
    return seen.join(words, "word").select("id", F.explode(each).alias("one")).select("one.seed", "id")


def reach_bits(steps: DataFrame, seeds: DataFrame, depth: int, ws: Workspace) -> tuple[int, DataFrame]:
    """Levels run, and ``(word, id, bits)``: which of a word's seeds reach an id."""
    steps = ws.put(steps.where("at is not null and id is not null").distinct()) if depth > 1 else steps.distinct()
    bits = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    frontier, seen, levels = seeds.select("word", F.col("seed").alias("at"), bits.alias("bits")), None, 0
    for _ in range(max(depth, 1)):
        levels += 1
        found = frontier.join(steps, "at").groupBy("word", "id").agg(F.bit_or("bits").alias("bits"))
        if seen is None:
            seen = found = ws.put(found)
        else:
            known = seen.withColumnRenamed("bits", "known")
            merged = found.join(known, ["word", "id"], "full").select("word", "id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("bits", "known")))
            merged = ws.put(merged.withColumn("fresh", F.expr("bits & ~known")))
            seen = merged.select("word", "id", F.expr("bits | known").alias("bits"))
            found = merged.where("fresh <> 0").select("word", "id", F.col("fresh").alias("bits"))
        if found.isEmpty():
            break
        frontier = found.select("word", F.col("id").alias("at"), "bits")
    return levels, seen


def reachable_ids(edges: DataFrame | Adjacency, start: str, depth: int, forward: bool, kind: str) -> DataFrame:
    """``id`` of everything within max(depth, 1) steps of ``start``, but for ``start``."""
    steps = stepping(edges, forward, kind)
    frontier, seen = [start], {start}
    for level in range(max(depth, 1)):
        found = steps.near(frontier).select("id").where("id is not null").distinct()
        rows = found.take(SMALL + 1)
        if len(rows) + len(seen) > SMALL:
            return _reach_large(steps, start, seen, frontier, max(depth, 1) - level)
        frontier = [r.id for r in rows if r.id not in seen]
        seen.update(frontier)
        if not frontier:
            break
    return found.sparkSession.createDataFrame([(i,) for i in sorted(seen - {start})], "id string")


def _reach_large(steps: Steps, start: str, seen: set[str], frontier: list[str], levels: int) -> DataFrame:
    """The rest of a traversal whose levels are too large for the driver."""
    every = steps.all()
    spark = every.sparkSession
    ws = Workspace(spark, "frontier")
    visited = [ws.put(spark.createDataFrame([(i,) for i in seen], "id string"))]
    front = spark.createDataFrame([(i,) for i in frontier], "at string")
    for level in range(levels):
        # the first frontier is known to the driver, so its steps may be looked up
        near = steps.near(frontier) if level == 0 else every.join(front, "at", "left_semi")
        found = near.select("id").where("id is not null").distinct()
        found = ws.put(found.join(reduce(DataFrame.union, visited), "id", "left_anti"))
        n = found.count()
        if not n:
            break
        visited.append(found)
        front = found.select(F.col("id").alias("at"))
        front = F.broadcast(front) if n <= SENT else front
    return reduce(DataFrame.union, visited).where(F.col("id") != start)


def _symbols(symbols: DataFrame, ids: DataFrame) -> DataFrame:
    return read_symbols(symbols.join(ids, "id", "left_semi")).orderBy("id")


def callers(symbols: DataFrame, edges: DataFrame | Adjacency, symbol_id: str, depth: int = 3) -> DataFrame:
    return _symbols(symbols, reachable_ids(edges, symbol_id, depth, False, "calls"))


def callees(symbols: DataFrame, edges: DataFrame | Adjacency, symbol_id: str, depth: int = 3) -> DataFrame:
    return _symbols(symbols, reachable_ids(edges, symbol_id, depth, True, "calls"))


def dependencies(symbols: DataFrame, edges: DataFrame | Adjacency, symbol_id: str, depth: int = 2) -> DataFrame:
    return _symbols(symbols, reachable_ids(edges, symbol_id, depth, True, "imports"))


def dependents(symbols: DataFrame, edges: DataFrame | Adjacency, symbol_id: str, depth: int = 2) -> DataFrame:
    return _symbols(symbols, reachable_ids(edges, symbol_id, depth, False, "imports"))


def implementors(symbols: DataFrame, edges: DataFrame | Adjacency, symbol_id: str) -> DataFrame:
    """What implements the symbol, one step back; the symbol itself isn't left out."""
    return _symbols(symbols, stepping(edges, False, "implements").near([symbol_id]).select("id"))


def detail(symbols: DataFrame, edges: DataFrame | Adjacency, symbol_id: str) -> DataFrame:
    """``(role, id)``: the symbol and its direct callers and callees; no row if there is no such symbol."""
    own = symbols.where(F.col("id") == symbol_id).select(F.lit("symbol").alias("role"), "id", F.col("id").alias("of"))

    def near(role: str, forward: bool) -> DataFrame:
        ends = stepping(edges, forward, "calls").near([symbol_id]).where("id <> at").select("id", F.col("at").alias("of")).distinct()
        return ends.join(own.select("of"), "of", "left_semi").join(symbols, "id", "left_semi").select(F.lit(role).alias("role"), "id", "of")

    return own.union(near("caller", False)).union(near("callee", True)).select("role", "id")
