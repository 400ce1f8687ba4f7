"""The graph store: immutable parts, merged on read.

A commit writes one part, a folder of tables, and then creates one small numbered file
that names the parts of the store's state. The first part of a state is whole; later ones
hold the rows of what a commit changed, and two lists: the files it replaced or removed
(``gone``), and the ids whose symbol it changed or removed (``changed``). A row is
alive unless a later part lists its file, or its id, or for an edge the end that
vanished. What a commit writes is thus in proportion to the rows that changed; after
MOST_PARTS parts the next commit writes a whole one. Readers keep what they have
opened; a crash before the numbered file leaves the state as it was.

Tables lie sorted by what they are looked up by: rows of files by file, symbols by id,
edges by either end, the full-text index by token, names by trigram and, but for
modules, in the order of pages. Counts of each project are carried
from commit to commit. Of two writers at once the second commits on top of the first if
they touch different files, else it fails with Conflict.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeweft.operators import fulltext, names
from codeweft.operators.mutate import winners
from codeweft.operators.search import valid_edges
from codeweft.operators.traverse import TableSteps
from codeweft.plans.model import EDGES, FILES, PROJECTS, SYMBOLS, Graph
from codeweft.sources.scratch import Workspace
from codeweft.sources.segments import Segment

#: Tables of a part: columns, what they are sorted by, and which list ends the life of a row, by which column.
TABLES = {
    "raw_symbols": (SYMBOLS, ("file", "id"), (("file", "gone"),)),
    "raw_edges": (EDGES, ("file", "from_id", "to_id"), (("file", "gone"),)),
    "files": (FILES, ("path",), (("path", "gone"),)),
    "symbols": (SYMBOLS, ("id",), (("id", "changed"),)),
    "out": (EDGES, ("from_id", "kind", "to_id"), (("file", "gone"), ("from_id", "vanished"), ("to_id", "vanished"))),
    "back": (EDGES, ("to_id", "kind", "from_id"), (("file", "gone"), ("from_id", "vanished"), ("to_id", "vanished"))),
    "named": (SYMBOLS, ("name", "id"), (("id", "changed"),)),
    "grams": (names.GRAMS, names.GRAMS_KEY, (("id", "changed"),)),
    "postings": (fulltext.POSTINGS, fulltext.POSTINGS_KEY, (("id", "changed"),)),
}
TOTALS = "project_id string, symbol_count bigint, edge_count bigint, file_count bigint"
#: Tables that a part holds whole, whatever it changes: a row a project.
WHOLE = {"projects": PROJECTS, "totals": TOTALS}
LISTS = {"gone": "file string", "changed": "id string, vanished boolean"}
MOST_PARTS = 16
#: Changed files whose rows one task may sort, and how many rows of theirs.
FEW = 100
FEW_ROWS = 100_000
#: Ids that are sent to all executors; beyond that tables are joined.
SENT = 500_000
#: Keys that a lookup names; beyond that tables are joined.
SMALL = 10_000
TRIES = 5
#: Seconds after which a commit file that is still empty counts as abandoned.
PATIENCE = 5.0


class Conflict(RuntimeError):
    """Another writer has committed changes of the same files."""


@dataclass(frozen=True)
class Changes:
    """What a commit brings: files that go or are replaced, the rows of new and replaced files, and all projects.

    The rows should be read from tables; they are taken several times.
    """

    gone: DataFrame
    symbols: DataFrame
    edges: DataFrame
    files: DataFrame
    projects: DataFrame


class Snapshot:
    """One state of a store; what it reads doesn't change any more."""

    def __init__(self, spark: SparkSession, path: str, parts: Sequence[tuple[int, str]]):
        self.spark, self.path, self.parts = spark, path, list(parts)
        self._segments: dict[tuple[str, str], Segment] = {}

    def _segment(self, part: str, name: str) -> Segment:
        if (part, name) not in self._segments:
            ddl, key, _ = TABLES[name]
            self._segments[part, name] = Segment(self.spark, f"{self.path}/{part}/{name}", StructType.fromDDL(ddl), key)
        return self._segments[part, name]

    def _listed(self, name: str) -> DataFrame | None:
        """``(key, last)``: the last part that lists a key; None if there is only a whole part."""
        source = "changed" if name == "vanished" else name
        rows = []
        for number, part in self.parts[1:]:
            one = self.spark.read.schema(LISTS[source]).parquet(f"{self.path}/{part}/{source}")
            one = one.where("vanished") if name == "vanished" else one
            rows.append(one.select(F.col(one.columns[0]).alias("_key"), F.lit(number).alias("_last")))
        return reduce(DataFrame.union, rows).groupBy("_key").agg(F.max("_last").alias("_last")) if rows else None

    def _alive(self, name: str, read) -> DataFrame:
        ddl, _, ends = TABLES[name]
        out = reduce(DataFrame.union, [read(self._segment(p, name)).withColumn("_part", F.lit(n)) for n, p in self.parts])
        for column, listed in ends:
            last = self._listed(listed)
            if last is not None:
                out = out.join(last, out[column] == last["_key"], "left").where("_last is null or _part >= _last").drop("_key", "_last")
        return out.select(*StructType.fromDDL(ddl).names)

    def rows(self, name: str) -> DataFrame:
        return self._alive(name, Segment.all)

    def near(self, name: str, keys: Sequence[str], prefixes: Sequence[str] = ()) -> DataFrame:
        """Rows by the first column that the table is sorted by, from the files that may hold them."""
        return self._alive(name, lambda s: s.near(keys, prefixes))

    def those(self, name: str, keys: DataFrame) -> DataFrame:
        """Rows whose first sort column is among the only column of ``keys``; looked up if they are few."""
        key = TABLES[name][1][0]
        few = [r[0] for r in keys.where(F.col(keys.columns[0]).isNotNull()).take(SMALL + 1)]
        if len(few) <= SMALL:
            return self.near(name, few)
        return self.rows(name).join(keys.select(F.col(keys.columns[0]).alias(key)), key, "left_semi")

    def steps(self, forward: bool, kind: str):
        return _Steps(self, forward, kind)

    @cached_property
    def postings(self) -> fulltext.Index:
        return _Lookup(self, "postings")

    def named(self, part: str) -> DataFrame:
        """Symbols that a search for a part of a name need look at."""
        found = names.candidates(_Lookup(self, "grams"), part) if part else None
        return self.rows("symbols") if found is None else self.those("symbols", found)

    def page(self, offset: int, limit: int) -> DataFrame:
        """Symbols but modules by (name, id); of a whole part only the files that hold the page are read."""
        if len(self.parts) == 1:
            return self._segment(self.parts[0][1], "named").page(offset, limit)
        return self.rows("named").orderBy("name", "id").offset(offset).limit(limit)

    def whole(self, name: str) -> DataFrame:
        return self.spark.read.schema(WHOLE[name]).parquet(f"{self.path}/{self.parts[-1][1]}/{name}")


class _Steps:
    """Steps along a snapshot's edges; a level reads the files that may hold its frontier."""

    def __init__(self, snapshot: Snapshot, forward: bool, kind: str):
        self.snapshot, self.table, self.forward, self.kind = snapshot, "out" if forward else "back", forward, kind

    def near(self, ids: list[str]) -> DataFrame:
        return TableSteps(self.snapshot.near(self.table, ids), self.forward, self.kind).all()

    def all(self) -> DataFrame:
        return TableSteps(self.snapshot.rows(self.table), self.forward, self.kind).all()


class _Lookup:
    """One table of a snapshot, by key."""

    def __init__(self, snapshot: Snapshot, table: str):
        self.snapshot, self.table = snapshot, table

    def near(self, keys: Sequence[str], prefixes: Sequence[str] = ()) -> DataFrame:
        return self.snapshot.near(self.table, keys, prefixes)


class Store:
    """Tables at a path of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    # ---- states

    def _commits(self) -> list[int]:
        if not self._fs.exists(self._at("commits")):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(self._at("commits")) if f.getPath().getName().isdigit())

    def _parts(self, version: int) -> list[tuple[int, str]]:
        """The parts of a version; none if its writer never finished."""
        until = time.monotonic() + PATIENCE
        while True:
            stream = self._fs.open(self._at(f"commits/{version:012d}"))
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if text or time.monotonic() > until:
                return [tuple(p) for p in json.loads(text or "[]")]
            time.sleep(0.1)

    def _head(self) -> tuple[int, list[tuple[int, str]]]:
        for version in reversed(self._commits()):
            if parts := self._parts(version):
                return version, parts
        return 0, []

    def version(self) -> int:
        """The number of the last commit; 0 if there is none."""
        return self._head()[0]

    def snapshot(self) -> Snapshot | None:
        parts = self._head()[1]
        return Snapshot(self.spark, self.path, parts) if parts else None

    def table(self, name: str) -> DataFrame:
        """A table of the last commit; ``edges`` are those with both ends."""
        view, name = self.snapshot(), "out" if name == "edges" else name
        if view is None:
            return self.spark.createDataFrame([], StructType.fromDDL(WHOLE.get(name) or TABLES[name][0]))
        return view.whole(name) if name in WHOLE else view.rows(name)

    def graph(self) -> Graph:
        return Graph(*(self.table(t) for t in ("projects", "symbols", "edges", "files")))

    # ---- commits

    def commit(self, projects: DataFrame, raw_symbols: DataFrame, raw_edges: DataFrame, files: DataFrame, ready: bool = False) -> int:
        """Put a whole graph, by its rows of files, in the place of all there is. ``ready``: the rows are read from tables."""
        number = max(self._commits(), default=0) + 1
        part = self._write_whole(projects, raw_symbols, raw_edges, files, files.select(F.col("path").alias("file")), ready)
        self._name(number, [(number, part)])
        return number

    def apply(self, changes: Changes) -> int:
        """Commit changed files on top of the last state. Returns the new version."""
        gone = changes.gone.select(F.col(changes.gone.columns[0]).alias("file")).union(changes.files.select("path")).distinct()
        scratch = Workspace(self.spark, "commit")
        gone = scratch.put(gone)
        base, parts = self._head()
        for _ in range(TRIES):
            number = max(self._commits(), default=0) + 1
            if parts and len(parts) < MOST_PARTS:
                part = self._write_part(Snapshot(self.spark, self.path, parts), changes, gone, scratch)
                state = [*parts, (number, part)]
            else:
                part = self._write_merged(Snapshot(self.spark, self.path, parts) if parts else None, changes, gone)
                state = [(number, part)]
            # a commit that came in between is met either here or by its number
            now, newer = self._head()
            if now == base and self._name(number, state):
                return number
            now, newer = self._head()
            self._refuse(base, now, gone)
            base, parts = now, newer
        raise Conflict(f"{TRIES} other commits came first")

    def _name(self, number: int, parts: list[tuple[int, str]]) -> bool:
        """Create the numbered file; False if another writer was first."""
        try:
            out = self._fs.create(self._at(f"commits/{number:012d}"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        try:
            out.write(bytearray(json.dumps(parts).encode()))
        finally:
            out.close()
        return True

    def _refuse(self, base: int, now: int, gone: DataFrame) -> None:
        """Fail if a commit after ``base`` has replaced a file of ``gone``."""
        for version in range(base + 1, now + 1):
            for number, part in self._parts(version) if version in self._commits() else ():
                if number == version:
                    theirs = self.spark.read.schema(LISTS["gone"]).parquet(f"{self.path}/{part}/gone")
                    both = [r.file for r in theirs.join(gone, "file", "left_semi").take(3)]
                    if both:
                        raise Conflict(f"commit {version} has changed {', '.join(both)}")

    def _put(self, part: str, name: str, df: DataFrame, ready: bool = False, few: bool = False) -> DataFrame:
        at = f"{self.path}/{part}/{name}"
        if name in TABLES:
            ddl, key, _ = TABLES[name]
            return Segment.write(df.select(*StructType.fromDDL(ddl).names), at, key, ready=ready, few=few).all()
        ddl = WHOLE.get(name) or LISTS[name]
        df.select(*StructType.fromDDL(ddl).names).coalesce(1).write.parquet(at)
        return self.spark.read.schema(ddl).parquet(at)

    def _write_whole(self, projects: DataFrame, raw_symbols: DataFrame, raw_edges: DataFrame, files: DataFrame, gone: DataFrame, ready: bool = False) -> str:
        part = f"part-{uuid.uuid4().hex}"
        symbols = self._put(part, "symbols", winners(self._put(part, "raw_symbols", raw_symbols, ready)))
        edges = self._put(part, "out", valid_edges(self._put(part, "raw_edges", raw_edges, ready), symbols))
        files = self._put(part, "files", files, ready)
        self._put(part, "back", edges, ready=True)
        self._put_indexes(part, symbols)
        self._put(part, "projects", projects)
        self._put(part, "gone", gone)
        owner = symbols.select(F.col("id").alias("from_id"), "project_id")
        self._put(part, "totals", _counted([(symbols, "symbol_count", 1), (edges.join(owner, "from_id"), "edge_count", 1), (files, "file_count", 1)]))
        return part

    def _put_indexes(self, part: str, symbols: DataFrame, few: bool = False) -> None:
        self._put(part, "postings", fulltext.index(symbols), few=few)
        self._put(part, "grams", names.index(symbols), ready=True, few=few)
        self._put(part, "named", symbols.where("kind <> 'module'"), ready=True, few=few)

    def _write_merged(self, view: Snapshot | None, changes: Changes, gone: DataFrame) -> str:
        """A whole part of the last state with the changes."""
        if view is None:
            return self._write_whole(changes.projects, changes.symbols, changes.edges, changes.files, gone)

        def renewed(name: str, new: DataFrame) -> DataFrame:
            column = TABLES[name][1][0]
            kept = view.rows(name).join(gone.select(F.col("file").alias(column)), column, "left_anti")
            return kept.select(*new.columns).union(new)

        given = {"raw_symbols": (changes.symbols, SYMBOLS), "raw_edges": (changes.edges, EDGES), "files": (changes.files, FILES)}
        rows = [renewed(n, df.select(*StructType.fromDDL(ddl).names)) for n, (df, ddl) in given.items()]
        return self._write_whole(changes.projects, *rows, gone)

    def _write_part(self, view: Snapshot, changes: Changes, gone: DataFrame, ws: Workspace) -> str:
        part = f"part-{uuid.uuid4().hex}"
        # what so few files declare, one task can sort; edges of others that they bring to life may be many
        few = len(gone.take(FEW + 1)) <= FEW and max(changes.symbols.count(), changes.edges.count()) <= FEW_ROWS
        new = self._put(part, "raw_symbols", changes.symbols, ready=True, few=few)
        new_edges = self._put(part, "raw_edges", changes.edges, ready=True, few=few)
        new_files = self._put(part, "files", changes.files, ready=True, few=few)
        self._put(part, "projects", changes.projects)
        self._put(part, "gone", gone)

        # ids that a changed file declares or declared, and which row stands for each of them now
        before = view.those("raw_symbols", gone)
        touched = ws.put(before.select("id").union(new.select("id")).distinct())
        kept = view.rows("raw_symbols").join(gone, "file", "left_anti").join(touched, "id", "left_semi").select(*new.columns)
        now = ws.put(winners(kept.union(new)))
        old = ws.put(view.those("symbols", touched))
        row = F.struct(*[c for c in new.columns if c != "id"])
        both = old.select("id", row.alias("o")).join(now.select("id", row.alias("n")), "id", "full").where("not (o <=> n)")
        moved = F.expr("o is not null and n is not null and not (o.project_id <=> n.project_id)")
        changed = ws.put(both.select("id", F.expr("n is null").alias("vanished"), F.expr("o is null").alias("appeared"), moved.alias("moved")))
        self._put(part, "changed", changed)
        fresh = self._put(part, "symbols", now.join(changed, "id", "left_semi"), ready=True, few=few)
        self._put_indexes(part, fresh, few)

        # new edges, and old ones of other files that found an end now
        appeared, vanished = changed.where("appeared").select("id"), changed.where("vanished").select("id")
        found = new_edges
        if not appeared.isEmpty():
            others = view.rows("raw_edges").join(gone, "file", "left_anti")
            found = found.union(_touching(others, _sent(appeared), ("from_id", "to_id")).select(*found.columns))
        found = ws.put(found)
        ends = ws.put(found.select(F.col("from_id").alias("id")).union(found.select("to_id")).distinct())
        present = view.those("symbols", ends).select("id").join(vanished, "id", "left_anti").union(appeared)
        alive = self._put(part, "out", valid_edges(found, present))
        self._put(part, "back", alive, ready=True)

        # counts: what went and what came, by project
        edges = view.rows("out").join(gone.select("file", F.lit(True).alias("_gone")), "file", "left")
        moved_ids = changed.where("moved").select("id")
        ended = edges.where("_gone").unionByName(_touching(edges.where("_gone is null"), _sent(vanished), ("from_id", "to_id")))
        # without moved ids no edges are looked through for them
        stays = edges.limit(0) if moved_ids.isEmpty() else _touching(edges.where("_gone is null"), _sent(moved_ids), ("from_id",))
        stays = stays.join(vanished.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
        went, came = ws.put(ended.unionByName(stays).select("from_id")), ws.put(alive.select("from_id").union(stays.select("from_id")))
        sources = ws.put(went.union(came).select(F.col("from_id").alias("id")).distinct())
        was = view.those("symbols", sources).select("id", "project_id")
        named = lambda df: df.select(F.col("id").alias("from_id"), "project_id")
        after = fresh.select("id", "project_id").union(was.join(changed, "id", "left_anti"))
        steps = [
            (old.join(changed, "id", "left_semi"), "symbol_count", -1),
            (fresh, "symbol_count", 1),
            (went.join(named(was), "from_id"), "edge_count", -1),
            (came.join(named(after), "from_id"), "edge_count", 1),
            (view.those("files", gone), "file_count", -1),
            (new_files, "file_count", 1),
        ]
        self._put(part, "totals", _counted(steps, view.whole("totals")))
        return part

    # ---- upkeep

    def compact(self) -> int:
        """Write the last state as one whole part."""
        view = self.snapshot()
        if view is None or len(view.parts) == 1:
            return self.version()
        return self.commit(view.whole("projects"), view.rows("raw_symbols"), view.rows("raw_edges"), view.rows("files"))

    def prune(self) -> int:
        """Remove the rows of edges with an end missing; returns how many.

        Such an edge comes back with its file's next change, not if its end turns up in another file.
        """
        view = self.snapshot()
        if view is None:
            return 0
        alive = view.rows("out")
        gone = view.rows("raw_edges").count() - alive.count()
        if gone:
            self.commit(view.whole("projects"), view.rows("raw_symbols"), alive, view.rows("files"))
        return gone

    def vacuum(self) -> int:
        """Delete the parts that the last commit doesn't name; returns how many."""
        keep, gone = {p for _, p in self._head()[1]}, 0
        if not keep:
            return 0
        for f in self._fs.listStatus(self._at("")):
            n = f.getPath().getName()
            if n.startswith("part-") and n not in keep:
                gone += self._fs.delete(f.getPath(), True)
        return gone

    def clean(self) -> bool:
        """Delete the store; whether there was one."""
        return self._fs.exists(self._at("")) and self._fs.delete(self._at(""), True)


def _sent(ids: DataFrame) -> DataFrame:
    """Ids of a written table, sent to all executors unless they are many, so that the edges they join stay where they are."""
    return F.broadcast(ids) if ids.count() <= SENT else ids


def _touching(edges: DataFrame, ids: DataFrame, ends: Sequence[str]) -> DataFrame:
    """Edges with one of ``ends`` among ``ids``, each once."""
    out = edges
    for end in ends:
        out = out.join(ids.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    return out.where(reduce(lambda a, b: a | b, [F.col(f"_{e}").isNotNull() for e in ends])).select(*edges.columns)


def _counted(steps: Sequence[tuple[DataFrame, str, int]], start: DataFrame | None = None) -> DataFrame:
    """TOTALS: what ``start`` counts, and one more or less for each row of ``steps`` under its project."""
    names = StructType.fromDDL(TOTALS).names
    zero = lambda c: F.lit(0).cast("long").alias(c)
    rows = [] if start is None else [start.select(*names)]
    for df, column, by in steps:
        one = df.groupBy("project_id").agg((F.count("*") * by).alias(column))
        rows.append(one.select(*[F.col(c) if c in ("project_id", column) else zero(c) for c in names]))
    total = reduce(DataFrame.union, rows).groupBy("project_id").agg(*[F.sum(c).alias(c) for c in names[1:]])
    return total.where(" or ".join(f"{c} <> 0" for c in names[1:]))
