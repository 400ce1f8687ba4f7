"""Build and update: scan, find what changed, extract that, commit a snapshot.

Trees are listed without contents. A build reads and hashes files that are new or whose
time differs from the index, an update every file. Rows are kept by file, so a changed or
deleted file takes exactly its own rows with it; what several files share (module nodes)
and which edges dangle follows from all rows at commit. An update thus gives the rows
that a build would, and writes only what changed.
"""

from __future__ import annotations

import contextlib
import datetime
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators import mutate
from codeweft.plans.model import EDGES, PROJECTS, SYMBOLS
from codeweft.sources import config
from codeweft.sources.extract import extensions, extract
from codeweft.sources.scan import Tree, listed
from codeweft.sources.scratch import Workspace as Scratch
from codeweft.sources.store import Changes, Store

_LISTED = "path string, project_id string, mod_time timestamp"
_ROW = f"rec string, error string, {SYMBOLS}, from_id string, to_id string, line bigint"


@dataclass
class Summary:
    added: int = 0
    modified: int = 0
    deleted: int = 0
    unchanged: int = 0
    errors: int = 0
    symbols: int = 0
    edges: int = 0
    pruned: int = 0
    symbol_delta: int = 0
    edge_delta: int = 0


def extract_files(files: DataFrame) -> DataFrame:
    """One row for each symbol and edge of ``files(path, project_id, content)``; ``rec`` tells which, errors are rows as well."""
    schema = pa.schema([(name, pa.int64() if kind == "bigint" else pa.string()) for name, kind in (c.split() for c in _ROW.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for path, project, content in zip(*(batch.column(c).to_pylist() for c in ("path", "project_id", "content")), strict=True):
                try:
                    found = extract(path, bytes(content).decode("utf-8", "replace"))
                    rows += [{"rec": "symbol", "project_id": project, **s} for s in found.symbols]
                    rows += [{"rec": "edge", **e} for e in found.edges]
                except Exception as e:  # one file's failure is reported and the others go on
                    rows.append({"rec": "error", "error": str(e), "file": path})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "project_id", "content").mapInArrow(run, _ROW)


def _trees(workspace: config.Workspace, root: str) -> list[tuple[str, Tree]]:
    """Name and tree of each project; of those that hold a file the last has it."""
    out = []
    for p in config.flatten(workspace.projects):
        if not config.contained(root, p.path):
            raise config.ConfigError(f"project {p.name!r}: {p.path} is outside the workspace")
        at = os.path.abspath(os.path.join(root, p.path))
        out.append((p.name, Tree(at, tuple(config.merge_excludes(p.exclude)), tuple(extensions()))))
    return out


def scan(spark: SparkSession, workspace: config.Workspace, root: str) -> DataFrame:
    """All source files of all projects, unread; a file of several projects belongs to the last."""
    trees = _trees(workspace, root)
    if not trees:
        return spark.createDataFrame([], _LISTED)
    names = spark.createDataFrame([(i, t.root, name) for i, (name, t) in enumerate(trees)], "nth int, root string, project_id string")
    found = listed(spark, [t for _, t in trees]).join(F.broadcast(names), "nth")  # one row a project
    found = found.withColumn("path", F.concat_ws("/", F.expr("rtrim('/', root)"), "rel"))
    last = found.groupBy("path").agg(F.max_by(F.struct("project_id", "mod_time"), "nth").alias("file"))
    return last.select("path", "file.project_id", "file.mod_time")


def placed(paths: DataFrame, workspace: config.Workspace, root: str) -> DataFrame:
    """Of the files ``paths(path)`` those that ``scan`` would find, as it gives them, without listing the trees."""
    trees = _trees(workspace, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = [(name, t.root.rstrip("/") + "/", *t.tests()) for name, t in trees]

        def owner(path: str) -> str | None:
            last = None
            for name, base, enter, wanted in tests:
                rel = path.removeprefix(base)
                above = [rel[:i] for i, c in enumerate(rel) if c == "/"]
                if path.startswith(base) and wanted(rel) and all(enter(a) and not os.path.islink(base + a) for a in above):
                    last = name
            return last

        for batch in batches:
            rows = []
            for given in batch.column(0).to_pylist():
                path = re.sub("^file:/+", "/", given or "")
                with contextlib.suppress(OSError):
                    if (name := owner(path)) is not None and os.path.isfile(path):
                        rows.append((path, name, datetime.datetime.fromtimestamp(os.stat(path).st_mtime, datetime.timezone.utc)))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            types = (pa.string(), pa.string(), pa.timestamp("us", "UTC"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "project_id", "mod_time"])

    return paths.select("path").mapInArrow(run, _LISTED).dropDuplicates(["path"])


def detect(spark: SparkSession, root: str) -> list[config.Project]:
    """As config.detect, the tree listed by tasks; the driver sees manifests only."""
    tree = Tree(root, (".*/", *(f"{d}/" for d in sorted(config.NOT_ENTERED))), names=config.MANIFESTS)
    rows = listed(spark, [tree]).select("rel").collect()  # a project's manifests
    found: dict[str, list[str]] = {}
    for r in rows:
        folder, _, name = r.rel.rpartition("/")
        found.setdefault(folder or ".", []).append(name)
    return config.detect(root, found.items())


def opened(files: DataFrame, contents: bool = True) -> DataFrame:
    """The listed files with their hash, and content if asked for; one that can't be read any more is left out.

    Executors must share the file system.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):  # one file at a time in memory
                try:
                    with open(path, "rb") as f:
                        content = f.read()
                except OSError:
                    continue
                row = batch.slice(i, 1)
                found = [pa.array([hashlib.sha256(content).hexdigest()]), pa.array([content if contents else None], pa.binary())]
                yield pa.RecordBatch.from_arrays([*row.columns, *found], [*row.schema.names, "hash", "content"])

    return files.select("path", "project_id", "mod_time").mapInArrow(run, f"{_LISTED}, hash string, content binary")


def run(spark: SparkSession, store: Store, workspace: config.Workspace, root: str, trust_times: bool = True, only: DataFrame | None = None) -> Summary:
    """Bring the store up to the source trees.

    ``trust_times``: a file whose time is the index's, to the second, is taken as unchanged, unread.
    ``only(path)``: the files to look at, in place of all trees; what is gone from the trees stays then.
    """
    scratch, tasks = Scratch(spark, "build"), max(1, spark.sparkContext.defaultParallelism * 4)
    listed, view = scratch.put(scan(spark, workspace, root) if only is None else placed(only, workspace, root)), store.snapshot()
    index = store.table("files") if only is None or view is None else view.those("files", listed.select("path"))
    due = mutate.unread(listed, index) if trust_times else listed
    read = scratch.put(opened(due.repartition(tasks), contents=False).drop("content"))
    known = listed.join(due.select("path"), "path", "left_anti").join(index.select("path", "hash"), "path")
    columns = ["path", "hash", "mod_time", "project_id"]
    files = scratch.put(known.select(*columns).union(read.select(*columns)))
    changes = scratch.put(mutate.changes(index, files))
    out = Summary(**{r.change: r.n for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()})
    out.unchanged = files.count() - out.added - out.modified
    old_symbols, old_edges = store.table("symbols").count(), store.table("edges").count()
    flat = config.flatten(workspace.projects)
    projects = spark.createDataFrame([(p.name, p.name, p.path, p.language) for p in flat], PROJECTS)
    if not (out.added or out.modified or out.deleted) and store.version():
        out.symbols, out.edges = old_symbols, old_edges
        return out
    fresh = changes.where("change <> 'deleted'").select("path")
    work = scratch.put(opened(read.join(fresh, "path", "left_semi").repartition(tasks)))
    rows = scratch.put(extract_files(work))

    def found(rec: str, ddl: str) -> DataFrame:
        return rows.where(F.col("rec") == rec).select(*[c.split()[0] for c in ddl.split(", ")])

    projects = mutate.upsert_projects(store.table("projects"), projects)
    gone = changes.select(F.col("path").alias("file"))
    store.apply(Changes(gone, found("symbol", SYMBOLS), found("edge", EDGES), work.select(*columns), projects))
    out.errors = rows.where("rec = 'error'").count()
    out.symbols, out.edges = store.table("symbols").count(), store.table("edges").count()
    out.pruned = store.table("raw_edges").count() - out.edges
    out.symbol_delta, out.edge_delta = out.symbols - old_symbols, out.edges - old_edges
    return out
