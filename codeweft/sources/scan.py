"""Source trees: glob patterns, exclusion, listing and reading by a Spark data source."""

from __future__ import annotations

import contextlib
import datetime
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codeweft.sources.scratch import Workspace

SCHEMA = "path string, project_id string, mod_time timestamp, content binary"


def glob_regex(pattern: str) -> re.Pattern | None:
    """A pattern over whole paths: ``*``, ``?`` and ``[...]`` within a segment, ``**`` for any number of segments.

    None if the pattern is not valid: it matches nothing.
    """
    out = []
    segments = pattern.split("/")
    for i, seg in enumerate(segments):
        last = i == len(segments) - 1
        if seg == "**":
            out.append("(?:[^/]+(?:/[^/]+)*)?" if last else "(?:[^/]+/)*")
            continue
        k = 0
        while k < len(seg):
            c = seg[k]
            if c == "*":
                out.append("[^/]*")
            elif c == "?":
                out.append("[^/]")
            elif c == "[":
                end = seg.find("]", k + 2)
                if end < 0:
                    return None
                body = seg[k + 1 : end]
                inner = body[1:] if body[0] in "^!" else body
                out.append(f"[{'^' if inner is not body else ''}{inner.replace(chr(92), chr(92) * 2).replace('[', chr(92) + '[')}]")
                k = end
            elif c == "\\":
                if k + 1 >= len(seg):
                    return None
                k += 1
                out.append(re.escape(seg[k]))
            else:
                out.append(re.escape(c))
            k += 1
        if not last:
            out.append("/")
    text = "".join(out)
    if pattern.endswith("/**"):  # zero segments: the slash before them goes as well
        text = text.replace("/(?:[^/]+(?:/[^/]+)*)?", "(?:/[^/]+)*") if text.count("/(?:[^/]+(?:/[^/]+)*)?") == 1 else text
    try:
        return re.compile(text + r"\Z")
    except re.error:
        return None


class Excludes:
    """Whether a relative path is excluded.

    A trailing slash restricts a pattern to directories; a pattern without another
    slash is held against the last segment, one with a slash against the whole path.
    """

    def __init__(self, patterns: list[str]):
        self.rules = []
        for p in patterns:
            only_dirs, bare = p.endswith("/"), p.rstrip("/")
            if bare and (rx := glob_regex(bare)):
                self.rules.append((only_dirs, "/" in bare, rx))

    def __call__(self, rel: str, is_dir: bool) -> bool:
        name = rel.rsplit("/", 1)[-1]
        return any((is_dir or not only) and rx.match(rel if whole else name) for only, whole, rx in self.rules)


def walk(root: str, excludes: list[str], extensions: tuple[str, ...], below: str = "", deep: bool = True) -> Iterator[str]:
    """Absolute paths in lexical order; excluded directories aren't entered, unreadable entries and linked directories are passed over."""
    skip, exts = Excludes(excludes), {e.lower() for e in extensions}
    root = os.path.abspath(root)

    def visit(rel: str) -> Iterator[str]:
        try:
            entries = sorted(os.scandir(os.path.join(root, rel)), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            at = f"{rel}/{e.name}" if rel else e.name
            if e.is_dir(follow_symlinks=False):
                if deep and not skip(at, True):
                    yield from visit(at)
            elif os.path.splitext(e.name)[1].lower() in exts and not skip(at, False) and not os.path.isdir(e.path):
                yield os.path.join(root, at)

    yield from visit(below)


def subtrees(root: str, excludes: list[str], most: int) -> list[tuple[str, bool]]:
    """Directories that cover the tree, relative to the root, and whether all below them is meant.

    Levels are opened until there are ``most`` directories; what lies deeper is left to the tasks.
    """
    skip, root = Excludes(excludes), os.path.abspath(root)
    opened: list[tuple[str, bool]] = []
    level = [""]
    while level and len(opened) + len(level) < most:
        below = []
        for rel in level:
            opened.append((rel, False))
            below += [d for d, is_dir, _ in _entries(root, rel) if is_dir and not skip(d, True)]
        level = below
    return opened + [(rel, True) for rel in level]


def _entries(root: str, rel: str) -> Iterator[tuple[str, bool, os.DirEntry]]:
    """Relative path and whether it is a directory, by name; nothing of a directory that can't be read."""
    try:
        entries = sorted(os.scandir(os.path.join(root, rel)), key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        yield f"{rel}/{e.name}" if rel else e.name, e.is_dir(follow_symlinks=False), e


@dataclass(frozen=True)
class Tree:
    """A tree to list: entered directories and wanted files are told by relative path."""

    root: str
    excludes: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    #: Patterns of file names, in place of extensions.
    names: tuple[str, ...] = ()

    def tests(self):
        skip, exts = Excludes(list(self.excludes)), {e.lower() for e in self.extensions}
        names = [rx for n in self.names if (rx := glob_regex(n))]

        def wanted(rel: str) -> bool:
            name = rel.rsplit("/", 1)[-1]
            fits = any(rx.match(name) for rx in names) if self.names else os.path.splitext(name)[1].lower() in exts
            return fits and not skip(rel, False)

        return lambda rel: not skip(rel, True), wanted


_FOUND = "nth int, rel string, is_dir boolean, mod_time timestamp"


def listed(spark: SparkSession, trees: Sequence[Tree], per_task: int = 2000) -> DataFrame:
    """``(nth, rel, mod_time)``: the files of all trees, ``nth`` of them, listed by tasks.

    A task lists up to ``per_task`` directories of those it is given and of what lies below
    them; directories that are left are dealt anew in the next round. Executors must share
    the file system.
    """
    ws, tasks = Workspace(spark, "listing"), spark.sparkContext.defaultParallelism
    absolute = [replace(t, root=os.path.abspath(t.root)) for t in trees]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests, budget = [t.tests() for t in absolute], per_task
        for batch in batches:
            todo, out = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), []
            while todo and budget > 0:
                nth, rel = todo.pop()
                budget -= 1
                enter, wanted = tests[nth]
                for at, is_dir, e in _entries(absolute[nth].root, rel):
                    if is_dir:
                        todo += [(nth, at)] if enter(at) else []
                    elif wanted(at) and not os.path.isdir(e.path):
                        with contextlib.suppress(OSError):
                            out.append((nth, at, False, datetime.datetime.fromtimestamp(e.stat().st_mtime, datetime.timezone.utc)))
            out += [(nth, rel, True, None) for nth, rel in todo]
            columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            types = (pa.int32(), pa.string(), pa.bool_(), pa.timestamp("us", "UTC"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["nth", "rel", "is_dir", "mod_time"])

    rounds, frontier = [], spark.createDataFrame([(i, "") for i in range(len(trees))], "nth int, rel string")
    while True:
        found = ws.put(frontier.repartition(tasks).mapInArrow(run, _FOUND))
        rounds.append(found.where("not is_dir").select("nth", "rel", "mod_time"))
        frontier = found.where("is_dir").select("nth", "rel")
        if frontier.isEmpty():
            return reduce(DataFrame.union, rounds)


class _Dirs(InputPartition):
    def __init__(self, dirs: list[tuple[str, bool]]):
        self.dirs = dirs


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.project = options["path"], options.get("project", "")
        self.excludes = [x for x in options.get("excludes", "").split("\n") if x]
        self.extensions = tuple(x for x in options.get("extensions", "").split(",") if x)
        self.most, self.size = int(options.get("subtrees", "1000")), int(options.get("subtreesPerTask", "8"))
        self.contents = options.get("contents", "true") == "true"

    def partitions(self):
        dirs = subtrees(self.root, self.excludes, self.most)
        return [_Dirs(dirs[i : i + self.size]) for i in range(0, len(dirs), self.size)] or [_Dirs([])]

    def read(self, partition):
        for d, deep in partition.dirs:
            for path in walk(self.root, self.excludes, self.extensions, d, deep):
                try:
                    when = datetime.datetime.fromtimestamp(os.stat(path).st_mtime, datetime.timezone.utc)
                    content = None
                    if self.contents:
                        with open(path, "rb") as f:
                            content = f.read()
                except OSError:
                    continue
                yield path, self.project, when, content


class SourceTree(DataSource):
    """``format("source_tree")``: the files of a tree on a file system that all executors share, by subtrees."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


def read_tree(
    spark: SparkSession, root: str, project: str, excludes: list[str], extensions: tuple[str, ...], contents: bool = True
) -> DataFrame:
    spark.dataSource.register(SourceTree)
    return (
        spark.read.format("source_tree")
        .option("project", project)
        .option("excludes", "\n".join(excludes))
        .option("extensions", ",".join(extensions))
        .option("contents", str(contents).lower())
        .load(root)
    )
