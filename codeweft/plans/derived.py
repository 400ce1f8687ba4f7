"""Indexes over the test tables, written once for a session and a state of the tables' files.

What a store keeps beside its rows, the catalog's queries find here. The folder is that of
the intermediate tables; files that change, by length or time, give a new index.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators import fulltext, names
from codeweft.operators.traverse import Steps, TableSteps
from codeweft.plans import tables as t
from codeweft.sources.scratch import Workspace
from codeweft.sources.segments import Segment
from codeweft.sources.store import Changes, Snapshot, Store

T = TypeVar("T")
_BUILT: dict[tuple, object] = {}
_LINK = ("from_id", "to_id", "kind")
_SYMBOL_TABLES = ("region", "nation", "customer", "supplier", "part")


def _state(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> tuple:
    """Path, length and time of the tables' files, which tell one state from another."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(conf).listStatus(path)
        out += sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)
    return tuple(out)


def _built(spark: SparkSession, sf_dir: str, what: str, names: tuple[str, ...], build: Callable[[str], T]) -> T:
    key = (spark.sparkContext.applicationId, what, _state(spark, sf_dir, names))
    if key not in _BUILT:
        _BUILT[key] = build(Workspace(spark, what).root)
    return _BUILT[key]


class Edges:
    """The graph's edges by kind: a kind is written when it is first asked for, and sorted by an end when steps from there are looked up."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def rows(self, kind: str) -> DataFrame:
        """``(from_id, to_id, kind)``."""
        names = ("nation", "customer", "supplier") if kind == "imports" else ("lineitem",)
        build = lambda at: Workspace(self.spark, "edges").put(t.edges(self.spark, self.sf_dir, (kind,)).select(*_LINK))
        return _built(self.spark, self.sf_dir, f"edges_{kind}", names, build)

    def by(self, end: str, kind: str) -> Segment:
        names = ("nation", "customer", "supplier") if kind == "imports" else ("lineitem",)
        key = (end, *(c for c in _LINK[:2] if c != end))
        return _built(self.spark, self.sf_dir, f"edges_{kind}_{end}", names, lambda at: Segment.write(self.rows(kind), at, key, ready=True))

    def steps(self, forward: bool, kind: str) -> Steps:
        return _KindSteps(self, forward, kind)


class _KindSteps:
    def __init__(self, edges: Edges, forward: bool, kind: str):
        self.edges, self.forward, self.kind = edges, forward, kind

    def near(self, ids: list[str]) -> DataFrame:
        segment = self.edges.by("from_id" if self.forward else "to_id", self.kind)
        return TableSteps(segment.near(ids), self.forward, self.kind).all()

    def all(self) -> DataFrame:
        return TableSteps(self.edges.rows(self.kind), self.forward, self.kind).all()


def adjacency(spark: SparkSession, sf_dir: str) -> Edges:
    return Edges(spark, sf_dir)


def postings(spark: SparkSession, sf_dir: str) -> Segment:
    """The full-text index of the documents."""
    build = lambda at: Segment.write(fulltext.index(t.texts(spark, sf_dir)), at, fulltext.POSTINGS_KEY)
    return _built(spark, sf_dir, "postings", ("documents",), build)


def grams(spark: SparkSession, sf_dir: str) -> Segment:
    """Trigrams of all symbols' names."""
    return _built(spark, sf_dir, "grams", _SYMBOL_TABLES, lambda at: Segment.write(names.index(t.symbols(spark, sf_dir)), at, names.GRAMS_KEY))


def symbols(spark: SparkSession, sf_dir: str) -> Segment:
    """All symbols by id."""
    return _built(spark, sf_dir, "symbols", _SYMBOL_TABLES, lambda at: Segment.write(t.symbols(spark, sf_dir), at, ("id",)))


def symbols_by_name(spark: SparkSession, sf_dir: str) -> Segment:
    """All symbols but modules, in the order of pages."""
    build = lambda at: Segment.write(t.symbols(spark, sf_dir).where("kind <> 'module'"), at, ("name", "id"))
    return _built(spark, sf_dir, "by_name", _SYMBOL_TABLES, build)


def store(spark: SparkSession, sf_dir: str) -> Snapshot:
    """A store of the whole graph after two commits: all of it, then two files removed and one replaced.

    Of the replaced file's symbols those on odd lines stay, under new names.
    """

    def build(at: str) -> Snapshot:
        out, graph = Store(spark, at), t.graph(spark, sf_dir)
        held = Workspace(spark, "graph")
        symbols, edges = held.put(graph.symbols), held.put(graph.edges)
        mod_time = F.lit(None).cast("timestamp").alias("mod_time")
        files = symbols.groupBy("file").agg(F.min("project_id").alias("project_id"))
        files = held.put(files.select(F.col("file").alias("path"), F.lit("first").alias("hash"), mod_time, "project_id"))
        out.commit(graph.projects, symbols, edges, files, ready=True)
        here = F.col("file") == "parts/Brand#11"
        renewed = held.put(symbols.where(here & (F.col("start_line") % 2 == 1)).withColumn("name", F.concat("name", F.lit(" renewed"))))
        again = held.put(files.where("path = 'parts/Brand#11'").withColumn("hash", F.lit("second")))
        gone = spark.createDataFrame([("customers/BUILDING",), ("nations/ASIA",)], "file string")
        out.apply(Changes(gone, renewed, edges.limit(0), again, graph.projects))
        return out.snapshot()

    return _built(spark, sf_dir, "store", (*_SYMBOL_TABLES, "lineitem"), build)
