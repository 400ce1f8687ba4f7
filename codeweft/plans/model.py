"""Schemas of the property graph, and an empty graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

PROJECTS = "id string, name string, path string, language string"
SYMBOLS = (
    "id string, name string, kind string, file string, start_line bigint, end_line bigint, "
    "signature string, doc_comment string, project_id string"
)
EDGES = "from_id string, to_id string, kind string, file string, line bigint"
FILES = "path string, hash string, mod_time timestamp, project_id string"
TABLES = {"projects": PROJECTS, "symbols": SYMBOLS, "edges": EDGES, "files": FILES}

SYMBOL_KINDS = ("function", "method", "type", "interface", "variable", "module", "class")
EDGE_KINDS = ("calls", "imports", "implements", "extends", "references")
EDGE_KEY = ["from_id", "to_id", "kind", "file", "line"]


@dataclass(frozen=True)
class Graph:
    """The four relations; edges may name ids that no symbol has."""

    projects: DataFrame
    symbols: DataFrame
    edges: DataFrame
    files: DataFrame


def empty(spark: SparkSession) -> Graph:
    return Graph(**{name: spark.createDataFrame([], StructType.fromDDL(ddl)) for name, ddl in TABLES.items()})
