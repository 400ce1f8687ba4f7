"""Source files made of the rows of ``part``, one a row and language, and what is declared in them as SQL.

The scanners run over these texts as they do over files of a tree; the SQL knows the
declarations from the rows alone, by the rules of each language's extraction.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.build import extract_files
from codeweft.plans import tables as t

#: What an id is made of: path, name and kind. ``@`` is the file, ``{k}`` the part's key.
Ref = tuple[str, str, str]


@dataclass(frozen=True)
class Sample:
    extension: str
    text: str
    #: Ref, first line, last line, signature.
    symbols: tuple[tuple[Ref, int, int, str], ...]
    #: Refs of both ends, kind, line.
    edges: tuple[tuple[Ref, Ref, str, int], ...]


def _module(name: str) -> Ref:
    return name, name, "module"


_FILE = _module("@")


def _here(name: str, kind: str) -> Ref:
    return "@", name, kind


SAMPLES = {
    "go": Sample(
        "go",
        'package p\n\nimport "lib/p{k}"\n\nfunc Make{k}() {\n\tCheck{k}()\n}\n\n// func Not{k}() {}\nfunc Check{k}() {\n\tp{k}.Use("func No() {")\n}\n',
        (
            (_FILE, 1, 1, ""),
            (_module("lib/p{k}"), 3, 3, ""),
            (_here("Make{k}", "function"), 5, 7, "func Make{k}()"),
            (_here("Check{k}", "function"), 10, 12, "func Check{k}()"),
        ),
        (
            (_FILE, _module("lib/p{k}"), "imports", 3),
            (_here("Make{k}", "function"), _here("Check{k}", "function"), "calls", 6),
            (_here("Check{k}", "function"), _here("Use", "function"), "calls", 11),
        ),
    ),
    "python": Sample(
        "py",
        'import lib.p{k}\n\n\nclass Part{k}:\n    def make(self):\n        """def no(): pass"""\n        check_{k}()\n\n\ndef check_{k}():\n    pass\n',
        (
            (_FILE, 1, 1, ""),
            (_module("lib.p{k}"), 1, 1, ""),
            (_here("Part{k}", "class"), 4, 7, "class Part{k}"),
            (_here("Part{k}.make", "method"), 5, 7, "def make(...)"),
            (_here("check_{k}", "function"), 10, 11, "def check_{k}(...)"),
        ),
        ((_FILE, _module("lib.p{k}"), "imports", 1), (_FILE, _here("check_{k}", "function"), "calls", 7)),
    ),
    "typescript": Sample(
        "ts",
        'import { use } from "lib/p{k}";\n\ninterface Shape{k} { }\n\nclass Part{k} extends Base{k} implements Shape{k} {\n  make() {\n    check{k}();\n  }\n}\n\n'
        "function check{k}() {\n  use(`function no() {`);\n}\n",
        (
            (_FILE, 1, 1, ""),
            (_module("lib/p{k}"), 1, 1, ""),
            (_here("Shape{k}", "interface"), 3, 3, "interface Shape{k}"),
            (_here("Part{k}", "class"), 5, 9, "class Part{k}"),
            (_here("Part{k}.make", "method"), 6, 8, "Part{k}.make()"),
            (_here("check{k}", "function"), 11, 13, "function check{k}"),
        ),
        (
            (_FILE, _module("lib/p{k}"), "imports", 1),
            (_here("Part{k}", "class"), _here("Base{k}", "class"), "extends", 5),
            (_here("Part{k}", "class"), _here("Shape{k}", "interface"), "implements", 5),
            (_here("Part{k}.make", "method"), _here("check{k}", "function"), "calls", 7),
            (_here("check{k}", "function"), _here("use", "function"), "calls", 12),
        ),
    ),
    "javascript": Sample(
        "js",
        'import { use } from "lib/p{k}";\n\nclass Part{k} {\n  make() {\n    check{k}();\n  }\n}\n\nfunction check{k}() {\n  /* function no() {} */\n  use();\n}\n',
        (
            (_FILE, 1, 1, ""),
            (_module("lib/p{k}"), 1, 1, ""),
            (_here("Part{k}", "class"), 3, 7, "class Part{k}"),
            (_here("Part{k}.make", "method"), 4, 6, "Part{k}.make()"),
            (_here("check{k}", "function"), 9, 12, "function check{k}"),
        ),
        (
            (_FILE, _module("lib/p{k}"), "imports", 1),
            (_here("Part{k}.make", "method"), _here("check{k}", "function"), "calls", 5),
            (_here("check{k}", "function"), _here("use", "function"), "calls", 11),
        ),
    ),
    "csharp": Sample(
        "cs",
        "using Lib.P{k};\n\npublic interface IShape{k} { }\n\npublic class Part{k} : Base{k}, IShape{k} {\n    public void Make() {\n        Check{k}();\n    }\n}\n",
        (
            (_FILE, 1, 1, ""),
            (_module("Lib.P{k}"), 1, 1, ""),
            (_here("IShape{k}", "interface"), 3, 3, "interface IShape{k}"),
            (_here("Part{k}", "class"), 5, 9, "class Part{k}"),
            (_here("Part{k}.Make", "method"), 6, 8, "Part{k}.Make()"),
        ),
        (
            (_FILE, _module("Lib.P{k}"), "imports", 1),
            (_here("Part{k}", "class"), _here("Base{k}", "class"), "extends", 5),
            (_here("Part{k}", "class"), _here("IShape{k}", "interface"), "implements", 5),
            (_here("Part{k}.Make", "method"), _here("Check{k}", "method"), "calls", 7),
        ),
    ),
    "rust": Sample(
        "rs",
        "use lib::p{k};\n\npub struct Part{k} {\n    size: i32,\n}\n\ntrait Shape{k} {\n}\n\nimpl Shape{k} for Part{k} {\n    fn make(&self) {\n        check_{k}();\n    }\n}\n\nfn check_{k}() {\n}\n",
        (
            (_FILE, 1, 1, ""),
            (_module("lib::p{k}"), 1, 1, ""),
            (_here("Part{k}", "type"), 3, 5, "struct Part{k}"),
            (_here("Shape{k}", "interface"), 7, 8, "trait Shape{k}"),
            (_here("Part{k}.make", "method"), 11, 13, "fn make"),
            (_here("check_{k}", "function"), 16, 17, "fn check_{k}"),
        ),
        (
            (_FILE, _module("lib::p{k}"), "imports", 1),
            (_here("Part{k}", "type"), _here("Shape{k}", "interface"), "implements", 10),
            (_here("Part{k}.make", "method"), _here("check_{k}", "function"), "calls", 12),
        ),
    ),
    "zig": Sample(
        "zig",
        'const part = @import("p{k}.zig");\n\nconst Part{k} = struct {\n    size: i32,\n    fn make() void {\n        check{k}();\n    }\n};\n\nfn check{k}() void {\n}\n',
        (
            (_FILE, 1, 1, ""),
            (_module("p{k}.zig"), 1, 1, ""),
            (_here("Part{k}", "type"), 3, 8, "const Part{k}"),
            (_here("Part{k}.make", "method"), 5, 7, "fn make"),
            (_here("check{k}", "function"), 10, 11, "fn check{k}"),
        ),
        ((_FILE, _module("p{k}.zig"), "imports", 1), (_here("Part{k}.make", "method"), _here("check{k}", "function"), "calls", 6)),
    ),
}


def extracted(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """What the scanners find in the language's files."""
    s, key = SAMPLES[language], F.col("p_partkey").cast("string")
    path = F.concat(F.lit("src/"), key, F.lit(f".{s.extension}"))
    text = F.replace(F.lit(s.text), F.lit("{k}"), key)
    parts = t.spread(t.read(spark, sf_dir, "part").select("p_partkey", "p_brand"))
    files = parts.select(path.alias("path"), F.col("p_brand").alias("project_id"), F.encode(text, "UTF-8").alias("content"))
    return extract_files(files)


def symbols(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    return extracted(spark, sf_dir, language).where("rec = 'symbol'").select("id", "name", "kind", "file", "start_line", "end_line", "signature", "project_id")


def edges(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    return extracted(spark, sf_dir, language).where("rec = 'edge'").select("from_id", "to_id", "kind", "file", "line")


def _sql(text: str, extension: str) -> str:
    quoted = text.replace("'", "''")
    return f"replace(replace('{quoted}', '@', 'src/{{k}}.{extension}'), '{{k}}', CAST(p_partkey AS VARCHAR))"


def _id_sql(ref: Ref, extension: str) -> str:
    return f"substr(sha256('|' || {_sql('|'.join(ref), extension)}), 1, 32)"


def symbols_sql(language: str) -> str:
    s = SAMPLES[language]
    return " UNION ALL ".join(
        f"SELECT {_id_sql(ref, s.extension)} AS id, {_sql(ref[1], s.extension)} AS name, '{ref[2]}' AS kind, {_sql('@', s.extension)} AS file, "
        f"CAST({a} AS BIGINT) AS start_line, CAST({b} AS BIGINT) AS end_line, {_sql(signature, s.extension)} AS signature, p_brand AS project_id FROM part"
        for ref, a, b, signature in s.symbols
    )


def edges_sql(language: str) -> str:
    s = SAMPLES[language]
    return " UNION ALL ".join(
        f"SELECT {_id_sql(a, s.extension)} AS from_id, {_id_sql(b, s.extension)} AS to_id, '{kind}' AS kind, {_sql('@', s.extension)} AS file, CAST({line} AS BIGINT) AS line FROM part"
        for a, b, kind, line in s.edges
    )
