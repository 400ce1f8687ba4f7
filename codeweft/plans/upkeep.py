"""Named queries of what keeps an index: paths and exclusion, configuration, file states, commits of the store.

Each runs the library's own functions over rows of the test tables; the SQL states the result anew.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators import fulltext, mutate, search, traverse
from codeweft.plans import derived
from codeweft.plans import tables as t
from codeweft.sources import config
from codeweft.sources.extract import extensions
from codeweft.sources.scan import Tree, glob_regex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLES[name] = run, sql


# ---- paths: parts as files of a source tree

_FOLDERS = ("src", "src/vendor", "web/node_modules/x", "lib", ".git/a", "docs/old", "a/target", "a/build/c")
_ENDINGS = (".go", ".ts", ".tsx", ".py", ".cs", ".rs", ".zig", ".txt", ".GO")
_PARTS_SQL = (
    f"paths AS (SELECT {list(_FOLDERS)}[CAST(p_partkey % {len(_FOLDERS)} AS INT) + 1] || '/part_' || p_partkey || "
    f"{list(_ENDINGS)}[CAST(p_partkey // {len(_FOLDERS)} % {len(_ENDINGS)} AS INT) + 1] AS path FROM part) "
)


def _paths(s: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    folder = F.element_at(F.array(*map(F.lit, _FOLDERS)), (key % len(_FOLDERS) + 1).cast("int"))
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.floor(key / len(_FOLDERS)) % len(_ENDINGS) + 1).cast("int"))
    return t.spread(t.read(s, d, "part").select("p_partkey")).select(F.concat(folder, F.lit("/part_"), key.cast("string"), ending).alias("path"))


def _listed(s: SparkSession, d: str) -> DataFrame:
    """Files that a listing finds: no folder above them is excluded, nor they themselves, and a scanner reads them."""
    own = ["docs/**", "*_1?.rs", "lib/part_2*"]
    tree = Tree("/", tuple(config.merge_excludes(own)), extensions())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enter, wanted = tree.tests()

        def found(path: str) -> bool:
            at = path.split("/")
            return all(enter("/".join(at[: i + 1])) for i in range(len(at) - 1)) and wanted(path)

        for b in batches:
            yield b[b.path.map(found).astype(bool)]

    return _paths(s, d).mapInPandas(run, "path string")


_DIRS = "|".join(x.rstrip("/").replace(".", "\\.") for x in config.DEFAULT_EXCLUDES)
_add(
    "listed_paths",
    _listed,
    f"WITH {_PARTS_SQL}SELECT path FROM paths WHERE NOT regexp_matches(path, '(^|/)({_DIRS})/') AND NOT starts_with(path, 'docs/') "
    "AND NOT regexp_matches(path, '_1[^/]\\.rs$') AND NOT starts_with(path, 'lib/part_2') AND lower(regexp_extract(path, '\\.[a-zA-Z]+$')) "
    "IN ('.go', '.ts', '.tsx', '.py', '.cs', '.rs', '.zig')",
)

#: Globs, and the same as regular expressions of DuckDB; the last one isn't valid and matches nothing.
_GLOBS = {
    "**/part_?.go": "([^/]+/)*part_[^/]\\.go",
    "src/*/part_*[0-4].ts": "src/[^/]*/part_[^/]*[0-4]\\.ts",
    "a/**": "a(/[^/]+)*",
    "a/**/c/*[^0-6].py": "a/([^/]+/)*c/[^/]*[^0-6/]\\.py",
    "*.go": "[^/]*\\.go",
    "lib/[": None,
}


def _globbed(s: SparkSession, d: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = {p: rx for p in _GLOBS if (rx := glob_regex(p))}
        for b in batches:
            rows = [(path, p) for path in b.path for p, rx in compiled.items() if rx.match(path)]
            yield pd.DataFrame(rows, columns=["path", "pattern"])

    return _paths(s, d).mapInPandas(run, "path string, pattern string")


_add(
    "globbed_paths",
    _globbed,
    f"WITH {_PARTS_SQL}" + " UNION ALL ".join(f"SELECT path, '{p}' AS pattern FROM paths WHERE regexp_full_match(path, '{rx}')" for p, rx in _GLOBS.items() if rx),
)


# ---- configuration: suppliers as projects


def _supplied(s: SparkSession, d: str, run: Callable[[int, str], tuple | None], schema: str) -> DataFrame:
    """``run(key, name)`` of each supplier; None gives no row."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def batches(given: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in given:
            rows = [r for k, n in zip(b.s_suppkey.tolist(), b.s_name, strict=True) if (r := run(k, n)) is not None]
            yield pd.DataFrame(rows, columns=columns).astype(object)

    return t.spread(t.read(s, d, "supplier").select("s_suppkey", "s_name")).mapInPandas(batches, schema)


def _contained(s: SparkSession, d: str) -> DataFrame:
    ways = ("{}", "../{}", "a/../{}", "../ws/{}", "../ws{}", "/{}", "a/../..")

    def run(key: int, name: str) -> tuple:
        path = ways[key % len(ways)].format(name)
        return path, config.contained("/no-such-folder/ws", path)

    return _supplied(s, d, run, "path string, inside boolean")


_add(
    "contained_paths",
    _contained,
    "SELECT CASE s_suppkey % 7 WHEN 0 THEN s_name WHEN 1 THEN '../' || s_name WHEN 2 THEN 'a/../' || s_name WHEN 3 THEN '../ws/' || s_name "
    "WHEN 4 THEN '../ws' || s_name WHEN 5 THEN '/' || s_name ELSE 'a/../..' END AS path, s_suppkey % 7 IN (0, 2, 3) AS inside FROM supplier",
)


def _validated(s: SparkSession, d: str) -> DataFrame:
    """How many projects of each supplier's workspace stay, or why it is refused."""

    def run(key: int, name: str) -> tuple:
        service = config.Project("part", "no-such-path" if key % 6 == 5 else "", "go")
        if key % 6 == 4:
            service.services = [config.Project("deep", "", "go")]
        own = config.Project(name, "no-such-path" if key % 6 == 3 else "", "cobol" if key % 6 == 2 else "go", services=[service])
        log = logging.getLogger()
        before = log.level
        log.setLevel(logging.ERROR)  # a warning for each row would flood the executors' logs
        try:
            kept = config.validate(config.Workspace("" if key % 6 == 1 else name, [own, config.Project("other", "", "auto")]), "/")
            return name, len(kept.projects), None
        except config.ConfigError as e:
            return name, None, str(e)
        finally:
            log.setLevel(before)

    return _supplied(s, d, run, "s_name string, kept bigint, refused string")


_add(
    "validated_workspaces",
    _validated,
    "SELECT s_name, CAST(CASE s_suppkey % 6 WHEN 0 THEN 2 WHEN 3 THEN 1 WHEN 5 THEN 2 END AS BIGINT) AS kept, CASE s_suppkey % 6 WHEN 1 THEN 'workspace name is empty' "
    "WHEN 2 THEN 'project ''' || s_name || ''': unknown language ''cobol''' WHEN 4 THEN 'project ''part'': services can''t have services' END AS refused FROM supplier",
)


def _detected(s: SparkSession, d: str) -> DataFrame:
    """Projects of folders named by suppliers, told by their manifests."""
    manifests = (["package.json"], ["package.json", "tsconfig.json"], ["pyproject.toml"], ["setup.py"], ["App.csproj"], ["Cargo.toml"], ["build.zig"], ["README.md"])

    def run(key: int, name: str) -> tuple | None:
        found = config.detect("/no-such-folder", [(f"code/{name}", manifests[key % len(manifests)])])
        return (found[0].name, found[0].path, found[0].language) if found else None

    return _supplied(s, d, run, "name string, path string, language string")


_add(
    "detected_projects",
    _detected,
    "SELECT CASE s_suppkey % 8 WHEN 4 THEN 'App' ELSE s_name END AS name, 'code/' || s_name AS path, CASE s_suppkey % 8 WHEN 0 THEN 'javascript' WHEN 1 THEN 'typescript' "
    "WHEN 2 THEN 'python' WHEN 3 THEN 'python' WHEN 4 THEN 'csharp' WHEN 5 THEN 'rust' ELSE 'zig' END AS language FROM supplier WHERE s_suppkey % 8 < 7",
)
_add(
    "go_module_names",
    lambda s, d: _supplied(
        s, d, lambda k, n: (n, config.go_module_name(f"// {n}\n{'  ' if k % 2 else ''}module \"example.org/{n}/{'' if k % 3 else 'sub/'}\"\n\ngo 1.22\n")), "s_name string, module string"
    ),
    "SELECT s_name, CASE s_suppkey % 3 WHEN 0 THEN 'sub' ELSE s_name END AS module FROM supplier",
)


# ---- file and project states


def _states(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What a listing finds of the documents, and what the index knows: times equal, within a second, a second apart; files unknown."""
    docs = t.read(s, d, "documents").where("doc_id is not null").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"))
    micros = F.lit(1_600_000_000_000_000) + F.col("doc_id") * 1_000_000
    listed = docs.select("path", F.timestamp_micros(micros).alias("mod_time"))
    later = F.element_at(F.array(*map(F.lit, (0, 300_000, 1_000_000))), (F.col("doc_id") % 4 + 1).cast("int"))
    return listed, docs.where("doc_id % 4 < 3").select("path", F.timestamp_micros(micros + later).alias("mod_time"))


_add(
    "unread_files",
    lambda s, d: mutate.unread(*_states(s, d)).select("path"),
    "SELECT 'doc/' || doc_id AS path FROM documents WHERE doc_id % 4 IN (2, 3)",
)


def _upserted_files(s: SparkSession, d: str) -> DataFrame:
    old = t.files(s, d)
    some = old.where("path like '%3'")
    new = some.withColumn("hash", F.lit("new")).union(some.withColumn("path", F.concat("path", F.lit(".new"))))
    return mutate.upsert_files(old, new).select("path", "hash", "project_id")


_add(
    "upsert_files",
    _upserted_files,
    "WITH files AS (SELECT 'doc/' || doc_id AS path, sha256(text) AS hash, r_name AS project_id FROM documents LEFT JOIN region ON doc_id % 5 = r_regionkey) "
    "SELECT path, CASE WHEN path LIKE '%3' THEN 'new' ELSE hash END AS hash, project_id FROM files UNION ALL SELECT path || '.new', hash, project_id FROM files WHERE path LIKE '%3'",
)


def _upserted_projects(s: SparkSession, d: str) -> DataFrame:
    nation = t.read(s, d, "nation").join(t.read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    first = nation.groupBy("r_name").agg(F.min("n_name").alias("n_name")).where("r_name < 'B'")
    new = first.select(F.col("r_name").alias("id"), F.col("n_name").alias("name"), F.lit("/moved").alias("path"), F.lit("rust").alias("language"))
    own = nation.select(F.col("n_name").alias("id"), F.col("n_name").alias("name"), F.lit("/new").alias("path"), F.lit("zig").alias("language"))
    return mutate.upsert_projects(t.projects(s, d), new.union(own))


_add(
    "upsert_projects",
    _upserted_projects,
    "SELECT r_name AS id, CASE WHEN r_name < 'B' THEN (SELECT min(n_name) FROM nation WHERE n_regionkey = r_regionkey) ELSE r_name END AS name, "
    "CASE WHEN r_name < 'B' THEN '/moved' ELSE '/' || r_name END AS path, CASE WHEN r_name < 'B' THEN 'rust' ELSE 'go' END AS language FROM region "
    "UNION ALL SELECT n_name, n_name, '/new', 'zig' FROM nation",
)


# ---- a store: all of the graph committed, then some files removed and one brand's parts replaced

_STORED_SQL = (
    f"WITH RECURSIVE {t.GRAPH_SQL}, kept AS (SELECT * REPLACE (CASE WHEN file = 'parts/Brand#11' THEN name || ' renewed' ELSE name END AS name) FROM symbols "
    "WHERE file NOT IN ('customers/BUILDING', 'nations/ASIA') AND NOT (file = 'parts/Brand#11' AND start_line % 2 = 0)), "
    "live AS (SELECT * FROM edges WHERE from_id IN (SELECT id FROM kept) AND to_id IN (SELECT id FROM kept)), "
    "indexed AS (SELECT file AS path, min(project_id) AS project_id FROM symbols WHERE file NOT IN ('customers/BUILDING', 'nations/ASIA') GROUP BY file) "
)
_SYMBOL = "id, name, kind, file, start_line, end_line, coalesce(signature, '') AS signature, coalesce(doc_comment, '') AS doc_comment, project_id"


def _stored(name: str, run: Callable, sql: str) -> None:
    _add(name, lambda s, d: run(derived.store(s, d)), _STORED_SQL + sql)


_stored("store_symbols", lambda v: search.read_symbols(v.rows("symbols")), f"SELECT {_SYMBOL} FROM kept")
_stored("store_edges", lambda v: v.rows("out"), "SELECT from_id, to_id, kind, file, line FROM live")
_stored("store_files", lambda v: v.rows("files").select("path", "hash", "project_id"), "SELECT path, CASE path WHEN 'parts/Brand#11' THEN 'second' ELSE 'first' END AS hash, project_id FROM indexed")
_stored(
    "store_counts",
    lambda v: v.whole("totals"),
    "SELECT project_id, (SELECT count(*) FROM kept k WHERE k.project_id = p.project_id) AS symbol_count, "
    "(SELECT count(*) FROM live JOIN kept k ON k.id = from_id WHERE k.project_id = p.project_id) AS edge_count, "
    "(SELECT count(*) FROM indexed i WHERE i.project_id = p.project_id) AS file_count "
    "FROM (SELECT DISTINCT project_id FROM kept UNION SELECT project_id FROM indexed) p",
)
_stored("store_file", lambda v: search.read_symbols(v.near("raw_symbols", ["parts/Brand#11"])), f"SELECT {_SYMBOL} FROM kept WHERE file = 'parts/Brand#11'")
_stored("store_named", lambda v: search.search(v.named("renewed"), name="renewed"), f"SELECT {_SYMBOL} FROM kept WHERE name LIKE '%renewed%' ORDER BY name, id LIMIT 100")
_stored("store_page", lambda v: search.read_symbols(v.page(200, 50)), f"SELECT {_SYMBOL} FROM kept WHERE kind <> 'module' ORDER BY name, id LIMIT 50 OFFSET 200")
_stored(
    "store_matches",
    lambda v: fulltext.matches(v.postings, "renewed OR building OR asia"),
    "SELECT id FROM kept WHERE list_has_any(regexp_extract_all(lower(name || ' ' || coalesce(signature, '') || ' ' || coalesce(doc_comment, '')), '[\\p{L}\\p{N}]+'), "
    "['renewed', 'building', 'asia'])",
)
_stored("store_importers", lambda v: traverse.dependents(v.rows("symbols"), v, "region:3", 2), f", walk AS (SELECT from_id AS id, 1 AS d FROM live WHERE kind = 'imports' AND to_id = 'region:3' "
        f"UNION SELECT from_id, d + 1 FROM live JOIN walk ON to_id = walk.id WHERE kind = 'imports' AND d < 2) SELECT {_SYMBOL} FROM kept WHERE id IN (SELECT id FROM walk)")  # fmt: skip
