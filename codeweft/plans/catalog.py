"""Named queries over the test tables, one for each operator, with the same queries as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.ids import symbol_id_column
from codeweft.functions.text import BASE, MARKED
from codeweft.operators import fulltext, mutate, names, search, traverse
from codeweft.plans import derived, sources, upkeep
from codeweft.plans import tables as t
from codeweft.plans.model import Graph
from codeweft.sources import config

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Candidates of a name search that are looked up one by one; beyond that symbols are scanned.
SMALL_LOOKUP = 10_000

_SYMBOL = "id, name, kind, file, start_line, end_line, coalesce(signature, '') AS signature, coalesce(doc_comment, '') AS doc_comment, project_id"


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str, recursive: bool = False, graph: bool = True) -> None:
    QUERIES[name] = run
    head = f"WITH {'RECURSIVE ' if recursive else ''}{t.GRAPH_SQL}" if graph else ""
    if graph and sql.lstrip().upper().startswith("WITH "):
        head, sql = head.rstrip() + ", ", sql.lstrip()[5:]
    ORACLES[name] = head + sql


# ---- filters, pages, lookups

_PAGES = {
    "search_name_like": dict(name="D_W"),
    "search_name_wildcard": dict(name="CUSTOMER%9"),
    "search_kind": dict(kind="interface"),
    "search_exclude_kind": dict(exclude_kind="class", limit=150),
    "search_project": dict(project_id="ASIA"),
    "search_file": dict(file="customers/BUILDING", limit=7),
    "search_all_filters": dict(name="0", kind="class", exclude_kind="module", project_id="EUROPE", file="customers/MACHINERY", limit=9, offset=2),
    "search_page2": dict(exclude_kind="module", limit=50, offset=50),
}


def _page_sql(name="", kind="", exclude_kind="", project_id="", file="", limit=0, offset=0) -> str:
    fold = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tests = [f"{fold('name')} LIKE {fold(repr('%' + name + '%'))}"] if name else []
    tests += [f"kind = '{kind}'"] if kind else []
    tests += [f"kind <> '{exclude_kind}'"] if exclude_kind else []
    tests += [f"project_id = '{project_id}'"] if project_id else []
    tests += [f"file = '{file}'"] if file else []
    where = f"WHERE {' AND '.join(tests)} " if tests else ""
    return f"SELECT {_SYMBOL} FROM symbols {where}ORDER BY name, id LIMIT {limit or 100} OFFSET {offset}"


for _name, _args in _PAGES.items():
    _add(_name, lambda s, d, a=_args: search.search(t.symbols(s, d), **a), _page_sql(**_args))



def _by_grams(s: SparkSession, d: str, part: str) -> DataFrame:
    """A search that looks only at symbols whose names hold the pattern's trigrams."""
    ids = names.candidates(derived.grams(s, d), part).limit(SMALL_LOOKUP + 1).collect()
    every = derived.symbols(s, d)
    some = every.near([r.id for r in ids]) if len(ids) <= SMALL_LOOKUP else every.all()
    return search.search(some, name=part)


for _name, _part in (("search_name_trigrams", "r#00000012"), ("search_name_trigrams_wildcard", "LIER#%0_9")):
    _add(_name, lambda s, d, p=_part: _by_grams(s, d, p), _page_sql(name=_part))
_add(
    "search_page_deep",
    lambda s, d: search.read_symbols(derived.symbols_by_name(s, d).page(3000, 50)),
    _page_sql(exclude_kind="module", limit=50, offset=3000),
)
_add(
    "symbol_lookup",
    lambda s, d: search.lookup(derived.symbols(s, d).near(["supplier:7"]), "supplier:7"),
    f"SELECT {_SYMBOL} FROM symbols WHERE id = 'supplier:7'",
)
_add("symbol_missing", lambda s, d: search.lookup(t.symbols(s, d), "supplier:none"), f"SELECT {_SYMBOL} FROM symbols WHERE false")
_add(
    "file_lookup",
    lambda s, d: search.file_state(t.files(s, d), "doc/5").select("path", "hash"),
    "SELECT 'doc/' || doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id = 5",
    graph=False,
)


def _graph_page(s: SparkSession, d: str, kinds=("imports", "implements", "calls")) -> tuple[DataFrame, DataFrame, DataFrame]:
    every = t.symbols(s, d)
    return every, search.page(every, 1, 40, exclude_kind="class"), t.edges(s, d, kinds)


def _graph_page_edges(s: SparkSession, d: str) -> DataFrame:
    every, nodes, edges = _graph_page(s, d)
    return search.display_edges(search.edges_from(edges, every, nodes))


_NODES_SQL = "nodes AS (SELECT id FROM symbols WHERE kind <> 'class' ORDER BY name, id LIMIT 40)"
_add(
    "graph_page_edges",
    _graph_page_edges,
    f"WITH {_NODES_SQL} SELECT DISTINCT from_id, to_id, kind FROM edges WHERE from_id IN (SELECT id FROM nodes) "
    "AND EXISTS (SELECT 1 FROM symbols WHERE symbols.id = to_id)",
)


def _edges_from_nodes(s: SparkSession, d: str) -> DataFrame:
    every, nodes, edges = _graph_page(s, d, ("imports", "implements", "calls"))
    return search.edges_from(edges, every, nodes)


_add(
    "edges_from_nodes",
    _edges_from_nodes,
    f"WITH {_NODES_SQL} SELECT from_id, to_id, kind, file, line FROM edges WHERE from_id IN (SELECT id FROM nodes) "
    "AND EXISTS (SELECT 1 FROM symbols WHERE symbols.id = to_id)",
)


def _edges_induced(s: SparkSession, d: str) -> DataFrame:
    every = t.symbols(s, d)
    return search.edges_within(t.edges(s, d), search.search(every, 400, kind="interface").union(every.where("kind in ('type', 'module')")))


_add(
    "edges_induced",
    _edges_induced,
    "WITH nodes AS ((SELECT id FROM symbols WHERE kind = 'interface' ORDER BY name, id LIMIT 400) UNION ALL SELECT id FROM symbols WHERE kind IN ('type', 'module')) "
    "SELECT from_id, to_id, kind, file, line FROM edges WHERE from_id IN (SELECT id FROM nodes) AND to_id IN (SELECT id FROM nodes)",
)
_add(
    "graph_total_nodes",
    lambda s, d: search.count_symbols(t.symbols(s, d), exclude_kind="module"),
    "SELECT count(*) AS n FROM symbols WHERE kind <> 'module'",
)


# ---- what a view of a page draws


def _drawn(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All symbols but functions as the page, and all links, so that some lead off it."""
    return t.symbols(s, d).where("kind <> 'function'"), search.display_edges(t.edges(s, d))


_DRAWN_SQL = "WITH shown AS (SELECT * FROM symbols WHERE kind <> 'function'), links AS (SELECT DISTINCT from_id, to_id, kind FROM edges) "
_add(
    "graph_ghost_nodes",
    lambda s, d: search.with_ghosts(*_drawn(s, d)),
    f"{_DRAWN_SQL}SELECT id, name, kind, false AS ghost FROM shown UNION ALL SELECT DISTINCT to_id, substr(to_id, 1, 8), 'unknown', true FROM links "
    "WHERE NOT EXISTS (SELECT 1 FROM shown WHERE shown.id = to_id)",
)
_add(
    "graph_valid_links",
    lambda s, d: search.drawn_links(*_drawn(s, d)),
    f"{_DRAWN_SQL}SELECT from_id, to_id, kind FROM links WHERE from_id IN (SELECT id FROM shown UNION SELECT to_id FROM links)",
)
_add(
    "graph_labels",
    lambda s, d: search.labelled(t.symbols(s, d)).select("id", "label"),
    "SELECT id, CASE WHEN length(name) > 18 THEN substr(name, 1, 17) || '\u2026' ELSE name END AS label FROM symbols",
)
_add(
    "graph_highlight",
    lambda s, d: search.highlighted(search.display_edges(t.edges(s, d)), "supplier:7"),
    "SELECT DISTINCT from_id, to_id, kind, from_id = 'supplier:7' OR to_id = 'supplier:7' AS highlighted FROM edges",
)

# ---- traversal


def _walk_sql(kind: str, forward: bool, depth: int, start: str) -> str:
    a, b = ("from_id", "to_id") if forward else ("to_id", "from_id")
    return (
        f"WITH start AS ({start}), walk AS (SELECT {b} AS id, 1 AS d FROM edges JOIN start ON {a} = start.id WHERE kind = '{kind}' "
        f"UNION SELECT {b}, d + 1 FROM edges JOIN walk ON {a} = walk.id WHERE kind = '{kind}' AND d < {depth}) "
        f"SELECT {_SYMBOL} FROM symbols WHERE id IN (SELECT id FROM walk) AND id NOT IN (SELECT id FROM start)"
    )


def _all_calls(near: derived.Edges) -> DataFrame:
    return near.rows("calls")


def _calls(run, depth: int, end: str):
    def of(s: SparkSession, d: str) -> DataFrame:
        near = derived.adjacency(s, d)
        return run(derived.symbols(s, d).all(), near, t.busiest(_all_calls(near), end), depth)

    return of


for _name, _run, _forward, _depth in (
    ("callees_d1", traverse.callees, True, 1),
    ("callees_d2", traverse.callees, True, 2),
    ("callees_d10", traverse.callees, True, 10),
    ("callers_d1", traverse.callers, False, 1),
    ("callers_d3", traverse.callers, False, 3),
):
    _start = "SELECT id FROM busiest" if _forward else "SELECT id FROM most_called"
    _add(_name, _calls(_run, _depth, "from_id" if _forward else "to_id"), _walk_sql("calls", _forward, _depth, _start), recursive=True)

_add(
    "dependencies_d2",
    lambda s, d: traverse.dependencies(derived.symbols(s, d).all(), derived.adjacency(s, d), "customer:11", 2),
    _walk_sql("imports", True, 2, "SELECT 'customer:11' AS id"),
    recursive=True,
)
for _depth in (1, 2):
    _add(
        f"dependents_d{_depth}",
        lambda s, d, n=_depth: traverse.dependents(derived.symbols(s, d).all(), derived.adjacency(s, d), "region:2", n),
        _walk_sql("imports", False, _depth, "SELECT 'region:2' AS id"),
        recursive=True,
    )
_add(
    "implementors",
    lambda s, d: traverse.implementors(derived.symbols(s, d).all(), derived.adjacency(s, d), "supplier:3"),
    f"SELECT {_SYMBOL} FROM symbols WHERE id IN (SELECT from_id FROM edges WHERE kind = 'implements' AND to_id = 'supplier:3')",
)


def _detail(s: SparkSession, d: str) -> DataFrame:
    near = derived.adjacency(s, d)
    return traverse.detail(derived.symbols(s, d).all(), near, t.busiest(_all_calls(near)))


_add(
    "symbol_detail",
    _detail,
    "SELECT 'symbol' AS role, id FROM busiest "
    "UNION ALL SELECT DISTINCT 'caller', e.from_id FROM edges e JOIN busiest b ON e.to_id = b.id WHERE e.kind = 'calls' AND e.from_id <> b.id "
    "UNION ALL SELECT DISTINCT 'callee', e.to_id FROM edges e JOIN busiest b ON e.from_id = b.id WHERE e.kind = 'calls' AND e.to_id <> b.id",
)


def _reach_many(s: SparkSession, d: str) -> DataFrame:
    seeds = t.read(s, d, "part").where("p_partkey % 50 = 0").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"))
    return traverse.reach(derived.adjacency(s, d), seeds, 3, True, "calls")


_add(
    "callees_of_many_d3",
    _reach_many,
    "WITH walk AS (SELECT from_id AS seed, to_id AS id, 1 AS d FROM edges WHERE kind = 'calls' AND from_id IN (SELECT 'part:' || p_partkey FROM part WHERE p_partkey % 50 = 0) "
    "UNION SELECT seed, to_id, d + 1 FROM walk JOIN edges ON from_id = walk.id AND kind = 'calls' WHERE d < 3) SELECT DISTINCT seed, id FROM walk",
    recursive=True,
)

# ---- full text


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_TOKENS_SQL = (
    "WITH tok AS (SELECT 'doc:' || doc_id AS id, "
    + ", ".join(
        f"regexp_extract_all(translate(lower(coalesce({c}, '')), {_quoted(MARKED)}, {_quoted(BASE)}), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS {n}"
        for n, c in (("name", "lang"), ("signature", "source"), ("doc_comment", "text"))
    )
    + " FROM documents) "
)
_in = lambda w, cols=("name", "signature", "doc_comment"): "(" + " OR ".join(f"list_contains({c}, '{w}')" for c in cols) + ")"
_phrase = lambda c, ws: (
    f"len(list_filter(range(1, len({c}) - {len(ws) - 2}), lambda i: " + " AND ".join(f"{c}[i + {k}] = '{w}'" for k, w in enumerate(ws)) + ")) > 0"
)
_COLS = ("name", "signature", "doc_comment")
_any = lambda f: "(" + " OR ".join(f(c) for c in _COLS) + ")"

_TEXT = {
    "fts_term": ("MIT", _in("mit")),
    "fts_and": ("the license", f"{_in('the')} AND {_in('license')}"),
    "fts_or": ("apache OR gnu", f"{_in('apache')} OR {_in('gnu')}"),
    "fts_not": ("license NOT version", f"{_in('license')} AND NOT {_in('version')}"),
    "fts_prefix": ("licen*", _any(lambda c: f"len(list_filter({c}, lambda x: starts_with(x, 'licen'))) > 0")),
    "fts_column": ("signature: src3", _in("src3", ("signature",))),
    "fts_columns": ("{name signature}: de OR - doc_comment: src1", f"{_in('de', ('name', 'signature'))} OR {_in('src1', ('name', 'signature'))}"),
    "fts_phrase": ('"under the MIT"', _any(lambda c: _phrase(c, ["under", "the", "mit"]))),
    "fts_accents": ("für", _in("fur")),
    "fts_initial": ("^the", _any(lambda c: f"{c}[1] = 'the'")),
    "fts_near": (
        "NEAR(released license, 3)",
        _any(
            lambda c: f"len(list_filter(range(1, len({c}) + 1), lambda i: {c}[i] IN ('released', 'license') AND "
            f"list_contains({c}[i:i + 4], CASE WHEN {c}[i] = 'released' THEN 'license' ELSE 'released' END))) > 0"
        ),
    ),
    "fts_grouping": ("(apache OR mit) NOT the", f"({_in('apache')} OR {_in('mit')}) AND NOT {_in('the')}"),
}
for _name, (_query, _where) in _TEXT.items():
    QUERIES[_name] = lambda s, d, q=_query: fulltext.matches(derived.postings(s, d), q)
    ORACLES[_name] = f"{_TOKENS_SQL}SELECT id FROM tok WHERE {_where}"
_add(
    "fts_limited",
    lambda s, d: fulltext.search(t.symbols(s, d), "building", 5),
    f"SELECT {_SYMBOL} FROM symbols WHERE doc_comment = 'BUILDING' ORDER BY id LIMIT 5",
)

# ---- counts and statistics

_add("count_symbols", lambda s, d: search.count_symbols(t.symbols(s, d), kind="class", name="1"), "SELECT count(*) AS n FROM symbols WHERE kind = 'class' AND name LIKE '%1%'")
_add("count_edges", lambda s, d: search.count_edges(t.edges(s, d)), "SELECT count(*) AS n FROM edges")


def _partly(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Some symbols missing, so that edges dangle."""
    return t.symbols(s, d).where("end_line % 3 <> 0"), t.edges(s, d)


_PARTLY_SQL = "WITH present AS (SELECT * FROM symbols WHERE end_line % 3 <> 0), e AS (SELECT * FROM edges) "
_BOTH = "from_id IN (SELECT id FROM present) AND to_id IN (SELECT id FROM present)"


def _count_valid(s: SparkSession, d: str) -> DataFrame:
    some, edges = _partly(s, d)
    return search.count_edges(search.valid_edges(edges, some))


def _orphans(s: SparkSession, d: str) -> DataFrame:
    some, edges = _partly(s, d)
    return search.orphan_edges(edges, some)


def _pruned(s: SparkSession, d: str) -> DataFrame:
    some, edges = _partly(s, d)
    return mutate.prune(edges, some)


_add("count_valid_edges", _count_valid, f"{_PARTLY_SQL}SELECT count(*) AS n FROM e WHERE {_BOTH}")
_add("orphan_edges", _orphans, f"{_PARTLY_SQL}SELECT from_id, to_id, kind, file, line FROM e WHERE NOT ({_BOTH})")
_add("prune_edges", _pruned, f"{_PARTLY_SQL}SELECT from_id, to_id, kind, file, line FROM e WHERE {_BOTH}")
_add(
    "project_stats",
    lambda s, d: search.project_stats(t.projects(s, d), t.symbols(s, d), t.edges(s, d), t.files(s, d)),
    "SELECT r_name AS project_id, (SELECT count(*) FROM symbols WHERE project_id = r_name) AS symbol_count, "
    "(SELECT count(*) FROM edges JOIN symbols ON id = from_id WHERE project_id = r_name) AS edge_count, "
    "(SELECT count(*) FROM documents WHERE doc_id % 5 = r_regionkey) AS file_count FROM region",
)

# ---- mutations and change detection


def _halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """An old file index and a new one: documents gone, added and changed."""
    docs = t.read(s, d, "documents").select("doc_id", "text", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"))
    old = docs.where("doc_id % 10 <> 1").select("path", mutate.content_hash(F.col("text")).alias("hash"))
    changed = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = docs.where("doc_id % 10 <> 2").select("path", mutate.content_hash(changed).alias("hash"))
    return old, new


_CHANGED = {"added": 1, "deleted": 2, "modified": 3}
for _name, _digit in _CHANGED.items():
    _add(
        f"diff_{_name}",
        lambda s, d, n=_name: mutate.changes(*_halves(s, d)).where(F.col("change") == n).select("path"),
        f"SELECT 'doc/' || doc_id AS path FROM documents WHERE doc_id % 10 = {_digit}" + (" AND text IS NOT NULL" if _name == "modified" else ""),
        graph=False,
    )


def _upsert_symbols(s: SparkSession, d: str) -> DataFrame:
    every = t.symbols(s, d)
    new = every.where("kind = 'interface'").withColumn("name", F.concat("name", F.lit("!")))
    again = new.withColumns({"file": F.lit("a"), "name": F.lit("loses")})
    return mutate.upsert_symbols(every, new.union(again))


_add(
    "upsert_symbols",
    _upsert_symbols,
    "SELECT id, name, kind, file, start_line, end_line, signature, doc_comment, project_id FROM symbols WHERE kind <> 'interface' "
    "UNION ALL SELECT id, name || '!', kind, file, start_line, end_line, signature, doc_comment, project_id FROM symbols WHERE kind = 'interface'",
)


def _upsert_edges(s: SparkSession, d: str) -> DataFrame:
    old = t.edges(s, d)
    new = old.where("from_id like '%7'")
    return mutate.upsert_edges(old, new.union(new))


_add(
    "upsert_edges",
    _upsert_edges,
    "SELECT from_id, to_id, kind, file, line FROM edges UNION ALL SELECT from_id, to_id, kind, file, line FROM edges WHERE from_id LIKE '%7'",
)


def _deleted(s: SparkSession, d: str) -> Graph:
    graph = Graph(t.projects(s, d), t.symbols(s, d), t.edges(s, d), t.files(s, d))
    return mutate.delete_files(graph, s.createDataFrame([("customers/BUILDING",), ("nations/ASIA",), ("doc/5",)], "file string"))


_GONE = "('customers/BUILDING', 'nations/ASIA', 'doc/5')"
_add("delete_by_file_symbols", lambda s, d: _deleted(s, d).symbols.select("id"), f"SELECT id FROM symbols WHERE file NOT IN {_GONE}")
_add(
    "delete_by_file_edges",
    lambda s, d: _deleted(s, d).edges,
    f"WITH gone AS (SELECT id FROM symbols WHERE file IN {_GONE}) SELECT from_id, to_id, kind, file, line FROM edges "
    f"WHERE file NOT IN {_GONE} AND from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone)",
)
_add("delete_by_file_index", lambda s, d: _deleted(s, d).files.select("path"), "SELECT 'doc/' || doc_id AS path FROM documents WHERE doc_id <> 5", graph=False)

# ---- identity, configuration, extraction

_add(
    "symbol_id",
    lambda s, d: t.symbols(s, d).select("id", symbol_id_column(F.col("file"), F.col("name"), F.col("kind")).alias("hashed")),
    "SELECT id, substr(sha256('|' || file || '|' || name || '|' || kind), 1, 32) AS hashed FROM symbols",
)


def _flatten(s: SparkSession, d: str) -> DataFrame:
    """Nations as projects with their suppliers as services; a nation's suppliers are one task's."""
    services = t.read(s, d, "supplier").groupBy("s_nationkey").agg(F.collect_list("s_name").alias("services"))
    own = t.read(s, d, "nation").join(services, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", "services")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            given = [config.Project(n, n, "go", services=[config.Project(x, x, "go") for x in ([] if v is None else v)]) for n, v in zip(b.n_name, b.services, strict=True)]
            yield pd.DataFrame({"project": [p.name for p in config.flatten(given)]})

    return own.mapInPandas(run, "project string")


_add(
    "flatten_projects",
    _flatten,
    "SELECT s_name AS project FROM supplier UNION ALL SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)",
    graph=False,
)


def _merge_excludes(s: SparkSession, d: str) -> DataFrame:
    """Of every supplier, whose own excludes are its name and a default one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            merged = [config.merge_excludes([f"{n}/", "vendor/", f"{n}/"]) for n in b.s_name]
            yield pd.DataFrame({"s_name": b.s_name, "excludes": [",".join(m) for m in merged]})

    return t.read(s, d, "supplier").select("s_name").mapInPandas(run, "s_name string, excludes string")


_REST = ",".join(x for x in config.DEFAULT_EXCLUDES if x != "vendor/")
_add("merge_excludes", _merge_excludes, f"SELECT s_name, s_name || '/,vendor/,{_REST}' AS excludes FROM supplier", graph=False)

for _language in sources.SAMPLES:
    _add(f"extract_{_language}_symbols", lambda s, d, x=_language: sources.symbols(s, d, x), sources.symbols_sql(_language), graph=False)
    _add(f"extract_{_language}_edges", lambda s, d, x=_language: sources.edges(s, d, x), sources.edges_sql(_language), graph=False)


def _page_links(s: SparkSession, d: str) -> DataFrame:
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))
    return t.read(s, d, "pages").select("url", F.explode(links).alias("target"))


def _extract_symbols(s: SparkSession, d: str) -> DataFrame:
    pages = t.read(s, d, "pages").select(symbol_id_column(F.col("url"), F.col("url"), F.lit("module")).alias("id"), F.col("url").alias("name"))
    targets = _page_links(s, d).select(symbol_id_column(F.col("target"), F.col("target"), F.lit("module")).alias("id"), F.col("target").alias("name"))
    return pages.union(targets).distinct()


_LINKS_SQL = "SELECT url, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS target FROM pages"
_MODULE = "substr(sha256('|' || {0} || '|' || {0} || '|module'), 1, 32)"
_add(
    "extract_pages_symbols",
    _extract_symbols,
    f"SELECT DISTINCT {_MODULE.format('name')} AS id, name FROM (SELECT url AS name FROM pages UNION SELECT target FROM ({_LINKS_SQL}))",
    graph=False,
)
_add(
    "extract_pages_edges",
    lambda s, d: _page_links(s, d)
    .select(
        symbol_id_column(F.col("url"), F.col("url"), F.lit("module")).alias("from_id"),
        symbol_id_column(F.col("target"), F.col("target"), F.lit("module")).alias("to_id"),
    )
    .distinct(),
    f"SELECT DISTINCT {_MODULE.format('url')} AS from_id, {_MODULE.format('target')} AS to_id FROM ({_LINKS_SQL})",
    graph=False,
)

QUERIES |= upkeep.QUERIES
ORACLES |= upkeep.ORACLES
