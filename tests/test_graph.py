"""Traversal, search, mutation and full text against plain Python and SQLite."""

from __future__ import annotations

import random
import sqlite3

import pytest

from codeweft.functions import match
from codeweft.functions.text import tokens_of
from codeweft.operators import fulltext, mutate, search, traverse
from codeweft.plans import model
from codeweft.sources.segments import Segment

E = model.EDGES


def symbols(spark, ids, **more):
    base = {"name": None, "kind": "function", "file": "f", "start_line": 1, "end_line": 1, "signature": None, "doc_comment": None, "project_id": "p"}
    rows = [tuple({**base, **more, "id": i, "name": more.get("name", i)}[c.split()[0]] for c in model.SYMBOLS.split(", ")) for i in ids]
    return spark.createDataFrame(rows, model.SYMBOLS)


def edges(spark, pairs, kind="calls"):
    return spark.createDataFrame([(a, b, kind, "f", n) for n, (a, b) in enumerate(pairs)], E)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_view(spark):
    nodes = symbols(spark, ["A", "a name of over eighteen", "eighteen letters x"])
    pairs = [("A", "0123456789"), ("A", "0123456789"), ("gone", "A"), ("0123456789", "A"), ("A", None)]
    links = edges(spark, pairs)
    ghosts = [tuple(r) for r in search.with_ghosts(nodes, links).where("ghost").collect()]
    assert ghosts == [("0123456789", "01234567", "unknown", True)]
    assert sorted((r.from_id, r.to_id) for r in search.drawn_links(nodes, links).collect()) == [("0123456789", "A"), ("A", "0123456789"), ("A", "0123456789")]
    assert sorted(r.label for r in search.labelled(nodes).collect()) == ["A", "a name of over ei\u2026", "eighteen letters x"]
    lit = {(r.from_id, r.to_id): r.highlighted for r in search.highlighted(links, "0123456789").collect()}
    assert [lit[p] for p in dict.fromkeys(pairs)] == [True, False, True, False]
    assert search.with_ghosts(nodes.limit(0), links.limit(0)).count() == 0


def test_chain_cycle_diamond(spark):
    s = symbols(spark, "ABCD")
    chain = edges(spark, ["AB", "BC"])
    assert ids(traverse.callers(s, chain, "C", 1)) == ["B"] and ids(traverse.callers(s, chain, "C", 2)) == ["A", "B"]
    assert ids(traverse.callees(s, chain, "A", 0)) == ["B"] and ids(traverse.callees(s, chain, "nobody", 3)) == []
    cycle = edges(spark, ["AB", "BC", "CA", "AA"])
    assert ids(traverse.callees(s, cycle, "A", 10)) == ["B", "C"]
    diamond = edges(spark, ["AB", "AC", "BD", "CD", "AB"])
    assert ids(traverse.callees(s, diamond, "A", 5)) == ["B", "C", "D"]
    orphan = edges(spark, ["AX", "XB"])
    assert ids(traverse.callees(s, orphan, "A", 2)) == ["B"]
    assert ids(traverse.implementors(s, edges(spark, ["AB", "BB"], "implements"), "B")) == ["A", "B"]
    got = sorted((r.role, r.id) for r in traverse.detail(s, diamond, "D").collect())
    assert got == [("caller", "B"), ("caller", "C"), ("symbol", "D")] and traverse.detail(s, diamond, "none").count() == 0


def bfs(pairs, start, depth):
    seen, front = {start}, {start}
    for _ in range(max(depth, 1)):
        front = {b for a, b in pairs if a in front} - seen
        seen |= front
    return sorted(seen - {start})


@pytest.mark.parametrize("seed", range(3))
def test_traversal_equals_plain_search(spark, seed, monkeypatch, tmp_path):
    rnd = random.Random(seed)
    names = [f"n{i:02d}" for i in range(25)]
    pairs = [(rnd.choice(names), rnd.choice(names)) for _ in range(50)]
    s, e = symbols(spark, names), edges(spark, pairs).cache()
    for small in (10_000, 3):
        monkeypatch.setattr(traverse, "SMALL", small)
        for depth in (1, 3, 6):
            assert ids(traverse.callees(s, e, names[0], depth)) == bfs(pairs, names[0], depth)
            assert ids(traverse.callers(s, e, names[1], depth)) == bfs([(b, a) for a, b in pairs], names[1], depth)
    near = traverse.Adjacency.write(e, str(tmp_path / "near"), rows=7)
    for depth in (1, 3, 9):
        assert ids(traverse.callees(s, near, names[0], depth)) == bfs(pairs, names[0], depth)
        assert ids(traverse.callers(s, near, names[1], depth)) == bfs([(b, a) for a, b in pairs], names[1], depth)
    level = near.steps(True, "calls").near(names[:1])
    assert len(level.inputFiles()) <= 3 < len(near.out.ranges)
    many = traverse.reach(near, symbols(spark, names[:3]), 2, True, "calls").collect()
    for n in names[:3]:
        assert sorted(r.id for r in many if r.seed == n and r.id != n) == bfs(pairs, n, 2)


def test_search_patterns_and_paging(spark):
    s = symbols(spark, ["a_b", "aXb", "A%b", "É", "é", "b\\c"])
    names = lambda part: sorted(r.name for r in search.search(s, name=part).collect())
    assert names("a_b") == ["A%b", "aXb", "a_b"] and names("%") == sorted(["a_b", "aXb", "A%b", "É", "é", "b\\c"])
    assert names("é") == ["é"] and names("\\") == ["b\\c"]
    many = symbols(spark, [f"s{i:03d}" for i in range(150)])
    assert search.search(many).count() == 100 and search.search(many, -1, -5).first().id == "s000"
    assert [r.id for r in search.page(many, 2, 3).collect()] == ["s003", "s004", "s005"] and search.page(many, 1, 0).count() == 1


def test_mutations(spark):
    s, e = symbols(spark, ["a1", "a2"], file="a").union(symbols(spark, ["b1"], file="b")), edges(spark, [("a1", "b1"), ("b1", "a2"), ("b1", "b1")])
    g = model.Graph(model.empty(spark).projects, s, e, spark.createDataFrame([("a", "h", None, "p"), ("b", "h", None, "p")], model.FILES))
    out = mutate.delete_files(g, spark.createDataFrame([("a",)], "file string"))
    assert ids(out.symbols) == ["b1"] and [(r.from_id, r.to_id) for r in out.edges.collect()] == [("b1", "b1")] and out.files.count() == 1
    new = edges(spark, [("a1", "b1")])
    assert mutate.upsert_edges(e, new.union(new)).count() == 4
    both = symbols(spark, ["a1"], file="z", signature="new").union(symbols(spark, ["a1"], file="y"))
    row = mutate.upsert_symbols(s, both).where("id = 'a1'").collect()
    assert len(row) == 1 and row[0].signature == "new"
    assert mutate.prune(e, symbols(spark, ["a1", "b1"])).count() == 2
    assert search.orphan_edges(e, symbols(spark, ["a1", "b1"])).count() == 1
    empty = model.empty(spark)
    assert search.project_stats(empty.projects, s, e, empty.files).count() == 0


TEXTS = {
    "1": ("handlePaymentRequest", "func handlePaymentRequest(ctx context.Context)", ""),
    "2": ("handle_payment", "def handle_payment(...)", "Café au lait, naïve"),
    "3": ("Service.Greet", "a b c d e a", "one two three two one"),
    "4": ("b", "b a", "x a y z b"),
    "5": ("", "", ""),
}
MATCHES = [
    "handlePaymentRequest", "HANDLE_PAYMENT", "handlepayment", "handle*", "a b", "b a", "a OR three", "a NOT one", "NEAR(a b, 1)", "NEAR(a b, 2)", "NEAR(b a, 0)",
    "NEAR(one three one, 3)", "NEAR(one three)", "^b", "^a", "name:b", "name : b", '"a b"', '"b a"', "cafe", "CAFÉ", "id:1", "a b NOT x", "a NOT x OR handle*", "(a OR x) AND b",
    "{name signature}: b", "- name : b", "signature: (a AND b)", "a + b", '"one two" + three', '"a"*', "two one", "context", "naive", "lait NOT (a OR cafe)", "one AND two AND x", "NEAR",
]
BROKEN = ["Service.Greet", "def(", "+", "", "NOT a", "foo-bar", "a AND", "OR", '"open', "(a", "a)", "nope: a", "NEAR(a b, x)", "a NOT", "* a", "{name: a"]


@pytest.fixture(scope="module")
def lite():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(id unindexed, name, signature, doc_comment)")
    db.executemany("insert into t values (?, ?, ?, ?)", [(k, *v) for k, v in TEXTS.items()])
    return db


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(k, n, "function", "f", 1, 1, s, d, "p") for k, (n, s, d) in TEXTS.items()]
    rows += [("6", None, "function", "f", 1, 1, None, "only a comment", "p"), ("7", "only a name", "function", "f", 1, 1, None, None, "p")]
    return spark.createDataFrame(rows, model.SYMBOLS)


@pytest.fixture(scope="module")
def posted(texts, tmp_path_factory):
    """The index in files of three rows."""
    return Segment.write(fulltext.index(texts), str(tmp_path_factory.mktemp("postings")), fulltext.POSTINGS_KEY, rows=3)


def test_full_text_equals_sqlite(texts, posted, lite):
    lite.executemany("insert into t values (?, ?, ?, ?)", [("6", None, None, "only a comment"), ("7", "only a name", None, None)])
    indexed = fulltext.index(texts).cache()
    for k, q in enumerate(MATCHES):
        want = sorted(r[0] for r in lite.execute("select id from t where t match ?", (q,)))
        assert ids(fulltext.matches(posted, q)) == want, q
        if k % 5 == 0:
            assert ids(fulltext.matches(indexed, q)) == want, q
    assert ids(fulltext.search(texts, "only", indexed=posted)) == ["6", "7"]


def test_a_query_reads_the_files_of_its_terms(posted):
    assert len(posted.ranges) > 10 and [r[1:3] for r in posted.ranges] == sorted(r[1:3] for r in posted.ranges)
    for query, terms in (("cafe", ["cafe"]), ("one AND two", ["one", "two"]), ("handle*", []), ("z NOT zebra", ["z", "zebra"])):
        read = fulltext.matches(posted, query).inputFiles()
        names = set(posted.files_near(terms, ["handle"] if "*" in query else []))
        assert {f.rsplit("/", 1)[1] for f in read} == names and len(names) <= 4


def test_segments(spark, tmp_path):
    rows = [(f"k{i % 40:02d}", i) for i in range(200)] + [(None, 7)] * 5 + [("ü", 1)]
    seg = Segment.write(spark.createDataFrame(rows, "k string, v long").repartition(3), str(tmp_path / "s"), ["k", "v"], rows=20)
    assert sum(r[3] for r in seg.ranges) == len(rows) == seg.all().count()
    for keys in ([], ["k07"], ["k00", "k39", "absent"], ["ü"]):
        assert sorted(tuple(r) for r in seg.near(keys).collect()) == sorted(r for r in rows if r[0] in keys)
        assert len(seg.files_near(keys)) <= 2 * len(keys)
    assert seg.near((), ["k0"]).count() == 50 and seg.near(["ü"], ["k1"]).count() == 51
    ordered = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    for offset, limit in ((0, 10), (57, 30), (200, 50), (500, 5)):
        assert [tuple(r) for r in seg.page(offset, limit).collect()] == ordered[offset : offset + limit]
    assert len(seg.files_at(100, 10)[0]) <= 2
    nothing = Segment.write(spark.createDataFrame([], "k string, v long"), str(tmp_path / "n"), ["k"])
    assert nothing.all().count() == nothing.near(["a"]).count() == nothing.page(0, 5).count() == 0


@pytest.mark.parametrize("query", BROKEN)
def test_broken_queries_fail_as_in_sqlite(query, lite):
    with pytest.raises(sqlite3.OperationalError):
        lite.execute("select id from t where t match ?", (query,)).fetchall()
    with pytest.raises(match.MatchError):
        match.parse(query)


def test_tokens():
    assert tokens_of("handle_payment(Ünïcode x.Y)") == ["handle", "payment", "unicode", "x", "y"]


def test_an_index_is_made_where_texts_are_read(spark):
    docs = symbols(spark, ["a"], doc_comment="the cat the Cat").union(symbols(spark, ["b"], doc_comment="")).union(symbols(spark, ["c"], name=None))
    made = fulltext.index(docs)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.term, r.field, r.id, r.positions) for r in made.collect())
    assert got == [("a", "name", "a", [1]), ("b", "name", "b", [1]), ("cat", "doc_comment", "a", [2, 4]), ("the", "doc_comment", "a", [1, 3])]


def test_dependencies_read_no_edges_of_other_kinds(spark, tmp_path):
    from codeweft.plans import catalog

    for name in ("region", "nation", "customer", "supplier", "part"):  # lineitem, of which calls are made, isn't there
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert catalog.QUERIES["dependencies_d2"](spark, str(tmp_path)).count() == 2


def test_neighbouring_starts_share_rows(spark, monkeypatch):
    monkeypatch.setattr(traverse, "WORD", 2)
    starts = [f"n{i}" for i in range(8, 24)]
    pairs = [(f"n{i}", f"to{i // 2}.{k}") for i in range(8, 24) for k in range(5)]
    found, run = [], traverse.reach_bits
    monkeypatch.setattr(traverse, "reach_bits", lambda *a: found.append(run(*a)) or found[-1])
    many = {(r.seed, r.id) for r in traverse.reach(edges(spark, pairs), symbols(spark, starts[::-1]), 1, True, "calls").collect()}
    assert many == set(pairs) and found[0][1].count() <= 60  # 40 if every partition's first number is even
