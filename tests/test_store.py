"""Incremental commits against fresh ones, and writers that meet."""

from __future__ import annotations

import random

import pytest

from codeweft.operators import fulltext, search, traverse
from codeweft.plans import model
from codeweft.sources import store as st
from codeweft.sources.store import Changes, Conflict, Store

PROJECTS = [("p", "p", "/p", "go"), ("q", "q", "/q", "go")]


def content(rnd, file):
    """Symbols and edges of a file: some ids are shared between files, some ends are nowhere."""
    ids = [f"{file}.{k}" for k in range(rnd.randrange(1, 4))] + rnd.sample(["fmt", "os", "io"], rnd.randrange(3))
    project = rnd.choice(["p", "q", "unregistered"])
    symbols = [(i, f"name {i} {rnd.randrange(3)}", "function", file, rnd.randrange(9), 9, None, None, project) for i in ids]
    ends = [f"f{a}.{b}" for a in range(8) for b in range(3)] + ["fmt", "os", "io"]
    edges = [(rnd.choice(ids), rnd.choice(ends), rnd.choice(["calls", "imports"]), file, rnd.randrange(3)) for _ in range(rnd.randrange(7))]
    return symbols, edges + edges[:1]


def frames(spark, files, paths):
    symbols = [s for p in paths for s in files[p][0]]
    edges = [e for p in paths for e in files[p][1]]
    index = [(p, f"hash {files[p]}", None, files[p][0][0][8]) for p in paths]
    return [spark.createDataFrame(rows, ddl) for rows, ddl in ((symbols, model.SYMBOLS), (edges, model.EDGES), (index, model.FILES))]


def changes(spark, files, paths, gone):
    symbols, edges, index = frames(spark, files, paths)
    lost = spark.createDataFrame([(g,) for g in gone], "file string")
    return Changes(lost, symbols, edges, index, spark.createDataFrame(PROJECTS, model.PROJECTS))


def state(store):
    view = store.snapshot()
    out = {n: sorted(map(repr, view.rows(n).collect())) for n in st.TABLES}
    out["totals"] = sorted(map(repr, view.whole("totals").collect()))
    return out


def fresh(spark, path, files):
    store = Store(spark, path)
    symbols, edges, index = frames(spark, files, list(files))
    store.commit(spark.createDataFrame(PROJECTS, model.PROJECTS), symbols, edges, index)
    return store


@pytest.mark.parametrize("seed", range(2))
def test_random_updates_equal_a_fresh_commit(spark, tmp_path, seed, monkeypatch):
    rnd = random.Random(seed)
    store, files = Store(spark, str(tmp_path / "s")), {}
    if seed:
        monkeypatch.setattr(st, "SMALL", 2)  # tables are joined, not looked up
        monkeypatch.setattr(st, "FEW", 1)
    steps = 2 if seed else 3
    for step in range(steps):
        paths = rnd.sample([f"f{k}" for k in range(8)], 5 if step == 0 else 2)
        lost = rnd.sample(sorted(set(files) - set(paths)), 1) if step else []
        files = {f: c for f, c in files.items() if f not in lost} | {p: content(rnd, p) for p in paths}
        # what is replaced need not be named, what is removed must be
        assert store.apply(changes(spark, files, paths, lost)) == step + 1
    before = state(store)
    assert before == state(fresh(spark, str(tmp_path / "o"), files))
    view, g = store.snapshot(), store.graph()
    assert len(view.parts) == steps
    counted = search.counted_stats(g.projects, view.whole("totals")).collect()
    assert sorted(counted) == sorted(search.project_stats(g.projects, g.symbols, g.edges, g.files).collect())
    start = g.edges.first().from_id
    assert traverse.callees(g.symbols, view, start, 3).collect() == traverse.callees(g.symbols, g.edges, start, 3).collect()
    assert traverse.callers(g.symbols, view, start, 2).collect() == traverse.callers(g.symbols, g.edges, start, 2).collect()
    for query in ("f1 OR fmt", "na* NOT 2"):
        hits = fulltext.matches(view.postings, query).collect()
        assert sorted(hits) == sorted(fulltext.matches(fulltext.index(g.symbols), query).collect())
    assert store.compact() == steps + 1 and len(store.snapshot().parts) == 1 and state(store) == before
    assert store.vacuum() == steps and state(store) == before


def test_an_update_writes_what_changed(spark, tmp_path):
    rnd = random.Random(3)
    files = {f"g{k}": content(rnd, f"g{k}") for k in range(300)}
    store = fresh(spark, str(tmp_path / "s"), files)
    files["g7"] = content(rnd, "g7")
    store.apply(changes(spark, files, ["g7"], []))
    view = store.snapshot()
    (_, base), (_, part) = view.parts
    sizes = {n: (view._segment(base, n).all().count(), view._segment(part, n).all().count()) for n in st.TABLES}
    assert all(new <= 60 for _, new in sizes.values()) and sizes["symbols"][0] > 500, sizes


def test_writers_of_other_files_both_land(spark, tmp_path, monkeypatch):
    rnd = random.Random(4)
    files = {f"f{k}": content(rnd, f"f{k}") for k in range(4)}
    store = fresh(spark, str(tmp_path / "s"), files)
    second, late = Store(spark, store.path), dict(files)
    late["f9"] = content(rnd, "f9")
    written, once = Store._write_part, []

    def overtaken(self, *args):
        out = written(self, *args)
        if self is store and not once:
            once.append(second.apply(changes(spark, late, ["f9"], [])))
        return out

    monkeypatch.setattr(Store, "_write_part", overtaken)
    files["f1"] = content(rnd, "f1")
    assert store.apply(changes(spark, files, ["f1"], ["f2"])) == 3 and once == [2]
    both = {f: c for f, c in {**late, **files}.items() if f != "f2"}
    assert state(store) == state(fresh(spark, str(tmp_path / "o"), both))
    once.clear()
    same = changes(spark, {**both, "f1": content(rnd, "f1")}, ["f1"], [])
    monkeypatch.setattr(second, "apply", lambda _: Store.apply(second, same))
    with pytest.raises(Conflict):
        store.apply(changes(spark, files, ["f1"], []))
    assert store.version() == 4


def test_an_abandoned_commit_is_passed_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "PATIENCE", 0.0)
    rnd = random.Random(5)
    files = {"a": content(rnd, "a")}
    store = fresh(spark, str(tmp_path / "s"), files)
    (tmp_path / "s" / "commits" / f"{2:012d}").write_text("")
    assert store.version() == 1 and store.snapshot() is not None
    files["b"] = content(rnd, "b")
    assert store.apply(changes(spark, files, ["b"], [])) == 3 and store.version() == 3
    assert {r.path for r in store.table("files").collect()} == {"a", "b"}


def test_few_files_of_many_rows_are_sorted_by_many_tasks(spark, tmp_path, monkeypatch):
    class Seen(Exception):
        pass

    def write(*args, few=False, **more):
        raise Seen(few)

    rnd = random.Random(5)
    files = {"a": content(rnd, "a"), "b": content(rnd, "b")}
    view = fresh(spark, str(tmp_path / "s"), files)
    monkeypatch.setattr(st.Segment, "write", write)
    for most, few in ((100_000, True), (0, False)):
        monkeypatch.setattr(st, "FEW_ROWS", most)
        with pytest.raises(Seen) as seen:
            view.apply(changes(spark, files, ["a"], []))
        assert seen.value.args == (few,)
