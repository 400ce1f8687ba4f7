"""Scan, configuration, store, build and the services, end to end."""

from __future__ import annotations

import json
import os
import threading
import urllib.error
import urllib.request

import pytest

from codeweft import api, build
from codeweft.sources import config, scan
from codeweft.sources.store import Store

FILES = {
    "svc/go.mod": "module example.com/x/pay\n",
    "svc/a.go": 'package a\n\nimport "fmt"\n\nfunc Pay() { check() }\n\nfunc check() { fmt.Println("x") }\n',
    "svc/b.go": 'package a\n\nimport "fmt"\n\nfunc Other() { fmt.Print() }\n',
    "svc/_hidden.go": "package a\nfunc Hidden() {}\n",
    "svc/vendor/v.go": "package v\nfunc V() {}\n",
    "web/package.json": "{}",
    "web/x.js": "function one() { return two(); }\nfunction two() {}\n",
}


@pytest.fixture()
def tree(tmp_path):
    for name, text in FILES.items():
        p = tmp_path / "ws" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path / "ws"


def test_glob_and_excludes():
    ok = lambda p, s: bool((r := scan.glob_regex(p)) and r.match(s))
    assert ok("*.go", "a.go") and not ok("*.go", "d/a.go") and not ok("*.go", "a.gox")
    assert ok("a/**/*.go", "a/x.go") and ok("a/**/*.go", "a/b/c/x.go") and not ok("a/**/*.go", "b/x.go")
    assert ok("**", "a/b") and ok("a/**", "a/b/c") and ok("a/**", "a") and ok("[ab]?", "bz") and not ok("[!a]", "a")
    assert scan.glob_regex("[a") is None
    ex = scan.Excludes(["node_modules/", "*.min.js", "dist/*.js"])
    assert ex("x/node_modules", True) and not ex("x/node_modules", False)
    assert ex("a/b.min.js", False) and ex("dist/b.js", False) and not ex("src/dist/b.js", False)


def test_walk_keeps_underscored_files_and_prunes(tree):
    found = [os.path.relpath(p, tree) for p in scan.walk(str(tree), ["vendor/"], (".go",))]
    assert found == ["svc/_hidden.go", "svc/a.go", "svc/b.go"]
    assert list(scan.walk(str(tree / "nowhere"), [], (".go",))) == []


def test_listing_by_tasks(spark, tree):
    for k in range(40):
        deep = tree / "svc" / f"d{k % 4}" / f"e{k % 10}" / f"f{k}"
        deep.mkdir(parents=True)
        (deep / f"x{k}.go").write_text("package x\n")
        (deep / "vendor").mkdir()
        (deep / "vendor" / "v.go").write_text("package v\n")
    os.symlink(tree / "svc", tree / "web" / "link")
    trees = [scan.Tree(str(tree), ("vendor/",), (".go",)), scan.Tree(str(tree / "web"), (), (".js",)), scan.Tree(str(tree / "no"), (), (".js",))]
    want = [{os.path.relpath(p, t.root) for p in scan.walk(t.root, list(t.excludes), t.extensions)} for t in trees]
    for most in (1, 7, 2000):
        rows = scan.listed(spark, trees, per_task=most).collect()
        assert [{r.rel for r in rows if r.nth == i} for i in range(3)] == want and len(rows) == sum(map(len, want)) == 44
        assert all(r.mod_time is not None for r in rows)
    for some in (1, 5, 1000):
        parts = scan.subtrees(str(tree), ["vendor/"], some)
        got = [p for d, deep in parts for p in scan.walk(str(tree), ["vendor/"], (".go",), d, deep)]
        assert len(got) == len(set(got)) and {os.path.relpath(p, tree) for p in got} == want[0]
    (tree / ".hidden").mkdir()
    (tree / ".hidden" / "go.mod").write_text("module no\n")
    (tree / "go.mod").write_text("module top\n")
    assert build.detect(spark, str(tree)) == config.detect(str(tree)) and len(config.detect(str(tree))) == 3
    read = scan.read_tree(spark, str(tree), "p", ["vendor/"], (".go",)).collect()
    assert {os.path.relpath(r.path, tree) for r in read} == want[0] and all(bytes(r.content).startswith(b"package") for r in read)


def test_config(tree, tmp_path):
    found = config.detect(str(tree))
    assert [(p.name, p.path, p.language) for p in found] == [("pay", "svc", "go"), ("web", "web", "javascript")]
    config.save(config.Workspace("w", [*found, config.Project("gone", "nowhere", "go")]), str(tree))
    ws, root = config.load(str(tree / "svc"))
    assert root == str(tree) and [p.name for p in ws.projects] == ["pay", "web"] and ws.projects[0] == found[0]
    for bad in (config.Workspace("", []), config.Workspace("w", [config.Project("p", "x", "cobol")]), config.Workspace("w", [config.Project("", "x", "go")])):
        with pytest.raises(config.ConfigError):
            config.validate(bad)
    (tree / config.CONFIG_NAME).write_text("{")
    with pytest.raises(config.ConfigError):
        config.load(str(tree))
    part = lambda name, path, language="go", inner=(): config.Project(name, path, language, services=list(inner))
    wrong = (part("", "svc"), part("s", "svc", "cobol"), part("s", "svc", inner=[part("t", "web")]), part("", "nowhere"))
    for service in wrong:
        with pytest.raises(config.ConfigError):
            config.validate(config.Workspace("w", [part("p", "svc", inner=[service])]), str(tree))
        assert config.validate(config.Workspace("w", [part("p", "nowhere", inner=[service])]), str(tree)).projects == []
    fine = [part("root", ""), part("p", "svc", inner=[part("s", "nowhere", inner=[part("t", "x")]), part("u", "web")])]
    assert config.validate(config.Workspace("w", fine), str(tree)).projects == fine
    assert config.contained(str(tree), "svc/../web") and not config.contained(str(tree), "../x")
    outer = config.Project("o", "o", "go", services=[config.Project("i", "i", "go")])
    assert [p.name for p in config.flatten([outer])] == ["i"]
    assert config.merge_excludes(["vendor/", "mine/"], ("vendor/", "dist/")) == ["vendor/", "mine/", "dist/"]


def _state(store):
    g = store.graph()
    return {n: sorted(map(tuple, getattr(g, n).drop("mod_time").collect())) for n in ("projects", "symbols", "edges", "files")}


@pytest.fixture()
def built(spark, tree, tmp_path):
    ws = config.Workspace("w", config.detect(str(tree)))
    store = Store(spark, str(tmp_path / "store"))
    return ws, store, build.run(spark, store, ws, str(tree))


def test_build_update_and_services(spark, tree, tmp_path, built):
    ws, store, first = built
    assert (first.added, first.errors) == (4, 0) and first.pruned > 0
    again = build.run(spark, store, ws, str(tree))
    assert (again.added, again.modified, again.deleted, again.unchanged, store.version()) == (0, 0, 0, 4, 1)

    when = (tree / "svc/a.go").stat().st_mtime
    (tree / "svc/a.go").write_text("package a\n")  # a file of the same time isn't read
    os.utime(tree / "svc/a.go", (when, when))
    os.utime(tree / "svc/b.go", (when + 9, when + 9))  # one of another time is, and its hash decides
    again = build.run(spark, store, ws, str(tree))
    assert (again.added, again.modified, again.deleted, again.unchanged, store.version()) == (0, 0, 0, 4, 1)

    (tree / "svc/b.go").write_text("package a\n\nfunc Else() {}\n")
    os.utime(tree / "svc/b.go", (when + 9, when + 9))
    assert build.run(spark, store, ws, str(tree), trust_times=False).modified == 2  # an update hashes every file

    (tree / "svc/a.go").write_text("package a\n\nfunc Pay() { fresh() }\n\nfunc fresh() {}\n")
    (tree / "svc/b.go").unlink()
    (tree / "web/y.js").write_text("function three() {}\n")
    changed = build.run(spark, store, ws, str(tree))
    assert (changed.added, changed.modified, changed.deleted) == (1, 1, 1)
    other = Store(spark, str(tmp_path / "other"))
    build.run(spark, other, ws, str(tree))
    assert _state(store) == _state(other)
    assert store.vacuum() == 0 and store.compact() == 4 and store.vacuum() == 3 and _state(store) == _state(other)

    engine = api.Engine(store)
    server = api.serve(store, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def get(path, data=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data=data), timeout=60) as r:
                return r.status, json.loads(r.read() or b"null")
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read() or b"null")

    def call(tool, **args):
        body = {"jsonrpc": "2.0", "id": 7, "method": "tools/call", "params": {"name": f"codeweft/{tool}", "arguments": args}}
        return get("/mcp", json.dumps(body).encode())[1]

    said = lambda answer: json.loads(answer["result"]["content"][0]["text"])
    pay = engine.search(name="pay")[0]
    assert pay["Name"] == "Pay" and pay["ProjectID"] == "pay"
    fresh = said(call("callees", symbolId=pay["ID"], depth=2))
    assert [s["Name"] for s in fresh] == ["fresh"]
    assert [s["Name"] for s in said(call("callers", symbolId=fresh[0]["ID"]))] == ["Pay"]
    assert [s["Name"] for s in said(call("grep", query="thr*"))] == ["three"]
    assert said(call("symbol", symbolId="none")) is None
    assert {s["ProjectID"]: s["FileCount"] for s in said(call("stats"))} == {"pay": 2, "web": 2}
    assert call("callers", symbolId=5)["error"]["code"] == -32602
    assert call("callers", symbolId="x", depth=11)["error"]["code"] == -32602
    assert call("grep", query="a", limit=101)["error"]["code"] == -32602
    assert call("grep", query="a.b")["error"]["code"] == -32603
    assert call("nothing")["error"]["code"] == -32601
    assert get("/mcp", b"{")[1]["error"]["code"] == -32700
    assert get("/mcp", b'{"method": "x"}')[1]["error"]["code"] == -32601
    assert get("/mcp")[0] == 405
    assert len(get("/mcp", b'{"method": "tools/list"}')[1]["result"]["tools"]) == 9
    status, page = get("/api/graph?page=0&page_size=9999")
    assert status == 200 and page["page_size"] == 500 and page["total_edges"] == 2 and page["total_nodes"] == 6
    assert get("/api/symbols?name=one&limit=x")[1][0]["Name"] == "one"
    assert get(f"/api/symbol/{pay['ID']}")[1]["callees"][0]["Name"] == "fresh"
    assert get("/api/symbol/none")[0] == 404 and get("/api/symbol/")[0] == 400
    assert get("/api/search")[0] == 400 and get("/api/search?q=a%20NOT")[0] == 500 and get("/api/search?q=fresh")[0] == 200
    assert get("/api/projects")[0] == 200 and get("/x")[0] == 404
    with urllib.request.urlopen(base + "/", timeout=60) as r:
        assert r.headers["Content-Type"].startswith("text/html") and b"/api/graph" in r.read()
    server.shutdown()
    for tools, pages, paths in ((False, True, {"/": 200, "/mcp": 404}), (True, False, {"/": 404, "/mcp": 405})):
        one = api.serve(store, port=0, tools=tools, pages=pages)
        threading.Thread(target=one.serve_forever, daemon=True).start()
        for path, status in paths.items():
            try:
                with urllib.request.urlopen(f"http://127.0.0.1:{one.server_port}{path}", timeout=60) as r:
                    assert r.status == status
            except urllib.error.HTTPError as e:
                assert e.code == status
        one.shutdown()


def test_command_line(spark, tree, capsys):
    from codeweft import cli

    at = ["--workspace", str(tree), "--output", "json"]
    told = lambda *a: (cli.main([*at, *a]), json.loads(capsys.readouterr().out or "null"))
    assert cli.main([*at, "build"]) == 1
    capsys.readouterr()
    assert told("install")[1]["projects"] == 2
    assert cli.main([*at, "update"]) == 1
    capsys.readouterr()
    first = told("build")[1]
    assert first["added"] == 4 and first["symbols"] == first["symbol_delta"]
    (tree / "web/x.js").unlink()
    changed = told("update")[1]
    assert (changed["deleted"], changed["symbol_delta"]) == (1, -2)
    pruned = told("prune")[1]
    assert pruned["edges"] == changed["edges"] and pruned["pruned"] == changed["pruned"] > 0
    assert told("prune")[1]["pruned"] == 0
    assert told("clean")[1] == {"config_removed": True, "store_removed": True}


def test_following_a_folder(spark, tree, tmp_path):
    from codeweft.streaming.follow import follow

    ws, store = config.Workspace("w", config.detect(str(tree))), Store(spark, str(tmp_path / "store"))
    run = lambda: follow(spark, store, ws, str(tree), str(tree / "svc"), str(tmp_path / "checkpoint"), once=True).awaitTermination()
    run()
    assert store.version() == 1 and store.table("files").count() == 4
    (tree / "svc/c.go").write_text("package a\nfunc Late() {}\n")
    run()
    run()
    assert store.version() == 2 and api.Engine(store).search(name="Late")
    # a batch looks at its own files: one new, one rewritten, one excluded, one no source; others' changes wait for a build
    (tree / "svc/deep").mkdir()
    (tree / "svc/deep/d.go").write_text("package d\nfunc Deep() {}\n")
    (tree / "svc/vendor/w.go").write_text("package v\nfunc W() {}\n")
    (tree / "svc/notes.txt").write_text("func No() {}\n")
    (tree / "web/x.js").write_text("function three() {}\n")
    (tree / "svc/b.go").unlink()
    run()
    found = lambda s: {r["Name"] for r in api.Engine(s).search(limit=100)}
    assert store.version() == 3 and {"Deep", "Other", "one", "Late"} <= found(store) and not {"W", "No", "three"} & found(store)


def test_extraction_rows(spark):
    files = spark.createDataFrame([("a.go", "p", bytearray(b"package a\nfunc A() {}")), ("b.bin", "p", bytearray(b"\xff"))], "path string, project_id string, content binary")
    rows = build.extract_files(files).collect()
    assert [(r.rec, r.name, r.project_id) for r in rows] == [("symbol", "A", "p")]


def test_filters_and_columns_reach_the_scan(built):
    _, store, _ = built
    g = store.graph()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    step = plan(g.edges.where("kind = 'calls'").where(g.edges["from_id"].isin(["a", "b"])).select("to_id"))
    assert "EqualTo(kind,calls)" in step and "In(from_id, [a,b])" in step and "file:string" not in step.split("ReadSchema")[1]
    from codeweft.operators import search

    page = plan(search.search(g.symbols, 5, kind="function"))
    assert "EqualTo(kind,function)" in page and "TakeOrderedAndProject" in page
