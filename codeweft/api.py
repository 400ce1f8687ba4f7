"""The query services: JSON-RPC tools and REST endpoints, on the standard library's HTTP server."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from importlib import resources
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame

from codeweft.functions.match import MatchError
from codeweft.operators import fulltext, search, traverse
from codeweft.sources.store import Store

# Fixed values of the protocol.
PROTOCOL = "2024-11-05"
PARSE_ERROR, METHOD_NOT_FOUND, INVALID_PARAMS, INTERNAL_ERROR = -32700, -32601, -32602, -32603

PREFIX = "codeweft/"


def wire(df: DataFrame) -> list[dict]:
    """Symbols under their wire names."""
    names = ("ID", "Name", "Kind", "File", "StartLine", "EndLine", "Signature", "DocComment", "ProjectID")
    columns = ("id", "name", "kind", "file", "start_line", "end_line", "signature", "doc_comment", "project_id")
    return [dict(zip(names, r, strict=True)) for r in df.select(*columns).collect()]


class Engine:
    """Queries over a store's last snapshot; results are pages, so they come to the driver."""

    def __init__(self, store: Store):
        self.store = store

    def search(self, limit: int = 0, offset: int = 0, **filters: str) -> list[dict]:
        view = self.store.snapshot()
        symbols = view.named(filters.get("name", "")) if view else self.store.table("symbols")
        return wire(search.search(symbols, limit, offset, **filters))

    def walk(self, name: str, symbol_id: str, depth: int) -> list[dict]:
        return wire(getattr(traverse, name)(*self._edges(), symbol_id, depth))

    def implementors(self, symbol_id: str) -> list[dict]:
        return wire(traverse.implementors(*self._edges(), symbol_id))

    def grep(self, query: str, limit: int = 20) -> list[dict]:
        symbols, _ = self._edges()
        view = self.store.snapshot()
        return wire(fulltext.search(symbols, query, limit, view.postings if view else None))

    def _edges(self):
        """Symbols, and edges by either end."""
        view = self.store.snapshot()
        return (view.rows("symbols"), view) if view else (self.store.table("symbols"), self.store.table("edges"))

    def detail(self, symbol_id: str) -> dict | None:
        own = wire(search.lookup(self.store.graph().symbols, symbol_id))
        if not own:
            return None
        return {"symbol": own[0], "callers": self.walk("callers", symbol_id, 1), "callees": self.walk("callees", symbol_id, 1)}

    def stats(self) -> list[dict]:
        rows = search.counted_stats(self.store.table("projects"), self.store.table("totals")).orderBy("project_id").collect()
        return [{"ProjectID": r.project_id, "SymbolCount": r.symbol_count, "EdgeCount": r.edge_count, "FileCount": r.file_count} for r in rows]

    def graph_page(self, page: int, size: int, project_id: str, kind: str) -> dict:
        """A page of nodes without modules, unless a kind is given, and the edges that leave them."""
        g, view = self.store.graph(), self.store.snapshot()
        exclude = "" if kind else "module"
        if view and not (project_id or kind):
            nodes = search.read_symbols(view.page((page - 1) * size, size)).orderBy("name", "id")
        else:
            nodes = search.page(g.symbols, page, size, project_id=project_id, kind=kind, exclude_kind=exclude)
        rows = wire(nodes)
        ids = self.store.spark.createDataFrame([(r["ID"],) for r in rows], "id string")
        edges = search.display_edges(search.edges_from(g.edges, g.symbols, ids)).collect() if rows else []
        total = search.count_symbols(g.symbols, project_id=project_id, exclude_kind="module").first().n
        return {
            "nodes": rows,
            "edges": [{"FromID": e.from_id, "ToID": e.to_id, "Kind": e.kind} for e in edges],
            "page": page, "page_size": size, "total_nodes": total, "total_edges": len(edges),
        }


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def _required(args: dict, name: str) -> str:
    v = args.get(name)
    if not isinstance(v, str) or not v:
        raise RpcError(INVALID_PARAMS, f"{name} must be a non-empty string")
    return v


def _text(args: dict, name: str) -> str:
    v = args.get(name, "")
    if v is None:
        return ""
    if not isinstance(v, str):
        raise RpcError(INVALID_PARAMS, f"{name} must be a string")
    return v


def _number(args: dict, name: str, default: int) -> int:
    v = args.get(name)
    if v is None:
        return default
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        raise RpcError(INVALID_PARAMS, f"{name} must be a number")
    return int(v)


def _between(value: int, low: int, high: int, name: str) -> int:
    if not low <= value <= high:
        raise RpcError(INVALID_PARAMS, f"{name} must be between {low} and {high}")
    return value


def _walk_tool(name: str, depth: int) -> Callable[[Engine, dict], Any]:
    return lambda e, a: e.walk(name, _required(a, "symbolId"), _between(_number(a, "depth", depth), 1, 10, "depth"))


_STRING, _INTEGER = {"type": "string"}, {"type": "number"}

#: name: (description, properties, required, run)
TOOLS: dict[str, tuple[str, dict, list[str], Callable[[Engine, dict], Any]]] = {
    "search": (
        "Find symbols by name, kind, project and file.",
        {"name": _STRING, "kind": _STRING, "projectId": _STRING, "file": _STRING, "limit": _INTEGER, "offset": _INTEGER},
        [],
        lambda e, a: e.search(_number(a, "limit", 20), _number(a, "offset", 0), name=_text(a, "name"), kind=_text(a, "kind"), project_id=_text(a, "projectId"), file=_text(a, "file")),
    ),
    "callers": ("What calls a symbol, within a depth.", {"symbolId": _STRING, "depth": _INTEGER}, ["symbolId"], _walk_tool("callers", 3)),
    "callees": ("What a symbol calls, within a depth.", {"symbolId": _STRING, "depth": _INTEGER}, ["symbolId"], _walk_tool("callees", 3)),
    "dependencies": ("What a module imports, within a depth.", {"symbolId": _STRING, "depth": _INTEGER}, ["symbolId"], _walk_tool("dependencies", 2)),
    "dependents": ("What imports a module, within a depth.", {"symbolId": _STRING, "depth": _INTEGER}, ["symbolId"], _walk_tool("dependents", 2)),
    "implementors": ("What implements an interface.", {"symbolId": _STRING}, ["symbolId"], lambda e, a: e.implementors(_required(a, "symbolId"))),
    "grep": (
        "Full-text search in names, signatures and comments.",
        {"query": _STRING, "limit": _INTEGER},
        ["query"],
        lambda e, a: e.grep(_required(a, "query"), _between(_number(a, "limit", 20), 1, 100, "limit")),
    ),
    "symbol": ("A symbol with its direct callers and callees.", {"symbolId": _STRING}, ["symbolId"], lambda e, a: e.detail(_required(a, "symbolId"))),
    "stats": ("Counts of each project.", {}, [], lambda e, a: e.stats()),
}


def rpc(engine: Engine, body: bytes) -> dict:
    """Answer one JSON-RPC request."""
    try:
        request = json.loads(body)
        if not isinstance(request, dict):
            raise ValueError("not an object")
    except ValueError as e:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": f"parse error: {e}"}}
    answer: dict = {"jsonrpc": "2.0", "id": request.get("id")}
    try:
        answer["result"] = _dispatch(engine, request.get("method"), request.get("params") or {})
    except RpcError as e:
        answer["error"] = {"code": e.code, "message": str(e)}
    except Exception as e:  # whatever a query fails with is the caller's to see, not the server's end
        answer["error"] = {"code": INTERNAL_ERROR, "message": str(e)}
    return answer


def _dispatch(engine: Engine, method: Any, params: dict) -> dict:
    if method == "initialize":
        return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "codeweft", "version": "0.1"}}
    if method == "tools/list":
        schema = lambda props, need: {"type": "object", "properties": props, "required": need}
        return {"tools": [{"name": PREFIX + n, "description": d, "inputSchema": schema(p, q)} for n, (d, p, q, _) in TOOLS.items()]}
    if method != "tools/call":
        raise RpcError(METHOD_NOT_FOUND, f"unknown method: {method}")
    if not isinstance(params, dict):
        raise RpcError(INVALID_PARAMS, "params must be an object")
    tool = TOOLS.get(str(params.get("name", "")).removeprefix(PREFIX))
    if tool is None:
        raise RpcError(METHOD_NOT_FOUND, f"unknown tool: {params.get('name')}")
    args = params.get("arguments") or {}
    if not isinstance(args, dict):
        raise RpcError(INVALID_PARAMS, "arguments must be an object")
    return {"content": [{"type": "text", "text": json.dumps(tool[3](engine, args), indent=2, ensure_ascii=False)}]}


def _clamped(query: dict, name: str, default: int, low: int, high: int | None = None) -> int:
    try:
        v = int(query.get(name, [""])[0])
    except ValueError:
        return default
    return max(v, low) if high is None else min(max(v, low), high)


def rest(engine: Engine, url: str) -> tuple[int, Any]:
    """Status and JSON body of a GET."""
    parts = urlsplit(url)
    query, at = parse_qs(parts.query), parts.path
    get = lambda name: query.get(name, [""])[0]
    try:
        if at == "/api/graph":
            size = _clamped(query, "page_size", 100, 1, 500)
            return 200, engine.graph_page(_clamped(query, "page", 1, 1), size, get("project_id"), get("kind"))
        if at == "/api/symbols":
            limit, offset = _clamped(query, "limit", 50, 1, 500), _clamped(query, "offset", 0, 0)
            return 200, engine.search(limit, offset, name=get("name"), kind=get("kind"), project_id=get("project_id"), file=get("file"))
        if at.startswith("/api/symbol/"):
            wanted = unquote(at.removeprefix("/api/symbol/"))
            if not wanted:
                return 400, {"error": "symbol id is missing"}
            found = engine.detail(wanted)
            return (200, found) if found else (404, {"error": "no such symbol"})
        if at == "/api/projects":
            return 200, engine.stats()
        if at == "/api/search":
            if not get("q"):
                return 400, {"error": "q is missing"}
            return 200, engine.grep(get("q"), _clamped(query, "limit", 20, 1, 100))
    except MatchError as e:
        return 500, {"error": str(e)}
    except Exception as e:
        return 500, {"error": str(e)}
    return 404, {"error": "not found"}


def page() -> bytes:
    """The page at the server's root."""
    return resources.files("codeweft.ui").joinpath("index.html").read_bytes()


def handler(engine: Engine, tools: bool = True, pages: bool = True) -> type[BaseHTTPRequestHandler]:
    """``tools``: JSON-RPC at /mcp; ``pages``: REST at /api and the page at the root."""

    class Handler(BaseHTTPRequestHandler):
        timeout = 30

        def _send(self, status: int, body: Any) -> None:
            whole = isinstance(body, bytes)
            raw = body if whole else json.dumps(body, ensure_ascii=False).encode() if body is not None else b""
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8" if whole else "application/json")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Access-Control-Allow-Methods", "GET, OPTIONS")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            if tools and self.path == "/mcp":
                self._send(405, {"error": "POST only"})
            elif pages and urlsplit(self.path).path in ("/", "/index.html"):
                self._send(200, page())
            else:
                self._send(*(rest(engine, self.path) if pages else (404, {"error": "not found"})))

        def do_OPTIONS(self) -> None:
            self._send(204, None)

        def do_POST(self) -> None:
            if not tools or urlsplit(self.path).path != "/mcp":
                self._send(405, {"error": "GET only"})
                return
            self._send(200, rpc(engine, self.rfile.read(int(self.headers.get("Content-Length") or 0))))

        def do_PUT(self) -> None:
            self._send(405, {"error": "method not allowed"})

        do_DELETE = do_PATCH = do_PUT

        def log_message(self, *args: Any) -> None:
            pass

    return Handler


def serve(store: Store, host: str = "127.0.0.1", port: int = 8080, tools: bool = True, pages: bool = True) -> ThreadingHTTPServer:
    """A server ready for ``serve_forever``; local unless told otherwise."""
    return ThreadingHTTPServer((host, port), handler(Engine(store), tools, pages))
