"""Command line: install, build, update, prune, agent mcp, ui, serve, clean."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession

from codeweft import api, build
from codeweft.sources import config
from codeweft.sources.store import Store

STORE_NAME = ".codeweft"
LARGE = 50_000


def session() -> SparkSession:
    s = SparkSession.builder.appName("codeweft").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="codeweft", description=__doc__)
    p.add_argument("--workspace", default=".", help="a folder in or above which the configuration lies")
    p.add_argument("--output", choices=("text", "json"), default="text")
    p.add_argument("--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    install = sub.add_parser("install", help="detect projects and write the configuration")
    install.add_argument("--distributed", action="store_true", help="list the tree by Spark tasks")
    sub.add_parser("build", help="bring the graph up to the sources")
    sub.add_parser("update", help="the same for a store that exists, by the hash of every file")
    sub.add_parser("prune", help="remove the rows of edges whose ends are missing")
    agent = sub.add_parser("agent", help="services for agents").add_subparsers(dest="service", required=True)
    servers = [
        agent.add_parser("mcp", help="JSON-RPC at /mcp"),
        sub.add_parser("ui", help="the page, and REST at /api"),
        sub.add_parser("serve", help="all of these"),
    ]
    for server in servers:
        server.add_argument("--host", default="127.0.0.1")
        server.add_argument("--port", type=int, default=8080)
    sub.add_parser("clean", help="remove configuration and store")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING, format="%(message)s")
    try:
        out = run(a)
    except config.ConfigError as e:
        print(e, file=sys.stderr)
        return 1
    if out is not None:
        print(json.dumps(out) if a.output == "json" else "\n".join(f"{k}: {v}" for k, v in out.items()))
    return 0


def run(a: argparse.Namespace) -> dict | None:
    if a.command == "install":
        root = os.path.abspath(a.workspace)
        found = build.detect(session(), root) if a.distributed else config.detect(root)
        return {"config": config.save(config.Workspace(os.path.basename(root), found), root), "projects": len(found)}
    if a.command == "clean":
        at = config.find(a.workspace)
        root = os.path.dirname(at) if at else os.path.abspath(a.workspace)
        store = Store(session(), os.path.join(root, STORE_NAME)).clean()
        if at:
            os.remove(at)
        return {"config_removed": bool(at), "store_removed": store}
    ws, root = config.load(a.workspace)
    spark = session()
    store = Store(spark, os.path.join(root, STORE_NAME))
    if a.command in ("build", "update"):
        if a.command == "update" and not store.version():
            raise config.ConfigError("no store yet: build first")
        return asdict(build.run(spark, store, ws, root, trust_times=a.command == "build"))
    if a.command == "prune":
        return {"pruned": store.prune(), "edges": store.table("edges").count()}
    symbols, edges, raw = (store.table(t).count() for t in ("symbols", "edges", "raw_edges"))
    if symbols > LARGE:
        logging.warning("large graph: %d symbols", symbols)
    print(f"{symbols} symbols, {raw} edges, {edges} of them with both ends, at http://{a.host}:{a.port}", file=sys.stderr)
    api.serve(store, a.host, a.port, tools=a.command != "ui", pages=a.command != "agent").serve_forever()
    return None


if __name__ == "__main__":
    sys.exit(main())
