"""Scanners against hand-derived rows."""

from __future__ import annotations

import time

import pytest

from codeweft.functions.ids import symbol_id
from codeweft.sources.extract import extensions, extract


def rows(path: str, src: str) -> tuple[set, set]:
    out = extract(path, src)
    names = {s["id"]: s["name"] for s in out.symbols}
    symbols = {(s["name"], s["kind"], s["start_line"], s["end_line"]) for s in out.symbols}
    edges = {(names.get(e["from_id"], "?"), names.get(e["to_id"], "?"), e["kind"], e["line"]) for e in out.edges}
    return symbols, edges


GO = '''package demo

import "fmt"

type Speaker interface {
	Say() string
}

type Loud struct{ n int }

func (l *Loud) Say() string {
	return fmt.Sprintf("} %d", l.n) // { not a brace
}

func run() string {
	l := &Loud{}
	helper()
	return l.Say()
}

func helper() {}

var first, second = 1, 2
'''


def test_go():
    symbols, edges = rows("demo/a.go", GO)
    assert symbols == {
        ("demo/a.go", "module", 1, 1), ("fmt", "module", 3, 3), ("Speaker", "interface", 5, 7), ("Loud", "type", 9, 9),
        ("Loud.Say", "method", 11, 13), ("run", "function", 15, 19), ("helper", "function", 21, 21), ("first", "variable", 23, 23),
    }
    assert edges == {
        ("demo/a.go", "fmt", "imports", 3), ("Loud.Say", "?", "calls", 12), ("run", "helper", "calls", 17), ("run", "?", "calls", 18),
    }


def test_go_signatures_groups_and_generics():
    out = extract("a.go", 'package a\nimport (\n "x"\n)\nfunc (Thing) Bare(a int) (b int, err error) {\n}\ntype (\n A int\n B struct{}\n)\nfunc Map[T any](f func(T) T) interface{} { return nil }\n')
    by = {s["name"]: s for s in out.symbols}
    assert by["Bare"]["signature"] == "func (Thing) Bare(a int) (b int, err error)" and by["Bare"]["kind"] == "method"
    assert {"A", "B", "a.go"} <= set(by) and "x" not in by and not out.edges
    assert by["Map"]["signature"] == "func Map[T any](f func(T) T) interface{}"


TS = '''import { Base } from "./base";

interface Pet {
  name: string;
}

class Cat extends Base implements Pet, Other {
  constructor(public name: string) { super(); }
  purr(): string { return hum(this.name); }
}

const hum = (s: string): string => {
  return s.trim();
};

function make(name: string): Pet {
  return new Cat(hum(name));
}
'''


def test_typescript():
    symbols, edges = rows("src/cat.ts", TS)
    assert symbols == {
        ("src/cat.ts", "module", 1, 1), ("./base", "module", 1, 1), ("Pet", "interface", 3, 5), ("Cat", "class", 7, 10),
        ("Cat.constructor", "method", 8, 8), ("Cat.purr", "method", 9, 9), ("hum", "function", 12, 14), ("make", "function", 16, 18),
    }
    assert edges == {
        ("src/cat.ts", "./base", "imports", 1), ("Cat", "?", "extends", 7), ("Cat", "Pet", "implements", 7), ("Cat", "?", "implements", 7),
        ("Cat.purr", "hum", "calls", 9), ("hum", "?", "calls", 13), ("make", "hum", "calls", 17),
    }


def test_javascript_has_function_values_and_no_heritage():
    symbols, edges = rows("a.js", "class A extends B {\n  on(f) { this.list.push(f); }\n}\nconst go = function (x) {\n  return on(x);\n};\nvar quick = x => go(x);\n")
    assert symbols == {("A", "class", 1, 3), ("A.on", "method", 2, 2), ("go", "function", 4, 6), ("quick", "function", 7, 7)}
    assert edges == {("A.on", "?", "calls", 2), ("go", "?", "calls", 5), ("quick", "go", "calls", 7)}


PY = '''import os, json as j
from .models import (
    A,
    B,
)

class Calc(Base):
    """def not_me(): class Nor_me"""

    @property
    def add(self, a=len("x")):
        return helper(a)

def helper(x):
    # helper(1)
    return Calc().add(x)
'''


def test_python():
    symbols, edges = rows("pkg/calc.py", PY)
    assert symbols == {
        ("pkg/calc.py", "module", 1, 1), ("os", "module", 1, 1), ("json", "module", 1, 1), ("models", "module", 2, 5),
        ("Calc", "class", 7, 12), ("Calc.add", "method", 11, 12), ("helper", "function", 14, 16),
    }
    assert ("pkg/calc.py", "Calc", "calls", 16) in edges and ("pkg/calc.py", "helper", "calls", 12) in edges
    assert {e for e in edges if e[2] == "imports"} == {("pkg/calc.py", "os", "imports", 1), ("pkg/calc.py", "json", "imports", 1), ("pkg/calc.py", "models", "imports", 2)}


CS = '''using System;

namespace Demo {
  public interface IShape { double Area(); }

  public class Ring : Shape, IShape {
    private readonly double r;
    public Ring(double r) : base(r) { this.r = r; }
    public double Area() { return Math.Pow(r, 2) * Scale(); }
    public double Twice() => Area() * 2;
  }
}
'''


def test_csharp():
    symbols, edges = rows("Ring.cs", CS)
    assert symbols == {
        ("Ring.cs", "module", 1, 1), ("System", "module", 1, 1), ("IShape", "interface", 4, 4), ("Ring", "class", 6, 11),
        ("Ring.Ring", "method", 8, 8), ("Ring.Area", "method", 9, 9), ("Ring.Twice", "method", 10, 10),
    }
    assert edges == {
        ("Ring.cs", "System", "imports", 1), ("Ring", "?", "extends", 6), ("Ring", "IShape", "implements", 6),
        ("Ring.Area", "?", "calls", 9), ("Ring.Twice", "?", "calls", 10),
    }


RS = '''use std::fmt::Display;
pub use crate::x;

pub trait Draw {
    fn draw(&self) -> String;
}

struct Dot<'a> { c: char, s: &'a str }

impl<'a> Draw for Dot<'a> {
    fn draw(&self) -> String {
        println!("{}", '{');
        helper(self.c)
    }
}

fn helper(c: char) -> String { c.to_string() }
'''


def test_rust():
    symbols, edges = rows("dot.rs", RS)
    assert symbols == {
        ("dot.rs", "module", 1, 1), ("std::fmt::Display", "module", 1, 1), ("pub use crate::x", "module", 2, 2), ("Draw", "interface", 4, 6),
        ("Dot", "type", 8, 8), ("Dot.draw", "method", 11, 14), ("helper", "function", 17, 17),
    }
    assert edges == {
        ("dot.rs", "std::fmt::Display", "imports", 1), ("dot.rs", "pub use crate::x", "imports", 2), ("Dot", "Draw", "implements", 10),
        ("Dot.draw", "helper", "calls", 13), ("helper", "?", "calls", 17),
    }


ZIG = '''const std = @import("std");
pub const Pair = struct {
    a: u32,
    pub fn sum(self: Pair) u32 {
        return add(self.a, @as(u32, 1));
    }
};
const Mode = enum { on, off };
fn add(a: u32, b: u32) u32 {
    return a + b;
}
'''


def test_zig():
    symbols, edges = rows("pair.zig", ZIG)
    assert symbols == {
        ("pair.zig", "module", 1, 1), ("std", "module", 1, 1), ("Pair", "type", 2, 7), ("Pair.sum", "method", 4, 6),
        ("Mode", "type", 8, 8), ("add", "function", 9, 11),
    }
    assert edges == {("pair.zig", "std", "imports", 1), ("Pair.sum", "add", "calls", 5)}


def test_ids_and_dispatch():
    assert symbol_id("./models", "./models", "module") == "bde7397911515b0be30ad0f3ae4adbbb"
    assert symbol_id("fmt", "fmt", "module") == "85069647a798185adbcd96a89f81352e"
    assert symbol_id("a//b", "x", "type") == symbol_id("a/b", "x", "type")
    assert extensions() == (".cjs", ".cs", ".go", ".js", ".jsx", ".mjs", ".py", ".rs", ".ts", ".tsx", ".zig")
    assert extract("readme.md", "func x() {}").symbols == []


@pytest.mark.parametrize("path", ["a.go", "a.ts", "a.js", "a.py", "a.cs", "a.rs", "a.zig"])
@pytest.mark.parametrize("src", ["", "}", "{{{", "func", "class", '"', "/*", "'''", "import", "fn (", "impl", "use", "def", "type (", "const x = (", "\n" * 50])
def test_broken_files_never_raise(path, src):
    extract(path, src)
    extract(path, src * 3 + "\nfunc a() {")


def test_files_of_few_bytes_are_scanned_by_many_tasks(spark, tmp_path):
    from codeweft.plans import sources, upkeep

    parts = spark.range(500).selectExpr("id as p_partkey", "'b' as p_brand").coalesce(1)
    parts.write.parquet(f"{tmp_path}/part.parquet")
    tasks = 4 * spark.sparkContext.defaultParallelism
    for df in (sources.symbols(spark, str(tmp_path), "typescript"), sources.edges(spark, str(tmp_path), "rust"), upkeep._paths(spark, str(tmp_path))):
        assert df.rdd.getNumPartitions() >= tasks


#: Files with a long word, by extension.
LONG = {
    ".cs": "class A { int %s = f(1); }",
    ".rs": "fn a() { let %s = f(1); }",
    ".zig": "fn a() void { const %s = f(1); }",
    ".js": "function a() { let %s = f(1); }",
}


@pytest.mark.parametrize("extension", LONG)
def test_long_words_take_time_by_their_length(extension):
    """Tried from each of its letters, a word of 20,000 took seconds to minutes."""
    began = time.monotonic()
    extract(f"a{extension}", LONG[extension] % ("x" * 20_000))
    assert time.monotonic() - began < 3


@pytest.mark.parametrize("query", ["extract_csharp_edges", "extract_rust_symbols", "extract_zig_edges", "extract_zig_symbols", "extract_javascript_symbols", "extract_javascript_edges"])
def test_scanned_parts_of_one_file_are_dealt_out(spark, tmp_path, query):
    from codeweft.plans import catalog

    spark.range(50).selectExpr("id as p_partkey", "'b' as p_brand").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    df = catalog.QUERIES[query](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert df.select("file").distinct().count() == 50


def test_csharp_members_as_before():
    src = "class A {\n  xpublic int F(int a) { G(); }\n  Task<List<int>, B[]>? Go<T>(T t) where T : new() => H();\n  static new A.B make () ;\n  1x(\n}\n"
    symbols, edges = rows("a.cs", src)
    assert symbols == {("A", "class", 1, 6), ("A.F", "method", 2, 2), ("A.Go", "method", 3, 3), ("A.make", "method", 4, 4)}
    assert edges == {("A.F", "?", "calls", 2), ("A.Go", "?", "calls", 3), ("A", "?", "calls", 5)}
