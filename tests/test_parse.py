"""Entities of sources, sound and broken, against rows made by hand."""

import pytest

from graphloom.sources import parse, scan, tokens


def found(language, source):
    rows = parse.parse(language, source)
    functions = [(r[2], r[3], r[4], r[8]) for r in rows if r[0] == "function"]
    classes = [(r[2], r[3], r[4], r[9]) for r in rows if r[0] == "class"]
    return functions, classes, [r[2] for r in rows if r[0] == "import"], [(r[8], r[2], r[3]) for r in rows if r[0] == "call"]


JAVA = '''package a;
import java.util.*;
import static a.b.C.m;
import x.Y;
/** Doc. */
@Anno(value = "x{")
public abstract class A<T extends B> extends C<D> implements E<F> {
  private Map<String, List<T>> m = new HashMap<>() {{ put("a", f(1)); }};
  A() { super(); init(); }
  /* two */
  @Override
  public <R> Map<String, R> f(int x, List<? extends T> y) throws Exception {
    Runnable r = new Runnable() { public void run() { g(x); } };
    for (int i = 0; i < 3; i++) { this.g(i); }
    String s = """
      class No { void no() {} }
    """;
    char c = '{';
    return y.stream().map(z -> { return h(z); }).collect();
  }
  abstract int g(int x);
  record P(int a, int b) { P { check(a); } int sum() { return add(a, b); } }
  enum Q { ONE { int v() { return one(); } }, TWO(2) { int w() { return 2; } }; abstract int u(); Q() {} }
  interface I { void i(); default void j() { i(); } }
  static { boot(); }
}
class Z extends A.B {}
'''


def test_java():
    functions, classes, imports, calls = found("java", JAVA)
    assert classes == [("A", 5 + 1, 26, ["C<D>"]), ("Z", 27, 27, ["A.B"])]
    assert functions == [("f", 11, 20, "A"), ("run", 13, 13, "A"), ("g", 21, 21, "A"), ("sum", 22, 22, "A"), ("v", 23, 23, "A"), ("w", 23, 23, "A"), ("u", 23, 23, "A"), ("i", 24, 24, "A"), ("j", 24, 24, "A")]
    assert imports == ["java.util", "a.b.C.m", "x.Y"]
    assert calls == [("run", "g", 13), ("f", "g", 14), ("f", "stream", 19), ("f", "map", 19), ("f", "h", 19), ("f", "collect", 19), ("sum", "check", 22), ("sum", "add", 22), ("v", "one", 23), ("i", "i", 24)]
    rows = {r[2]: r for r in parse.parse("java", JAVA) if r[0] in ("function", "class")}
    assert rows["A"][6] == "Doc." and rows["f"][6] == "two" and rows["g"][5] == "abstract int g(int x);"


JAVASCRIPT = """import q from "lib";
import "side";
// doc
function f(a = g(), {b, c} = {}) { return /[{}"]+/.test(a) ? `x${h(`y${k()}`)}{` : a / b / c; }
async function g() { await f(); }
function* gen() { f(); }
const arrow = async (x) => { inner(x); };
export default class K extends B.C {
  #p = 1; field = () => { f(); };
  static async m(x) { this.n(); new Foo(x); super.n(); }
  get v() { return 1 }
  *it() { f() }
  ["x" + y]() { f() }
  constructor() { super(); }
}
class L extends K { go() { if (a) { f(); } } }
const o = { a: 1, meth(x) { return f(x); }, b: function() { g() }, c: { deep() { g(); } }, get() { g(); } };
const E = class Named { q() { f(); } };
export function h(x) { switch (x) { case 1: { f(); break; } default: g(); } }
"""


def test_javascript():
    functions, classes, imports, calls = found("javascript", JAVASCRIPT)
    assert classes == [("K", 8, 15, []), ("L", 16, 16, ["K"])]
    assert functions == [
        ("f", 4, 4, None), ("g", 5, 5, None), ("m", 10, 10, "K"), ("v", 11, 11, "K"), ("it", 12, 12, "K"), ("constructor", 14, 14, "K"), ("go", 16, 16, "L"),
        ("meth", 17, 17, None), ("deep", 17, 17, None), ("get", 17, 17, None), ("q", 18, 18, None), ("h", 19, 19, None),
    ]
    assert imports == ["lib", "side"]
    assert calls[:5] == [("f", "g", 4), ("f", "test", 4), ("f", "h", 4), ("f", "k", 4), ("g", "f", 5)]
    assert ("h", "f", 19) in calls and not {c for c in calls if c[1] in ("Foo", "super", "switch", "inner")}
    assert next(r for r in parse.parse("javascript", JAVASCRIPT) if r[2] == "f")[6] == "doc"


TYPESCRIPT = """import { q } from "./lib";
interface I { foo(x: number): void; bar: { a: string } }
type T = { m(): void };
enum Color { Red }
export abstract class A<T> extends B<T> implements I {
  private x: number = f();
  constructor(private y: string) { super(); }
  @dec({ a: 1 })
  public async m(a: { b: number }, c?: () => void): Promise<{ d: string }> { await g<string>(a); }
  abstract n(): void;
  static s = { t() { g(); } };
}
class C extends D {}
function over(a: string): void;
function over(a: any): { x: number } | null { return h(a as any); }
namespace N { export function inN() { over(1); } }
declare function ext(): void;
"""


def test_typescript():
    functions, classes, imports, calls = found("typescript", TYPESCRIPT)
    assert classes == [("C", 13, 13, [])]
    assert functions == [("constructor", 7, 7, None), ("m", 9, 9, None), ("t", 11, 11, None), ("over", 15, 15, None), ("inN", 16, 16, None)]
    assert imports == ["./lib"] and calls == [("m", "g", 9), ("t", "g", 11), ("over", "h", 15), ("inN", "over", 16)]


GO = """package m
import "fmt"
import (
  a "x/y"
  "z"
)
type S struct { A int; F func(int) string }
type (
  T1 int
  T2 interface { M(x int) }
)
type Al = S
// Doc of A.
func A[K comparable, V any](m map[K]V, f func(int) (int, error)) (x struct{ a int }, err error) {
  B(); fmt.Println(f(1)); go C(); _ = []byte("x"); type local struct{}
  h := func(y int) { D(y) }
  s := `func no() {`
}
func (r *S) Meth() { A() }
func B() {}
"""


def test_go():
    functions, classes, imports, calls = found("go", GO)
    assert classes == [("S", 7, 7, []), ("T1", 8, 11, []), ("T2", 8, 11, []), ("local", 15, 15, [])]
    assert functions == [("A", 14, 18, None), ("B", 20, 20, None)]
    assert imports == ["fmt", "x/y", "z"]
    assert calls == [("A", "B", 15), ("A", "Println", 15), ("A", "f", 15), ("A", "C", 15), ("A", "D", 16)]
    assert next(r for r in parse.parse("go", GO) if r[2] == "A" and r[0] == "function")[6] == "Doc of A."


def test_python_bases_are_plain_names_and_relative_imports_are_none():
    functions, classes, imports, _ = found("python", "from .rel import x\nfrom a.b import c\nclass A(B, m.C, metaclass=M): pass\n@deco\nasync def f(): pass\n")
    assert classes == [("A", 3, 3, ["B"])] and imports == ["a.b"] and functions == [("f", 5, 5, None)]


BROKEN_PYTHON = '''import os, sys as s
from .rel import x
from a.b import c
print "x"
class A(B, m.C, metaclass=M):
    """Doc
    two."""
    def f(self, x=(1, 2)) -> int:
        """One."""
        return g(x
    async def h(self):
        k()
        def inner(): return z()
    x = [1, 2

def broken(
def last(): pass
@deco(1)
def tail(a,
         b):
    return "unterminated
def end():
    y = f"{q()}"
'''


def test_python_with_errors_keeps_its_other_entities():
    functions, classes, imports, calls = found("python", BROKEN_PYTHON)
    assert classes == [("A", 5, 14, ["B"])]
    assert functions == [("f", 8, 10, "A"), ("h", 11, 13, "A"), ("inner", 13, 13, "A"), ("last", 17, 17, None), ("tail", 19, 21, None), ("end", 22, 23, None)]
    assert imports == ["os", "sys", "a.b"] and calls == [("f", "g", 10), ("h", "k", 12), ("inner", "z", 13)]
    assert parse.broken_line("python", BROKEN_PYTHON) and parse.broken_line("python", "x = 1") is None


@pytest.mark.parametrize(
    ("language", "source", "functions"),
    [
        ("javascript", "function a() {\n  if (x) { f();\n}\n\nfunction b() { g(); }\nclass K { m() { h( ; }\n  n() { i(); } }\n", [("a", 1, 3), ("b", 5, 5), ("m", 6, 6), ("n", 7, 7)]),
        ("java", "class A {\n  int f() { return g(; }\n  int k() { return f(); }\n\n  int m() { if (x) { f();\n  }\n  int n() { return 1; }\n}\n", [("f", 2, 2), ("k", 3, 3), ("m", 5, 6), ("n", 7, 7)]),
        ("go", "package m\nfunc A() {\n  if x {\n    B(\n}\n\nfunc B() { C() }\n", [("A", 2, 5), ("B", 7, 7)]),
        ("typescript", "function a(x: string) { return `${f(x}`; }\nfunction b(): void { g() }\n", [("a", 1, 1), ("b", 2, 2)]),
    ],
)
def test_brackets_that_do_not_pair_cost_their_block_only(language, source, functions):
    assert [f[:3] for f in found(language, source)[0]] == functions
    assert parse.broken_line(language, source) is not None


def test_nothing_is_too_odd_to_read():
    for language in parse.LANGUAGES:
        for text in ("", "}", "{" * 3000, ")" * 50, "class", "class {", "func (", "type (", "import", "def", "`${", "/", "'", '"""', "/*", "@", "@a.b.(", "new A() {", "enum A { B", "\x00\\", "x" * 10000, "class A extends", "function* ", "async", "é = ñ(1)\n"):
            parse.parse(language, text)
    assert tokens.braced("a(b[c{d)e", "java").pair


def test_table_function_in_sql_and_errors_reported(spark):
    scan.register(spark)
    spark.createDataFrame([("python", "def f():\n    g()\n\ndef h(:\n"), ("ruby", "x"), (None, None)], "language string, content string").createOrReplaceTempView("some_sources")
    rows = spark.sql("select p.kind, p.name, p.broken from some_sources, lateral parse_source(language, content) p order by all").collect()
    assert [tuple(r) for r in rows] == [("call", "g", 4), ("function", "f", 4)]
    sources = scan.payload(spark, [("a.py", "def f(): pass\n"), ("b.rb", "x"), ("c.py", None)])
    assert [(r["path"], r["name"], r["broken"]) for r in scan.entities(sources).collect()] == [("a.py", "f", None)]
