"""Parsers, trees and logs."""

import json

import pytest
from pyspark.sql import functions as F

from graphquarry.operators import reports
from graphquarry.sources import logs, tree
from graphquarry.sources.parsers import parse


def shape(language, source):
    r = parse(language, source)
    return [(s["name"], s["kind"], s["line_start"], s["line_end"], s["parent"]) for s in r.symbols], [(i["module"], i["names"]) for i in r.imports], [(c["caller"], c["callee"], c["line"]) for c in r.calls]


def test_python():
    src = "import os, sys\nfrom a.b import c as d, e\nfrom . import x\nfrom __future__ import annotations\n@deco(1)\ndef f(a, b=g()):\n    def inner():\n        return h(a.m())\n    return inner\nclass K(Base):\n    async def m(self) -> int:\n        if True:\n            return K().n()\nx = top()\n"
    symbols, imports, calls = shape("python", src)
    assert symbols == [("f", "function", 6, 9, None), ("inner", "method", 7, 8, 0), ("K", "class", 10, 13, None), ("m", "method", 11, 13, 2)]
    assert imports == [("os, sys", None), ("a.b", "c, e"), (".", "x")]
    assert calls == [(0, "g", 6), (0, "h", 8), (0, "m", 8), (1, "h", 8), (1, "m", 8), (3, "n", 13), (3, "K", 13)]
    assert parse("python", src).symbols[0]["signature"] == "def f(a, b=g())"
    broken, _, calls = shape("python", "class A:\n    def f(self, x):\n        return g(x)\n\ndef broken(:\n    h()\n")
    assert broken[:2] == [("A", "class", 1, 3, None), ("f", "method", 2, 3, 0)] and (1, "g", 3) in calls


def test_javascript():
    src = "import A, { b as c, d } from './m';\nimport './side';\nexport { x as y } from \"./z\";\nexport async function f(a) {\n  const t = new Thing();\n  function g() { return h(); }\n  return import('./lazy').then(k);\n}\nclass C extends D {\n  #p = 1;\n  static async m(x) { return this.n(x)(y); }\n}\nexport const arrow = async (a, b) => {\n  call(a);\n};\nlet v = 3;\nconst lazy = import('./top');\n"
    symbols, imports, calls = shape("javascript", src)
    assert symbols == [("f", "function", 4, 8, None), ("g", "function", 6, 6, 0), ("C", "class", 9, 12, None), ("m", "method", 11, 11, 2), ("arrow", "function", 13, 15, None)]
    assert sorted(imports) == sorted([("./m", "A, b, d"), ("./side", None), ("./z", "y"), ("./lazy", None), ("./top", None)])
    assert [(c[0], c[1]) for c in calls] == [(0, "h"), (0, "then"), (1, "h"), (3, "n"), (4, "call")]


def test_tsx():
    symbols, _, calls = shape("tsx", "interface P { a: string }\nexport function App(p: P): JSX.Element {\n  return <div><Header title={t(p.a)} /><Nav.Item>hi</Nav.Item></div>;\n}\n")
    assert symbols == [("App", "function", 2, 4, None)]
    assert [c[1] for c in calls] == ["Header", "t", "Item"]


def test_rust():
    src = 'use std::io::{self, Read};\npub struct S { a: u8 }\nenum E { A, B }\ntrait T {\n    fn decl(&self);\n    fn def(&self) -> u8 { helper(1) }\n}\nimpl S {\n    pub fn new() -> Self { S { a: make() } }\n}\nimpl T for Other { fn def(&self) -> u8 { 2 } }\nfn main() {\n    let s = S::new();\n    if let Some(x) = s.get() { println!("{}", x); }\n}\n'
    symbols, imports, calls = shape("rust", src)
    assert symbols == [("S", "struct", 2, 2, None), ("E", "enum", 3, 3, None), ("T", "trait", 4, 7, None), ("def", "method", 6, 6, 2), ("new", "method", 9, 9, 0), ("def", "function", 11, 11, None), ("main", "function", 12, 15, None)]
    assert imports == [("std::io::{self, Read}", None)]
    assert [(c[0], c[1]) for c in calls] == [(3, "helper"), (4, "make"), (6, "new"), (6, "get"), (6, "println")]


def test_go():
    src = 'package p\nimport (\n\t"fmt"\n\tx "net/http"\n)\nimport "os"\ntype S struct {\n\ta int\n}\ntype I interface{ M() }\ntype N int\nfunc (s *S) M(a int) (int, error) {\n\tfmt.Println(f(a))\n\treturn 1, nil\n}\nfunc f(a int) int { return a }\n'
    symbols, imports, calls = shape("go", src)
    assert symbols == [("S", "struct", 7, 9, None), ("I", "interface", 10, 10, None), ("N", "type", 11, 11, None), ("M", "method", 12, 15, 0), ("f", "function", 16, 16, None)]
    assert [i[0] for i in imports] == ["fmt", "net/http", "os"] and [c[1] for c in calls] == ["Println", "f"]
    assert parse("go", src).symbols[3]["signature"] == "func (s *S) M(a int) (int, error)"


def test_java():
    src = "package a;\nimport java.util.List;\nimport static x.Y.z;\n@Ann(1)\npublic class A<T> extends B {\n  private int f = init();\n  public A(int x) { this.f = x; }\n  @Override\n  public List<String> get(int i) throws E {\n    return new ArrayList<>(helper(i).map());\n  }\n  interface I { void m(); }\n}\nenum E { X, Y; int n() { return go(); } }\n"
    symbols, imports, calls = shape("java", src)
    assert symbols == [("A", "class", 4, 13, None), ("A", "constructor", 7, 7, 0), ("get", "method", 8, 11, 0), ("I", "interface", 12, 12, 0), ("m", "method", 12, 12, 3), ("E", "enum", 14, 14, None), ("n", "method", 14, 14, 5)]
    assert [i[0] for i in imports] == ["java.util.List", "x.Y.z"]
    assert [c[1] for c in calls] == ["ArrayList", "helper", "map", "go"] and parse("java", src).symbols[2]["signature"] == "List<String> get(int i)"


def test_c_and_cpp():
    src = '#include <stdio.h>\n#include "a.h"\n#define M(x) \\\n  foo(x)\nstruct P { int x; };\nstruct Q;\ntypedef struct { int a; } R;\ntypedef int (*Fn)(int);\nint proto(int);\nstatic char *f(int a, char *b) {\n  if (a) { return g(b->h(a)); }\n  return 0;\n}\n'
    symbols, imports, calls = shape("c", src)
    assert symbols == [("P", "struct", 5, 5, None), ("R", "type", 7, 7, None), ("Fn", "type", 8, 8, None), ("f", "function", 10, 13, None)]
    assert [i[0] for i in imports] == ["stdio.h", "a.h"] and [c[1] for c in calls] == ["g", "h"]
    cpp = "namespace n {\nclass A {\n public:\n  A(int x) : x_(x) {}\n  int get() const { return std::move(x_); }\n  void decl();\n};\ntemplate <typename T> T id(T t) { return t; }\nvoid A::decl() { other(); }\nint n::free() { return 1; }\nvoid Far::away() {}\n}\nenum class C { X };\n"
    symbols, _, calls = shape("cpp", cpp)
    assert [(s[0], s[1], s[4]) for s in symbols] == [("n", "namespace", None), ("A", "class", 0), ("A", "method", 1), ("get", "method", 1), ("id", "function", 0), ("decl", "method", 1), ("free", "function", 0), ("away", "method", 0), ("C", "enum", None)]
    assert [c[1] for c in calls] == ["move", "other"]


def test_csharp():
    src = "using System;\nusing Al = My.Target;\nnamespace N;\npublic class A : B\n{\n    public int P { get; set; } = 1;\n    public string Q => name;\n    public A(int x) { P = x; }\n    public List<int> M(int a)\n    {\n        var z = new Dictionary<int, B>();\n        return Do<int>(a).Next();\n    }\n}\npublic record R(int X);\n"
    symbols, imports, calls = shape("csharp", src)
    assert [(s[0], s[1], s[4]) for s in symbols] == [("N", "namespace", None), ("A", "class", 0), ("P", "property", 1), ("Q", "property", 1), ("A", "constructor", 1), ("M", "method", 1), ("R", "record", 0)]
    assert [i[0] for i in imports] == ["System", "My.Target"] and [c[1] for c in calls] == ["Dictionary", "Do", "Next"]


@pytest.mark.parametrize("language", ["python", "javascript", "typescript", "tsx", "rust", "go", "java", "c", "cpp", "csharp", None])
def test_parsers_survive_anything(language):
    import random

    rng = random.Random(str(language))
    bits = ["{", "}", "(", ")", "[", "]", "<", ">", ";", ",", "=", "=>", "class ", "fn ", "func ", "def ", "import ", "'", '"', "\n", "x", "impl ", "struct ", "enum ", "#", "//", "/*", ":", "::", "new ", "operator", "typedef ", "namespace ", "const ", "export ", "*", "type ", "use ", "template", "~", "record "]
    for _ in range(300):
        parse(language, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30))))


def test_tree(spark, tmp_path):
    for path, data in {"src/a.py": b"def f():\n    g()\n", "src/bad.py": b"\xff\xfe\x00", "node_modules/x.js": b"1", "img.png": b"1", "skip/me.py": b"1", "out.log": b"1", ".hidden.py": b"1", "other/repo.py": b"1", "a b%20+c.py": b"x"}.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    (tmp_path / ".gitignore").write_text("# no\nskip/\n*.log\n!keep.log\n")
    got = tree.described(tree.read_tree(spark, str(tmp_path), exclude=["other"])).collect()
    assert sorted(r.path for r in got) == [".gitignore", ".hidden.py", "a b%20+c.py", "src/a.py"]
    a = next(r for r in got if r.path == "src/a.py")
    assert (a.language, a.size, a.line_count, a.is_test) == ("python", 17, 2, False) and a.mtime > 1e9


def test_ignore_rules(spark):
    paths = ["a/b.log", "keep.log", "build/x", "src/build/x", "docs/a/b.md", "x.tmp"]
    d = spark.createDataFrame([(p,) for p in paths], "p string").select("p", tree.ignored_by(F.col("p"), ["*.log", "!keep.log", "/build/", "docs/**/b.md", "*.t?p", ""]).alias("i"))
    assert {r.p for r in d.collect() if r.i} == {"a/b.log", "build/x", "docs/a/b.md", "x.tmp"}


def test_child_repositories(spark, tmp_path):
    for d in ("b/.git", "a/.git", "c"):
        (tmp_path / d).mkdir(parents=True)
    assert [r.name for r in tree.child_repositories(spark, str(tmp_path)).collect()] == ["a", "b"]


def _log(tmp_path, name, *events):
    (tmp_path / name).write_text("\n".join(e if isinstance(e, str) else json.dumps(e) for e in events) + "\n")


def test_log_form_a(spark, tmp_path):
    use = lambda n, **i: {"type": "tool_use", "name": n, "input": i}
    msg = lambda u, *c: {"type": "assistant", "message": {"usage": u, "content": list(c)}}
    u = {"input_tokens": 5, "output_tokens": 2, "cache_read_input_tokens": 10}
    _log(tmp_path, "t_with.jsonl", msg(u, use("Read", file_path="/w/a.py"), {"type": "text", "text": "x"}), "not json", msg(u, use("Bash", command="cat b.py | wc"), use("Grep", pattern="x")), {"type": "user"}, {"type": "result", "total_cost_usd": 1.0, "num_turns": 1, "usage": u}, {"type": "result", "total_cost_usd": 2.5, "num_turns": 3, "usage": u, "result": "done"})
    lines = logs.read_lines(spark, str(tmp_path))
    calls = logs.tool_calls(lines).orderBy("line_no", "pos").collect()
    assert [(c.tool, c.file_path, c.is_navigation) for c in calls] == [("Read", "/w/a.py", False), ("Bash", "b.py", True), ("Grep", None, True)]
    assert [(r.turn, r.input_tokens, r.cache_read, r.cache_creation) for r in logs.usages(lines).orderBy("turn").collect()] == [(1, 5, 10, 0), (2, 5, 10, 0)]
    r = logs.run_results(lines).first()
    assert (r.cost_usd, r.turns, r.input_tokens, r.output_tokens, r.preview) == (2.5, 3, 15, 2, "done")


def test_log_form_b_and_results(spark, tmp_path):
    _log(tmp_path, "b.jsonl", {"type": "assistant.message", "data": {"toolRequests": [{"name": "x"}]}}, {"type": "tool.execution_complete", "data": {"toolName": "x", "success": False}}, {"type": "tool.execution_complete", "data": {"success": True}}, {"type": "result", "usage": {"sessionDurationMs": 1500, "premiumRequests": 2}})
    r = logs.run_counts_b(logs.read_lines(spark, str(tmp_path))).first()
    assert (r.messages, r.tool_calls, r.failed, r.seconds, r.premium_requests) == (1, 2, 1, 1.5, 2.0)
    docs = [{"rounds": [[{"category": "a"}, {"category": "b"}]]}, {"rounds": [{"round": 1, "tasks": [{"category": "c"}]}, {"results": [{"category": "d"}]}]}]
    t = logs.tasks(spark.createDataFrame([(json.dumps(x),) for x in docs], "doc string"))
    assert sorted((x.round, x.c) for x in t.select("round", F.expr("variant_get(task, '$.category', 'string')").alias("c")).collect()) == [(1, "a"), (1, "b"), (1, "c"), (2, "d")]


def test_runs_of_results_documents(spark):
    run = {"cost_usd": 1.5, "input_tokens": 7, "tools": [{"name": "Read", "input_preview": "{'file_path': 'a.py'}"}, {"name": "Grep"}], "per_message_usage": [{"input_tokens": 5}, {"turn": 9, "cache_read": 2}]}
    docs = [{"rounds": [[{"category": "a", "without": run}], []]}, {"rounds": [{"round": 7, "tasks": [{"repo": "r", "without": run, "with_it": {"cost_usd": "x"}}]}, {"results": [{"with_it": run, "without": 3}]}]}, {"rounds": 5}, [1]]
    d = spark.createDataFrame([(i, x) for i, x in enumerate([*map(json.dumps, docs), "no json", None])], "id int, doc string")
    r = logs.task_runs(d, sides={"without": "without", "with": "with_it"})
    assert sorted((x.id, x.run, x.nth, x.cost_usd, x.input_tokens) for x in r.filter("cost_usd is not null").collect()) == [(0, "R1/a_without", 0, 1.5, 7), (1, "R2/unknown_with", 0, 1.5, 7), (1, "R7/r_without", 0, 1.5, 7)]
    assert [(x.run, x.tools) for x in r.filter("cost_usd is null").collect()] in ([("R7/r_with", None)], [])
    one = r.filter("id = 0")
    assert [tuple(x) for x in logs.task_tool_calls(one, "run").collect()] == [("R1/a_without", 0, "Read", "a.py", False), ("R1/a_without", 1, "Grep", None, True)]
    assert [tuple(x) for x in logs.task_usages(one, "run").collect()] == [("R1/a_without", 1, 5, 0, 0, 0), ("R1/a_without", 9, 0, 0, 2, 0)]


def test_totals_of_runs_stay_with_their_rows(spark):
    tool = lambda name, p=None: {"name": name, "input_preview": p and f"{{'file_path': '{p}', ..."}
    some = [{"tools": [tool("Read", "a.py"), tool("Read", "a.py"), tool("Edit", "/w/cut"), tool("Grep", "b.py"), tool(None), None], "per_message_usage": [{"input_tokens": 5}, {"turn": 2}, {"input_tokens": 3}]}, {"tools": []}, {"cost_usd": 1}]
    d = spark.createDataFrame([(1, json.dumps({"rounds": [[{"category": f"c{i}", "without": x} for i, x in enumerate(some)]]}))], "id int, doc string")
    runs = logs.task_runs(d)
    got = logs.run_totals(runs, "category")
    assert sorted(map(tuple, got.collect())) == [("c0", 6, 1, 3, 2, 8), ("c1", 0, 0, 0, 0, 0), ("c2", 0, 0, 0, 0, 0)]
    told = reports.task_report(runs.select("category"), logs.task_tool_calls(runs, "category"), "category")
    assert sorted(map(tuple, got.drop("used_tokens").collect())) == sorted(map(tuple, told.collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_log_helpers(spark):
    d = spark.createDataFrame([("x_turn2.jsonl", "/h/ab-workspace/with/src/a.py", "{'file_path': '/a/b.py', ..."), ("x_turn0.jsonl", "/other/a.py", "{'file_path': '/a/long")], "run string, p string, v string")
    got = d.select(logs.is_followup(F.col("run")), logs.workspace_prefix(F.col("p")), logs.preview_path(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(True, "/h/ab-workspace/with/", "/a/b.py"), (False, None, None)]
