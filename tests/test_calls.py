import random

from tracewell.operators.calls import call_edges, calling_files, resolve_imports
from tracewell.operators.graph import closure
from tracewell.operators.parsers import code_rows


def test_closure_against_search(spark):
    rng = random.Random(9)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(60)} | {(100 + i, 101 + i) for i in range(30)} | {(7, 7)}
    df = spark.createDataFrame([(*e, 1) for e in [*edges, (1, None)]], "src int, dst int, dist int")
    for depth in (1, 3, 8, 25):
        want = {}
        for s in {a for a, _ in edges}:
            front, seen, d = {s}, {}, 0
            while front and d < depth:
                d += 1
                front = {b for a, b in edges if a in front} - set(seen)
                seen |= dict.fromkeys(front, d)
            want |= {(s, b): d for b, d in seen.items()}
        assert {(r.src, r.dst): r.dist for r in closure(df, depth).collect()} == want
    assert closure(df.limit(0), 5).collect() == []


def test_calls_are_linked_to_declarations(spark):
    rng = random.Random(1)
    files, names = [f"f{i}" for i in range(12)], [f"g{i}" for i in range(6)]
    functions = {(rng.choice(files), rng.choice(names)) for _ in range(40)}
    imports = {(rng.choice(files), rng.choice(files)) for _ in range(25)}
    calls = {(rng.choice(files), rng.choice(names), rng.choice(names)) for _ in range(150)}
    want = {(f, a, d, b) for f, a, b in calls if (f, a) in functions for d in files if (d == f or (f, d) in imports) and (d, b) in functions}
    frame = lambda rows, s: spark.createDataFrame([*rows, *list(rows)[:5]], s)
    edges = call_edges(frame(calls, "file string, caller string, callee string"), frame(functions, "file string, name string"), frame(imports, "src string, dst string"))
    got = [tuple(r) for r in edges.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    up = {((d, b), (f, a)) for f, a, d, b in want}
    reach, step = set(up), set(up)
    for _ in range(2):
        step = {(x, z) for x, y in step for y2, z in up if y == y2}
        reach |= step
    assert {tuple(r) for r in calling_files(edges).collect()} == {(x[0], y[0]) for x, y in reach}


def test_calls_of_each_language():
    said = {
        "python": "def a():\n    b()\n    c.d()\ne()\n", "typescript": "export function a(x) { b(x); return c.d(1) }\ne()\n", "javascript": "const a = (x) => { b(x); c.d(1) }\ne()\n",
        "go": "package p\nfunc a(x int) int {\n\tb(x)\n\treturn c.d(1)\n}\nvar y = e()\n", "java": "class K { int a(int x) { b(x); return c.d(1); } int y = e(); }", "c": "int a(int x) { b(x); return d(1); }\nint y;\n",
    }
    for language, text in said.items():
        calls = {(w, n) for k, n, w in code_rows(language, text) if k == "call"}
        assert calls == {("a", "b"), ("a", "d")}, language


def test_imports_are_resolved(spark):
    files = ["src/a.ts", "src/lib/b.ts", "src/lib/b.js", "src/lib/c/index.tsx", "pkg/core/rbac.py", "pkg/reasoning/__init__.py", "os.py", "src/d.css", "x/y.js", "src/lib.ts"]
    cases = {
        ("src/a.ts", "./lib/b"): "src/lib/b.ts", ("src/a.ts", "./lib/b.js"): "src/lib/b.js", ("src/lib/b.ts", "../a"): "src/a.ts", ("src/lib/b.ts", "./c"): "src/lib/c/index.tsx",
        ("src/a.ts", "@/lib/c"): "src/lib/c/index.tsx", ("src/a.ts", "@/lib"): "src/lib.ts", ("src/a.ts", "~x/y"): "x/y.js", ("src/a.ts", "/src/a"): "src/a.ts", ("src/a.ts", " ./d.css "): "src/d.css",
        ("m.py", "pkg.core.rbac"): "pkg/core/rbac.py", ("m.py", "pkg.reasoning"): "pkg/reasoning/__init__.py", ("m.py", "os"): None, ("src/a.ts", "react"): None, ("src/a.ts", "./gone"): None,
        ("src/a.ts", "../../a"): None, ("src/a.ts", ""): None, ("src/a.ts", None): None, ("src/a.ts", "./lib/b.go"): None,
    }
    asked = spark.createDataFrame([("r", p, s, "z") for p, s in cases] * 2 + [(None, "src/a.ts", "./lib/b", "z"), ("q", "src/a.ts", "./lib/b", "z")], "repo string, path string, specifier string, target string")
    held = spark.createDataFrame([("r", f, 1) for f in files], "repo string, path string, specifier int")
    alias = spark.createDataFrame([("r", {"@/": "src/", "~x": "x/"}), ("q", None)], "repo string, alias_map map<string,string>")
    got = resolve_imports(asked, held, alias).collect()
    assert {(r.path, r.specifier): r.target for r in got} == {k: v for k, v in cases.items() if v}
    assert len(got) == sum(v is not None for v in cases.values())
