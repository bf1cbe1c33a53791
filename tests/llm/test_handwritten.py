import random

import numpy as np

from tracewell.llm import handwritten
from tracewell.session import Scratch

SCHEMA = "file_id long, repo string, path string, content string, ingested_at long, kind string, size long"
CODE = "export function load{i}(rows, options) {{\n  const seen = new Set();\n  for (const row of rows) {{\n    if (seen.has(row.key)) return false;\n    seen.add(row.key);\n  }}\n  return seen.size > options.limit ? rows : null;\n}}\n"


def test_marks():
    m = handwritten.comment_marks
    for line in ("// Code generated by tool v1. DO NOT EDIT.", "# AUTO-GENERATED FILE. Do not modify by hand.", "/* @generated from x.schema */", "// <auto-generated> tool 3 </auto-generated>", "// autogenerated by x on build 1", "// This file was automatically generated; changes will be lost.", "/*\n * Generated by the compiler from a.idl, do not edit!\n */"):
        assert m(line + "\nx = 1") == {"generated"}, line
    for line in ("/*!\n * a v1\n * Released under the MIT License.\n */", "# Imported from the a-core project, release 2 (zlib license).", "// a-tools 0.1, BSD-3-Clause. Vendored copy of upstream tag 1.", "/**\n * @license A.js 1.2.3\n */"):
        assert m(line + "\nx = 1") == {"vendored"}, line
    for line in ("// Edit this file when the feed changes; the plan is generated from it.", "// the value is generated by the database, do not edit rows by hand", 'BANNER = "Code generated. DO NOT EDIT."', "// writes the banner that says: DO NOT EDIT, which only the output carries", "// Copyright (c) the delta team. Internal use only.", "# TODO stop shipping minified code"):
        assert m(line + "\nx = 1") == set(), line


def test_layout_and_paths():
    assert handwritten.is_minified("!function(e){" + "if(e>1){f(e)}else{g.push(e)}" * 30 + "}(a)")
    assert not handwritten.is_minified("// " + "a long comment " * 60 + "\n" + CODE.format(i=1))
    assert not handwritten.is_minified('QUERY = "' + "select a from b where " * 60 + '"\n' + CODE.format(i=1) * 2)
    for p in ("src/m/__generated__/a.ts", "src/a.generated.ts", "a/b.pb.go", "a/b_pb2.py"):
        assert handwritten.GENERATED_PATH.search(p), p
    for p in ("third_party/a-kit/b.ts", "vendor/example.test/a/b.go", "src/lib/a-kit-2.4.1-x1.js", "a/node_modules/b/c.js"):
        assert handwritten.VENDORED_PATH.search(p), p
    for p in ("src/modules/vendor/a.ts", "src/vendor/a.ts", "scripts/codegen/templates/a.ts", "src/generated-reports.ts", "src/lib/party.ts"):
        assert not handwritten.VENDORED_PATH.search(p) and not handwritten.GENERATED_PATH.search(p), p


def test_operator(spark):
    blob = "export default [\n" + "  1,2,3,4,5,6,7,8,\n" * 30 + "];\n"
    header = "/*!\n * kit v1\n * Released under the MIT License.\n */\n"
    rows = [
        (1, "a", "src/x.ts", CODE.format(i=1)), (2, "b", "src/y.ts", CODE.format(i=2)),
        (3, "a", "dist/x.ts", CODE.format(i=3)), (4, "b", "dist/x.ts", CODE.format(i=4)), (5, "a", "src/redist/x.ts", CODE.format(i=5)),
        (6, "a", "src/data/t.ts", blob), (7, "b", "src/data/u.ts", blob), (8, "a", "src/b.py", 'DATA = "' + "Ab3+" * 300 + '"\n'),
        (9, "a", "src/k.ts", header + CODE.format(i=9) * 2), (10, "c", "src/plain.ts", CODE.format(i=9) * 2),
        (11, "a", "src/e.ts", ""), (12, "a", "src/n.ts", None), (13, "a", None, "x"), (14, "a", "readme.md", blob), (15, None, "src/z.ts", CODE.format(i=6)),
        (16, "a", "x.log/z.ts", "let a = 1\n"), (17, "zz", "dist/z.ts", "let a = 1\n"), (None, "a", "src/x.ts", "x"),
        (18, "a", "src/gen.ts", "// @generated\nlet a = 1\n"),
    ]
    files = [(*r, 1, "k", 0) for r in rows] + [(1, "a", "src/x.ts", CODE.format(i=1), 0, "k", 0), (18, "a", "src/gen.ts", "let a = 1\n", 0, "k", 0)]
    specs = spark.createDataFrame([("a", ["dist", "*.log", None, ""], 1), ("b", ["build"], 2), ("c", None, 3)], "name string, ignore array<string>, repo int")
    got = {r.file_id: r for r in handwritten.judged_files(spark.createDataFrame(files, SCHEMA), specs).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 15, 16, 17, 18}
    assert {k: list(r.reasons) for k, r in got.items() if r.reasons} == {3: ["ignored"], 6: ["data"], 7: ["data"], 8: ["data"], 9: ["vendored"], 10: ["vendored"], 18: ["generated"]}
    assert got[6].kind == "literal" and got[1].kind == "across" and got[1].n_files >= 5
    assert handwritten.judged_files(spark.createDataFrame([], SCHEMA), specs).collect() == []


def test_classes_against_brute_force(spark):
    rng = random.Random(4)
    base = [[rng.randrange(10**6) for _ in range(120)] for _ in range(6)]
    sets = []
    for i in range(90):
        s = list(base[i % 6])
        for _ in range(rng.choice([0, 2, 5])):
            s[rng.randrange(120)] = rng.randrange(10**6)
        sets.append(np.unique(np.array(s, dtype=np.uint32)))
    rows = [(i, s.view(np.int32).tolist(), handwritten.bands_of(s)) for i, s in enumerate(sets)]
    df = handwritten.shape_classes(spark.createDataFrame(rows, "shape long, shingles array<int>, bands array<long>"), Scratch(spark))
    got = {r.shape: r["class"] for r in df.collect()}
    parent = list(range(90))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(90):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if len(a & b) >= 0.8 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {i: find(i) for i in range(90)}


def test_classes_decide(spark):
    header = "/*!\n * kit v1\n * Released under the MIT License.\n */\n"
    lines = [f"export const read{k} = (row) => row.part{k} + limit{k};\n" for k in range(40)]
    copy = [*lines[:20], "export const readOther = (row) => row.other + limitOther;\n", *lines[21:]]
    own = [f"export const load{k} = (item) => item.side{k} + bound{k};\n" for k in range(40)]
    blob, short = "[\n" + "  1,2,3,4,5,6,7,8,\n" * 30 + "]\n", "[\n  1,2,3,4,5,6,7,8,\n]\n"
    texts = {1: header + "".join(lines), 2: "".join(copy), 3: "".join(own), 4: blob, 5: short, 6: "let a = 1\n"}
    files = [(k, "a", f"src/x{k}.ts", t, 1, "k", 0) for k, t in texts.items()]
    specs = spark.createDataFrame([("a", [])], "name string, ignore array<string>")
    got = {r.file_id: r for r in handwritten.judged_files(spark.createDataFrame(files, SCHEMA), specs).collect()}
    assert got[1]["class"] == got[2]["class"] == got[3]["class"]
    assert {k: list(r.reasons) for k, r in got.items() if r.reasons} == {1: ["vendored"], 2: ["vendored"], 4: ["data"], 5: ["data"]}


def test_links_between_members_of_leaders(spark, monkeypatch):
    monkeypatch.setattr(handwritten, "CELL", 3, raising=False)
    window = lambda i: list(range(i, i + 100))
    # in order of shape: the leaders 10 and 20 with the members 30 and 40, of which only the members are similar
    starts = {10: 0, 20: 25, 30: 8, 40: 17, 50: 1_000, 60: 1_009, 70: 5_000}
    rows = [(k, window(i), [7]) for k, i in starts.items()]
    df = handwritten.shape_classes(spark.createDataFrame(rows, "shape long, shingles array<int>, bands array<long>"), Scratch(spark))
    assert {r.shape: r["class"] for r in df.collect()} == {10: 10, 20: 10, 30: 10, 40: 10, 50: 50, 60: 50, 70: 70}


def test_marks_after_the_head():
    m = handwritten.comment_marks
    licence = "/*\n" + " * Terms of the house.\n" * 30 + " */\n"
    assert m(licence + "// Code generated by tool v1. DO NOT EDIT.\nx = 1\n") == {"generated"}
    assert m("let a = 1\n" * 200 + "/*!\n * a v1\n * Released under the MIT License.\n */\nlet b = 1\n") == {"vendored"}
    assert m(licence + "const HEADER = `\n// Code generated by tool v1. DO NOT EDIT.\n`\n") == set()


def test_buckets_of_one_class_are_not_compared_pair_by_pair(spark, monkeypatch):
    given, links = [], handwritten._links
    monkeypatch.setattr(handwritten, "CELL", 10)
    monkeypatch.setattr(handwritten, "_links", lambda rows: given.append(rows.count()) or links(rows))
    # 100 shapes that are similar to the first of their bucket, and another class in another bucket with two of them
    rows = [(i, [*range(100), 1_000 + i], [7, i // 2]) for i in range(100)] + [(200 + i, [*range(5_000, 5_100), i], [8, 0]) for i in range(5)]
    df = handwritten.shape_classes(spark.createDataFrame(rows, "shape long, shingles array<int>, bands array<long>"), Scratch(spark))
    assert {r.shape: r["class"] for r in df.collect()} == {i: 0 for i in range(100)} | {200 + i: 200 for i in range(5)}
    assert sum(given) <= 2 + 5


def test_components_in_rounds_and_at_once(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 30)] + [(50, 40), (60, 50), (70, 71)], "a long, b long")
    want = {i: 0 for i in range(31)} | {40: 40, 50: 40, 60: 40, 70: 70, 71: 70}
    for few in (0, 100):
        monkeypatch.setattr(handwritten, "FEW_LINKS", few, raising=False)
        assert {r.node: r["class"] for r in handwritten.components(edges, Scratch(spark), "x").collect()} == want


def test_similar_bodies_meet_in_a_bin():
    rng = np.random.default_rng(3)
    for n in [*range(1, 40), 60, 97, 150, 260, 400, 900]:
        for _ in range(60):
            a = rng.choice(2**32, n, replace=False).astype(np.uint64)
            b = a.copy()
            # as many shingles of it are replaced, left out or added as 0.8 allows
            k, kind = (n // 9, n // 5, n // 4)[(i := rng.integers(3))], i
            b = np.concatenate([b[k:], rng.choice(2**32, k).astype(np.uint64)]) if kind == 0 else b[k:] if kind == 1 else np.concatenate([b, rng.choice(2**32, k).astype(np.uint64)])
            sizes = np.array([len(a), len(b)])
            of, own = np.repeat(np.arange(2, dtype=np.uint64), sizes), np.concatenate([a, b])
            common = len(set(a.tolist()) & set(b.tolist()))
            assert common >= 0.8 * (sizes.sum() - common)
            f, h = handwritten.own_bins(of, own, handwritten.level_of(sizes))
            least, most, m = handwritten.level_of(-(-sizes * 4 // 5)), handwritten.level_of(sizes * 5 // 4), sizes[1]
            wide = [handwritten.own_bins(of, own, np.array([-1, x])) for x in range(least[1], most[1] + 1)]
            assert set(h[f == 0].tolist()) & {x for w in wide for x in w[1].tolist()}, (n, m)
            odd = handwritten.parities(of, own, 2)
            assert 9 * int(np.bitwise_count((odd[0] ^ odd[1]).view(np.uint64)).sum()) <= sizes.sum()


def test_texts_that_come_again_are_given_once(spark):
    text = CODE.format(i=1) + CODE.format(i=2)
    rows = [(k, "a", f"src/{k}.ts", text if k % 2 else CODE.format(i=7), 1, "k", 0) for k in range(60)]
    feats = handwritten.file_features(spark.createDataFrame(rows, SCHEMA))
    got = feats.selectExpr("count(*)", "count(distinct body)", "count(distinct shape)", "count(bins)", "count(shingles)").first()
    assert tuple(got) == (60, 2, 2, 2, 2)
    shapes, bodies = set(), set()
    first = handwritten.features(["a.ts", "b.ts", "c.ts"], [text, "// @generated\n" + text, text], shapes, bodies)
    assert [x is not None for x in first["bins"].to_pylist()] == [True, True, False]
    assert [x is not None for x in first["wide"].to_pylist()] == [False, True, False]
    assert first["body"].to_pylist().count(first["body"][0].as_py()) == 3
