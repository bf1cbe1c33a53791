import pytest

from tracewell.llm import sources

GOOD = {
    "python": ["def f(a, *, b=1):\n    return {**a, 'b': b}\n", "x: int = 1\nmatch x:\n    case 1: pass\n", "# only a comment"],
    "typescript": [
        "export const f = async <T,>(x: Array<Map<string, T[]>>, y?: number): Promise<void> => { await x; };\n",
        "type A<T> = T extends string ? `${T}:x` : { readonly [K in keyof T]?: T[K] };\ninterface B extends C<D> { (x: number): string; new (): B; m?(): void }\n",
        "export default class X<T> extends Y<T> implements Z { private readonly a: number = 1; constructor(private b: string) { super(); } get v() { return this.a!; } static async *g() {} }\n",
        "const a = b as unknown as C;\nconst t = x < y && z > (w);\nlet f = (a: number): a is 1 => true;\nenum E { A = 1, B }\ndeclare module 'x' { export function f(): void; }\n",
        "import type { A } from './a'\nimport b, { type C, d as e } from './b'\nexport * as ns from './c'\nlabel: for (const [k, v] of m) { if (!k) continue label }\n",
        "const s = `<<<<<<< a ${`inner ${x}`} >>>>>>>`;\nconst r = /[/\\]{]/g.test(s) ? 1 : 2\n",
        "abstract class A { abstract f(): void; protected abstract readonly x: number }\nfunction f(this: A, ...r: string[]): asserts r is string[] { throw r }\n",
    ],
    "tsx": ["const f = (p: P) => (<div className=\"a\" {...p}>{p.items.map((i) => <Row key={i.id} on={() => { x(i) }} />)} it's text <></></div>);\n"],
    "javascript": [
        "var a = 1, b\nfor (var i = 0, n = 3; i < n; i++) a += i\nif (a) b = function () { return /x\\/y/.exec(a) }\nelse { b = a ? { c, d() {}, get e() { return 1 }, ...a } : [1,,2] }\n",
        "class A { #x = 1; static { } async *[Symbol.iterator]() { yield* this.#x } }\nnew A().b?.c?.[0]?.(1)\nexport { a as default, b }\n",
        "do x++; while (x < 5)\nswitch (x) { case 1: case 2: y(); break; default: z() }\ntry { a() } catch { b() } finally { c() }\nlet { a: { b = 1 } = {}, ...rest } = q\n",
        "!function(e,t){for(var i=0;i<e.length;i++)t[i]^=3;if(e>1){e(t)}else{t.push(e)}}(a,b)\n",
        "const el = <A.B x='1' {...y}>{/* c */}{a ? <b/> : null}</A.B>\n",
    ],
    "go": [
        "package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype T[K comparable, V any] struct {\n\tsync.Mutex\n\ta, b int `json:\"a\"`\n\tf func(int) (string, error)\n}\n\nfunc (t *T[K, V]) M(ctx context.Context, xs ...int) (n int, err error) {\n\tfor i := range xs {\n\t\tif v, ok := t.m[i]; ok && v != nil {\n\t\t\tcontinue\n\t\t}\n\t}\n\tswitch x := y.(type) {\n\tcase int, string:\n\t\treturn 1, nil\n\tdefault:\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase v := <-d:\n\t\t_ = v\n\t}\n\tgo func() { defer close(c) }()\n\tm := map[string][]T{\"a\": {{1, 2}, {3, 4}}}\n\treturn len(m), nil\n}\n",
    ],
    "java": [
        "package a.b;\nimport java.util.*;\nimport static x.Y.z;\n@A(b = {1, 2}) public abstract class C<T extends D & E> extends F<T[]> implements G {\n  private final Map<String, List<? extends T>> m = new HashMap<>();\n  enum K { A(1) { void f() {} }, B; K(int... x) {} }\n  record R(int a, String... b) { R { } }\n  <U> U f(final int a, Object o) throws X { for (var e : m.entrySet()) { if (o instanceof String s && !s.isEmpty()) return null; } int[] q = {1, 2}; q[0] >>>= 2; Runnable r = () -> { }; BiFunction<A, B, C> g = (a1, b1) -> a1 + b1; String t = switch (a) { case 1, 2 -> \"x\"; default -> { yield \"y\"; } }; try (var z = y()) { } catch (A | B e) { } finally { } return (U) (Object) this.<U>f(1, String[]::new); }\n}\n",
        "interface I { int X = 1; default void f() {} static int g() { return X; } }\n@interface N { String v() default \"a\"; }\n",
    ],
    "c": [
        "#include <a.h>\n#ifndef G\n#define G\ntypedef struct node { struct node *next; unsigned long v : 3; int (*f)(void *, ...); } node_t;\nstatic const char *names[] = { [0] = \"a\", \"b\" \"c\" };\nextern int g(const node_t *restrict n, int a[static 3]);\nint main(int argc, char **argv)\n{\n    node_t x = { .v = 1, .next = NULL }, *p = &x;\n    for (size_t i = 0; i < sizeof(names) / sizeof names[0]; i++) { if (p->v & 1u << 3) goto out; else *p = (node_t){ 0 }; }\n    switch (argc) { case 1: return (int)(x.v * 2); default: break; }\n    do { argc -= 1; } while (argc > 0 ? 1 : 0);\nout:\n    return (unsigned char)*argv[0] == '\\'';\n}\n#endif\n",
    ],
    "cpp": [
        "#pragma once\nnamespace a::b {\ntemplate <typename T, int N = 3> class X final : public Y<T>, private Z {\npublic:\n    explicit X(int n) noexcept : n_{n}, y_(n) {}\n    ~X() override = default;\n    X& operator=(const X&) = delete;\n    auto f(const std::map<std::string, std::vector<T>>& m) const -> decltype(m.size()) { for (const auto& [k, v] : m) { out += k + \"x\"; } return static_cast<int>(m.size()) < n_ ? 1 : 2; }\nprivate:\n    int n_ = 0; Y<T> y_{};\n};\nusing V = std::vector<int>;\nenum class E : int { A, B = 2 };\ninline auto g = [&](auto x) mutable { return x ? new int[3] : nullptr; };\nint h() { try { throw E::A; } catch (const std::exception& e) { delete[] p; } catch (...) {} if (auto it = m.find(1); it != m.end()) return R\"(})\"[0]; return a<b>(c) + d; }\n}  // namespace\n",
        "static int f(const char *t, int n) { int d = 0; for (int i = 0; i < n; i++) { if (t[i] == '(') { d++; } } return d > 3 ? -1 : d; }\n",
    ],
}
BAD = {
    "python": ["def f(:\n", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "print 'x'\n", "if x:\n"],
    "typescript": ["export class A {\n  f() {\n", "const x = ;\n", "<<<<<<< HEAD\nlet a = 1\n=======\n", "def f(x):\n    return x\n", "<!DOCTYPE html>\n<html></html>\n", "let s = 'abc\n", "a b c\n", "const a: number =\n"],
    "javascript": ["const x: number = 1;\n", "interface A { b: c }\n", "export type K = `${string}`;\n", "function f(a) { return }}\n", "import x from\n", "foo(1, 2\n", "class A { f() {} >>>>>>> dev\n}\n", "package a\n\nfunc f() {}\n"],
    "go": ["func f() {}\n", "package a;\nimport java.util.List;\n", "package a\nfunc f() {\n", "package a\n\nvar x = \"abc\n", "package a\nfunc f() {\n\treturn 1 2\n}\n"],
    "java": ["package a\nclass B {}\n", "class A { int f( { } }\n", "class A { int x = ; }\n", "class A {\n=======\n}\n", "const x = 1;\n"],
    "c": ["int f(void) { return 1;\n", "template <typename T> class X {};\n", "std::string f() { return 1; }\n", "# Title\n\nSome text here.\n", "#include <a.h\n", "#ifdef A\nint x;\n", "int f(int a b) { }\n"],
    "cpp": ["class X { int a;\n", "void f() { int x = ; }\n", "package a;\nimport b.c;\n", ">>>>>>> dev\nint x;\n", "INSERT INTO a VALUES (1);\n"],
}


@pytest.mark.parametrize("grammar", GOOD)
def test_valid(grammar):
    for text in GOOD[grammar]:
        assert sources.parses(text, grammar), text
        assert sources.parses(text.replace("\n", "\r\n"), grammar), text


@pytest.mark.parametrize("grammar", BAD)
def test_invalid(grammar):
    for text in BAD[grammar]:
        assert not sources.parses(text, grammar), text


@pytest.mark.parametrize(("grammar", "text"), [("javascript", "x = {}\n"), ("typescript", "x = {}\n"), ("go", "package a\nvar x = {}\n"), ("java", "class A {{ int x = {}; }}\n"), ("c", "int x = {};\n"), ("cpp", "int x = {};\n")])
def test_deep(grammar, text):
    assert sources.parses(text.format("(" * 20_000 + "1" + ")" * 20_000), grammar)
    assert not sources.parses(text.format("(" * 20_000 + "1" + ")" * 19_999), grammar)


def test_deep_python():
    sources.parses("x = " + "(" * 20_000 + "1" + ")" * 20_000 + "\n", "python")  # ends, whatever it says
    assert sources.parses("x = " + "-" * 60_000 + "1\n", "python")
    assert not sources.parses("x = (" + "-" * 60_000 + "1\n", "python")


def test_branches():
    text = "#if A\nint f(void) {{ {} }}\n#elif B\nint f(void) {{ {}\n#ifdef D\n{}\n#else\n{}\n#endif\n}}\n#else\nint f(void) {{ {} }}\n#endif\n#if 0\nsome prose, isn't it\n#endif\n"
    good = ["return 1;"] * 5
    for grammar in ("c", "cpp"):
        assert sources.parses(text.format(*good), grammar)
        for k in range(5):
            bad = list(good)
            bad[k] = "return 1 +;"
            assert not sources.parses(text.format(*bad), grammar), k
        assert sources.parses("#if A\nint f(void) {\n#else\nint f(int a) {\n#endif\n#if A\nreturn 1; }\n#else\nreturn a; }\n#endif\n", grammar)
        assert not sources.parses("#else\nint a;\n#endif\n", grammar)


def test_cuts_inside_brackets_never_parse():
    for grammar in ("typescript", "go", "java", "c", "cpp"):
        text = GOOD[grammar][0]
        first, last = text.index("{") if grammar != "go" else text.index("struct {") + 8, text.rindex("}")
        for cut in range(first + 1, last, 7):
            if text[:cut].count("{") > text[:cut].count("}"):
                assert not sources.parses(text[:cut], grammar), text[:cut][-60:]


SCHEMA = "file_id long, repo string, path string, language string, content string, ingested_at long, ok string, foreign string"


def test_operator(spark):
    long = "x = [\n" + "1,\n" * 100_000 + "]\n"
    rows = [
        (1, "a", "m.PY", "go", "x = 1\n", 1), (1, "a", "m.PY", "go", "x = (\n", 2),
        (2, "a", "m.ts", None, "x = 1\n", 1), (3, "a", "m.js", None, "let x: number = 1\n", 1),
        (4, None, "m.java", None, "class", 1), (5, "a", "m.md", None, "(", 1), (6, "a", "m.py", None, "", 1), (7, "a", "m.go", None, " \n", 1),
        (8, "a", None, None, "(", 1), (9, "a", "m.py", None, None, 1), (None, "a", "m.py", None, "(", 1), (10, "a", "m.py", None, long, 1),
        (11, "a", "m.py", None, long + "(", 1),
    ]
    df = sources.parsed_sources(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA))
    got = {r.file_id: (r.ok, r.foreign) for r in df.collect()}
    assert {k for k, v in got.items() if not v[0]} == {1, 3, 4, 11}
    assert {k for k, v in got.items() if v[0]} == {2, 10}
    assert "javascript" in got[2][1].split(",")
    assert got[3][1].split(",")[0] == "typescript" and got[4][1] == ""
    rates = {(r.repo, r.language): (r.n_files, r.n_broken, r.n_wrong_extension) for r in sources.broken_rates(df).collect()}
    assert rates["a", "python"] == (3, 2, 0) and rates["a", "javascript"] == (1, 1, 1)
    assert sources.parsed_sources(spark.createDataFrame([], SCHEMA)).collect() == []
