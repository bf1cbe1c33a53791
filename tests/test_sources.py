import json
import zipfile

import pytest

from tracewell.operators import extraction
from tracewell.sources import readers as R


def docx(path, paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')


def test_trees_and_documents(spark, tmp_path):
    for p in ("src/a.ts", "src/dist/b.ts", "src/c.PY", "src/d.css", "redist/e.go"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("const x = 1\n")
    got = {r.path: r.language for r in R.code_tree(spark, str(tmp_path), ["dist"]).collect()}
    assert got == {"src/a.ts": "typescript", "src/c.PY": "python", "redist/e.go": "go"}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_bytes(b"# T\xff\n")
    docx(tmp_path / "docs/b.docx", ["one", " ", "two"])
    (tmp_path / "docs/c.docx").write_bytes(b"no zip")
    (tmp_path / "docs/d.doc").write_bytes(b"x")
    rows = {r.path: (r.text, r.problem) for r in R.documents(spark, str(tmp_path / "docs")).collect()}
    assert rows["a.md"] == ("# T\n", None) and rows["b.docx"] == ("one\ntwo", None)
    assert rows["c.docx"][0] is None and rows["c.docx"][1] and rows["d.doc"][1]
    (tmp_path / "s.prisma").write_text("model A {\n  id Int\n}")
    assert R.schema_files(spark, str(tmp_path / "s.prisma")).count() == 1
    ids = R.identifier_files(R.code_tree(spark, str(tmp_path)), ["src"])
    assert {r.path: r.identifiers for r in ids.collect()}["src/a.ts"] == ["const", "x"]


def test_results_and_settings(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, s string")
    R.write_results(df, str(tmp_path / "o"), "csv")
    assert {tuple(r) for r in R.result_rows(spark, str(tmp_path / "o"), "n int, s string").collect()} == {(1, "a|b"), (2, None)}
    assert R.markdown(df) == "| n | s |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |"
    (tmp_path / "g.json").write_text(json.dumps({"a.ts": ["b.ts", "c.ts"], "b.ts": []}))
    assert {tuple(r) for r in R.dependency_edges(spark, str(tmp_path / "g.json")).collect()} == {("a.ts", "b.ts"), ("a.ts", "c.ts")}
    (tmp_path / "r.jsonl").write_text('{"scenario_id": "s", "raw": "x", "latency_ms": 1.5}\n')
    assert R.replies(spark, str(tmp_path / "r.jsonl")).first().latency_ms == 1.5
    s = R.Settings.load(env={"TRACEWELL_CODE": "src, lib", "TRACEWELL_DENY_DEFAULT": "no", "TRACEWELL_RULE_TTL": "5"})
    assert (s.code, s.deny_default, s.rule_ttl, s.project) == (["src", "lib"], False, 5.0, ".")
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump({"project": "p", "code": ["x"]}))
    s = R.Settings.load(str(tmp_path / "c.yaml"), env={"TRACEWELL_PROJECT": "q"})
    assert (s.project, s.code) == ("q", ["x"])
    with pytest.raises(PermissionError):
        R.run_sql(spark, "INSERT INTO t VALUES (1)")
    assert R.run_sql(spark, "select :a as a, 'drop' as b", a=3).first().a == 3
    assert R.describe(df) == [("n", "int", True), ("s", "string", True)]
    assert R.shortened("a\n b" + "c" * 300)[-3:] == "..." and len(R.shortened("x" * 200)) == 160
    assert spark.range(1).select(R.clean_text(R.F.lit("a\n\n\n\nb"))).first()[0] == "a\n\nb"


def test_extraction(spark):
    p = {"nodes": [{"id": "R1", "type": "Requirement"}, {"id": "", "type": "Table"}, {"id": "X", "type": "9bad"}], "edges": [{"source": "R1", "type": "GOVERNS", "target": "T9"}, {"source": "R1", "type": "LIKES", "target": "R1"}]}
    n, e = extraction.unpacked(spark.createDataFrame([("d", json.dumps(p)), ("e", "no json")], "doc string, payload string"))
    got = {tuple(r) for r in extraction.problems(n, e).collect()}
    assert got == {("d", "", "no id"), ("d", "X", "unknown label"), ("d", "X", "unsafe label"), ("d", "R1 LIKES R1", "unknown relation"), ("d", "R1 GOVERNS T9", "no target")}
    known = spark.createDataFrame([("T9",)], "id string")
    assert ("d", "R1 GOVERNS T9", "no target") not in {tuple(r) for r in extraction.problems(n, e, known).collect()}
