"""Files with several importers: none of them is left out, by the queries or by their SQL."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """Ledger is said by src/db/a; api/b, api/c and api/e import it at either end, api/d imports c, and a imports d."""
    d = tmp_path_factory.mktemp("shop")
    tables = {
        "code_files": ("file_id int, repo string, path string, content string", [(1, "r", "src/db/a.ts", "ledger entry"), (2, "r", "src/db/lone.ts", "nothing")]),
        "import_graph": (
            "node_id long, repo string, file_path string, imports array<string>, imported_by string",
            [
                (1, "r", "src/db/a.ts", ["src/api/d"], None),
                (2, "r", "src/api/b.ts", ["src/db/a"], None),
                (3, "r", "src/api/c.ts", ["@/db/a.ts", "./src/db/a"], "src/api/d"),
                (4, "r", "src/api/d.ts", [], ""),
                (1, "r", "./src/db/a.ts", None, "src/api/e"),
                (5, "r", "src/api/e.ts", None, None),
            ],
        ),
        "repo_specs": ("name string, alias_map map<string,string>", [("r", {"@/": "src/"})]),
        "scenario_predictions": ("entity_type string, entity_name string", [("table", "ledger"), ("column", "ledger.entry")]),
        "requirement_records": ("req_id string, title string, description string, category string, status string, recorded_at timestamp, record_id string", []),
        "policy_records": ("policy_id string, description string, requirement_ids array<string>, status string, recorded_at timestamp, record_id string", []),
        "documents": ("doc_id string, repo string, text string", [("t", "r", "the ledger"), ("f", "r", "see src/db/a.ts there"), ("u", "r", "nothing")]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return str(d)


def got(spark, folder, name):
    df, con = entry.queries()[name](spark, folder), duckdb.connect()
    for t in "code_files import_graph repo_specs scenario_predictions requirement_records policy_records documents".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    rows = df.collect()
    assert Counter(map(tuple, rows)) == Counter(con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall())
    return rows


def test_ablation_counts_every_importer(spark, shop):
    """One direct file; b, c, d, e and a itself, around the loop, with the closure."""
    assert {tuple(r) for r in got(spark, shop, "g8_ablation")} == {("table", 1, 1, 5), ("column", 1, 1, 5)}


def test_lists_hold_every_importer(spark, shop):
    rows = {(r.entity_type, r.entity, r.file, r.how, r.backend) for r in got(spark, shop, "q1_files")}
    files = {(f"r/src/{f}", how) for f, how in [("db/a.ts", "direct"), *[(f"api/{x}.ts", "transitive") for x in "bcde"], ("db/a.ts", "transitive")]}
    assert rows == {(kind, entity, f, how, True) for kind, entity in (("table", "ledger"), ("column", "ledger.entry")) for f, how in files}


def test_preflight_weighs_every_importer(spark, shop):
    """Two points for each of five backend files or files."""
    assert {(r.id, r.entity_type, r.risk_score, r.recommendation) for r in got(spark, shop, "q7_preflight")} == {("t", "table", 10, "check"), ("f", "file", 10, "check"), ("u", "unknown", 0, "proceed")}
