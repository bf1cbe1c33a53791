import json

from tracewell.operators import nested

SCHEMA = "record_id long, payload string, ingested_at long, reason string, violations string"


def rows(spark, payloads, f=nested.links):
    data = [(i, p if isinstance(p, str) or p is None else json.dumps(p), 1, "x", "y") for i, p in enumerate(payloads)]
    return {tuple(r) for r in f(spark.createDataFrame(data, SCHEMA)).collect()}


def test_shapes(spark):
    v = {"requirement_id": "R", "trace_path": "T"}
    got = rows(
        spark,
        [
            {"rbac": {"reason": "no"}, "violations": [None, v | {"enforced_by": [None, "P1", {"policy_id": "P2"}, {}]}]},
            {"rbac": "bare", "violations": v | {"enforced_by": {"policy_id": "P"}}},
            {"rbac": None, "violations": json.dumps([v, v | {"enforced_by": []}])},
            {"violations": []},
            {"violations": None, "rbac": {"reason": None}},
            {},
            '{"violations": [',
            None,
            "",
            "[1]",
            '{"a": 1} trailing',
            {"schema_version": 2, "result": {"rbac": {"reason": "in"}, "violations": [v | {"enforced_by": "P9"}]}},
            {"violations": [None, "text"]},
            {"violations": [{"requirement_id": None, "enforced_by": None}]},
            {"violations": {"count": 3, "items": [v, None, v | {"enforced_by": {"items": ["P1", None, {"policy_id": "P2"}]}}]}},
            {"violations": {"count": 0, "items": []}},
            {"violations": json.dumps({"items": [v]})},
            {"violations": {"items": None} | v},
        ],
    )
    assert got == {
        (0, 1, 1, "R", "T", "P1", "no"), (0, 1, 2, "R", "T", "P2", "no"), (0, 1, 3, "R", "T", "", "no"),
        (1, 0, 0, "R", "T", "P", "bare"),
        (2, 0, -1, "R", "T", "", ""), (2, 1, -1, "R", "T", "", ""),
        (3, -1, -1, "", "", "", ""), (4, -1, -1, "", "", "", ""), (5, -1, -1, "", "", "", ""),
        (11, 0, 0, "R", "T", "P9", "in"),
        (12, -1, -1, "", "", "", ""),
        (13, 0, -1, "", "", "", ""),
        (14, 0, -1, "R", "T", "", ""), (14, 2, 0, "R", "T", "P1", ""), (14, 2, 2, "R", "T", "P2", ""),
        (15, -1, -1, "", "", "", ""),
        (16, 0, -1, "R", "T", "", ""),
        (17, 0, -1, "R", "T", "", ""),
    }


def test_parent_tables_agree_with_links(spark):
    payload = {"scenario_id": "S", "repo": "r", "violations": [{"requirement_id": "R", "enforced_by": [{"policy_id": "P", "policy_title": "t"}]}] * 3}
    assert len(rows(spark, [payload], nested.violations)) == 3
    assert len(rows(spark, [payload], nested.policies)) == 3
    assert {r[-1] for r in rows(spark, [payload], nested.scenarios)} == {3}


def test_repeated_empty_and_long(spark):
    data = [(1, '{"rbac": "old"}', 1, "", ""), (1, '{"rbac": "new"}', 2, "", ""), (None, "{}", 1, "", "")]
    got = nested.links(spark.createDataFrame(data, SCHEMA)).collect()
    assert {(r.record_id, r.reason) for r in got} == {(1, "new"), (None, "")}
    assert nested.links(spark.createDataFrame([], SCHEMA)).collect() == []
    many = {"violations": [{"requirement_id": f"R{i}", "enforced_by": [f"P{j}" for j in range(5)]} for i in range(3000)]}
    assert len(rows(spark, [many])) == 15_000
