import fnmatch
import json
import random

from pyspark.sql import functions as F

from tracewell.functions import paths
from tracewell.operators import gate, rules

RULES = "rule_id string, operation string, path_pattern string, effect string, min_role string, source_priority int, policy_id string"


def test_globs_equal_the_shell(spark):
    pats = ["src/*", "src/**/x.ts", "a?c", "[ab]c", "[!ab]c", "a[", "a.b+c", "x(1)", "*", "", "[a-m]*/src/*", "a\\b"]
    texts = ["src/a", "src/a/x.ts", "abc", "ac", "cc", "a[", "a.b+c", "axb+c", "x(1)", "", "k/src/z", "q/src/z", "src", "bc"]
    df = spark.createDataFrame([(p, t) for p in pats for t in texts], "p string, t string")
    got = {(r.p, r.t): r.m for r in df.select("p", "t", F.rlike("t", paths.glob_regex(F.col("p"))).alias("m")).collect()}
    assert got == {(p, t): fnmatch.fnmatchcase(t, p) for p in pats for t in texts}


def decide(spark, data, asks, **kw):
    r = rules.valid_rules(spark.createDataFrame(data, RULES))
    q = spark.createDataFrame([(i, *a) for i, a in enumerate(asks)], "request_id int, operation string, path string, role string")
    return {x.request_id: x for x in rules.decide(q, r, **kw).collect()}


def test_decisions(spark):
    data = [
        ("A", "*", "src/*", "ALLOW", "viewer", 1, "P1"), ("B", "write", "src/api/*", "deny", "admin", 0, None), ("C", "write", "SRC\\lib\\x.ts", "allow", "admin", 5, None),
        ("D", "write", "src", "allow", "viewer", 0, None), ("E", "delete", "*", "allow", "boss", 0, None), ("F", "write", "src/lib/*", "allow", "viewer", 1, None), ("G", "write", "src/lib/*", "allow", "viewer", 2, None),
    ]
    got = decide(spark, data, [("write", "src/a.ts", "viewer"), ("write", "src/api/a.ts", "editor"), ("write", "/src/api/a.ts/", "admin"), ("write", "src/lib/x.ts", "admin"), ("write", "src/lib/y.ts", "viewer"), ("delete", "other", "admin"), ("write", "src/a.ts", "guest"), ("write", "src/a.ts", None)])
    assert [got[i].allowed for i in range(8)] == [True, False, True, True, True, False, False, False]
    assert [got[i].matched_rule_id for i in range(8)] == ["A", "B", "A", "C", "G", None, None, None]
    assert got[0].reason == "Authorized by rule 'A' (requires role>=viewer)." and got[1].reason == "Denied by rule 'B' (requires role>=admin)."
    assert got[5].reason == rules.DENY_DEFAULT and got[6].reason == rules.INVALID_ROLE and got[0].matched_policy_id == "P1"
    assert decide(spark, data, [("delete", "other", "viewer")], deny_default=False)[0].allowed


def test_decisions_against_brute_force(spark):
    rng = random.Random(2)
    roles = ["viewer", "editor", "admin"]
    data = [(f"R{i}", rng.choice(["write", "delete", "*"]), rng.choice(["src/*", "src/a/*", "src/a/b.ts", "*/b.ts", "src/?/*", "[a-s]*", "lib", "lib/*"]), rng.choice(["allow", "deny"]), rng.choice(roles), rng.randrange(3), None) for i in range(40)]
    asks = [(op, p, r) for op in ("write", "delete") for p in ("src/a/b.ts", "src/c", "lib", "lib/x", "zzz") for r in roles]
    got = decide(spark, data, asks)
    for i, (op, p, role) in enumerate(asks):
        found = []
        for rid, ro, pat, eff, mr, pr, _ in data:
            k, need = roles.index(role), roles.index(mr)
            if ro in (op, "*") and fnmatch.fnmatchcase(p, pat) and (k >= need if eff == "allow" else k < need):
                wild = sum(c in "*?[]" for c in pat)
                found.append((eff != "deny", -(len(pat) - wild), -(pat.count("/") + 1), wild, -len(pat), -pr, rid))
        best = min(found)[-1] if found else None
        assert got[i].matched_rule_id == best, asks[i]


def test_claims(spark):
    data = [("a", '{"role": "Editor"}'), ("b", '{"role": ["viewer", "x"], "realm_access": {"roles": ["admin"]}}'), ("c", '{"resource_access": {"app": {"roles": ["editor"]}, "o": {}}}'), ("d", "{}"), ("e", "no json")]
    got = {r.subject: r.role for r in rules.roles_from_claims(spark.createDataFrame(data, "subject string, payload string")).collect()}
    assert got == {"a": "editor", "b": "admin", "c": "editor", "d": None, "e": None}
    base = {"exp": 1000, "iss": "i", "aud": ["x", "me"], "scope": "read write"}
    data = [(k, json.dumps(base | v)) for k, v in {"ok": {}, "skew": {"exp": 950}, "old": {"exp": 900}, "early": {"nbf": 2000}, "aud": {"aud": "you"}, "one": {"aud": "me"}, "scope": {"scope": "read"}, "iss": {"iss": "j"}}.items()]
    got = {r.subject: r.ok for r in rules.valid_tokens(spark.createDataFrame(data, "subject string, payload string"), 999, "i", "me", ["read", "write"]).collect()}
    assert {k for k, v in got.items() if v} == {"ok", "skew", "one"}


def test_gate(spark):
    schema = "plan_id int, rbac_allowed boolean, declared_files array<string>, actual_files array<string>, declared_requirements array<string>, violated_requirements array<string>, enforced_policies array<string>"
    data = [(1, True, ["a", "/b\\c/"], ["b/c", "a"], ["R"], ["R"], None), (2, True, ["a"], ["b", "a"], None, [], None), (3, False, None, None, None, None, None), (4, True, ["./a"], ["a"], None, None, None), (5, True, [], [], [], [" R "], ["P", "P", ""]), (6, None, [], [], [], [], [])]
    df = spark.createDataFrame(data, schema)
    assert {r.plan_id: r.decision for r in gate.evaluate(df).collect()} == {1: "allow", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block"}
    soft = {r.plan_id: r for r in gate.evaluate(df, strict=False).collect()}
    assert soft[2].decision == "warn" and soft[2].missed_files == ["b"] and soft[5].silent_requirements == ["R"] and soft[5].enforced_policies == ["P"] and soft[3].decision == "block"


EVENTS = "event_id long, token string, kind string, operation string, files array<string>, path string, ts double"
LOG = [
    (1, "t", "issue", "write", ["a", "/b/"], None, 100.0), (2, "t", "consume", "delete", None, "a", 101.0), (3, "t", "consume", "write", None, "c", 102.0), (4, "t", "consume", "write", None, "a", 103.0),
    (5, "t", "consume", "write", None, "a", 104.0), (6, "t", "consume", "write", None, "b", 105.0), (7, "t", "consume", "write", None, "b", 106.0), (8, "u", "consume", "write", None, "a", 1.0),
    (9, "v", "issue", "write", ["a"], None, 0.0), (10, "v", "consume", "write", None, "a", 900.0), (11, "v", "consume", "write", None, "a", 899.0),
]
WANT = {2: "operation", 3: "path", 4: "", 5: "used", 6: "", 7: "missing", 8: "missing", 10: "missing", 11: ""}


def test_tokens(spark):
    got = {r.event_id: r.error for r in gate.replay_tokens(spark.createDataFrame(LOG, EVENTS)).collect()}
    assert got == WANT
