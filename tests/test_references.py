import random
from collections import defaultdict
from datetime import datetime, timedelta

from tracewell.operators.references import orphan_references, orphan_report

REFS = "source_table string, record_id long, target string, ref string, recorded_at timestamp, status string, month int"
PARENTS = "target string, key string, record_id long, status string, recorded_at timestamp, ident long, word long"


def brute(refs, parents):
    by = defaultdict(list)
    norm = lambda k: (k or "").strip().upper()
    for p in parents:
        by[p[0], norm(p[1])].append((p[4], p[2] or -1, (p[3] or "").strip().lower() == "deleted"))
    first = {}
    for r in refs:
        k = (r[0], r[1], norm(r[3]))
        if k[2]:
            first[k] = min(first.get(k, (r[4], r[2])), (r[4], r[2]), key=lambda x: (x[0] is not None, x[0] or datetime.min))
    out = set()
    for (src, rid, key), (t, target) in first.items():
        rows = by.get((target, key))
        period = t.strftime("%Y-%m") if t else ""
        if not rows:
            out.add((src, rid, key, "missing", period))
        elif t is not None:
            seen = [x for x in rows if x[0] is not None and x[0] <= t]
            if not seen:
                out.add((src, rid, key, "late", period))
            elif max(seen)[2]:
                out.add((src, rid, key, "deleted", period))
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_random_versions_against_brute_force(spark):
    rng = random.Random(3)
    t0 = datetime(2024, 1, 1)
    when = lambda: t0 + timedelta(hours=rng.choice([0, 0, 1, 700, 1500, 3000]) + rng.randint(0, 3), minutes=rng.choice([0, 0, 30]))
    keys = [f"RQ-{i}" for i in range(90)]
    parents = [("r", rng.choice(["", " ", "\t"]) + rng.choice(keys[:70]).lower(), i, rng.choice(["active", "Deleted", None]), rng.choice([when(), when(), None]), 0, 0) for i in range(400)]
    refs = [("policy", i // 3, "r", rng.choice([*keys, None, "", "  "]), rng.choice([when(), when(), when(), None]) if i % 3 == 0 else t0 + timedelta(days=i % 200), None, 1) for i in range(900)]
    hot = [("rules", 10_000 + i, "r", "rq-1 ", when(), None, 1) for i in range(400)]  # a third of all rows has one key
    refs += hot + refs[:50]
    df = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    assert got(df) == brute(refs, parents)


def test_empty_tables(spark):
    none_r, none_p = spark.createDataFrame([], REFS), spark.createDataFrame([], PARENTS)
    one = spark.createDataFrame([("a", 1, "r", "x", datetime(2024, 5, 1), None, 0)], REFS)
    assert got(orphan_references(none_r, none_p)) == set()
    assert got(orphan_references(one, none_p)) == {("a", 1, "X", "missing", "2024-05")}
    assert [tuple(r) for r in orphan_report(orphan_references(one, none_p)).collect()] == [("a", "2024-05", "missing", 1, 1)]


def test_tie_in_time_goes_to_the_larger_record(spark):
    t = datetime(2024, 5, 1)
    parents = [("r", "X", 2, "deleted", t, 0, 0), ("r", "X", 1, "active", t, 0, 0), ("r", "Y", 1, "deleted", t, 0, 0), ("r", "Y", 2, "active", t, 0, 0)]
    refs = [("a", 1, "r", "x", t, None, 0), ("a", 2, "r", "y", t, None, 0)]
    df = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    assert got(df) == {("a", 1, "X", "deleted", "2024-05")}
