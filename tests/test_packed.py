import json
import random

from tracewell.operators.packed import packed_values

SCHEMA = "id long, files string, reqs string, writer string, field string, pos int, value string, predicted_at int"
TRICKY = ["src/a b/c d.ts", "src/x, y.ts", "docs/p; q.py", "src/a|b.ts", 'src/"q"/z.ts', "src/it's/w.js", "src/app/[...all]/p.ts", "src/(g)/page.tsx"]


def quoted(v):
    return '"' + v.replace('"', '""') + '"'


def write(rng, values, req):
    kind = rng.randrange(9)
    need = [quoted(v) if any(c in v for c in ',;|"') else v for v in values]
    if kind == 0:
        return json.dumps(values)
    if kind == 1:
        return json.dumps(values, indent=1)
    if kind == 2:
        return repr(values)
    if kind == 3:
        return "{" + ",".join(need) + "}"
    if kind == 4:
        return "\r\n".join("- " + v for v in need)
    if kind == 5 and req:
        return "  ".join(values)
    if kind == 6:
        return "".join(v + rng.choice([";", " , ", " | ", "\n ", "\t"]) for v in need)
    return rng.choice([", ", ";", " | ", "\n"]).join(rng.choice([v, quoted(v)]) if v in values else v for v in need)


def test_random_round_trip(spark):
    rng = random.Random(5)
    data, want = [], set()
    plain = [f"src/modules/m{i}/f-{i}.ts" for i in range(50)]
    for i in range(1500):
        files = [rng.choice(TRICKY) if rng.random() < 0.15 else rng.choice(plain) for _ in range(rng.randrange(6))]
        reqs = [f"RQ-{rng.randrange(10**6):07}" for _ in range(rng.randrange(4))]
        w = rng.choice("ab")
        data.append((i, write(rng, files, False), write(rng, reqs, True), w, "f", 1, "v", 1))
        want |= {(i, "files", k, v) for k, v in enumerate(files, 1)} | {(i, "reqs", k, v) for k, v in enumerate(reqs, 1)}
    data += data[:100]
    got = [tuple(r) for r in packed_values(spark.createDataFrame(data, SCHEMA), "id", ["files", "reqs"], ["writer"]).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_blank_and_empty(spark):
    data = [(i, v, None, None, None, None, None, None) for i, v in enumerate(["", " ", None, "[]", "{}", "[ ]", ",", '""', "a/b.ts,,"])]
    got = {tuple(r) for r in packed_values(spark.createDataFrame(data, SCHEMA), "id", ["files", "reqs"], ["writer"]).collect()}
    assert got == {(8, "files", 1, "a/b.ts")}
    assert packed_values(spark.createDataFrame([], SCHEMA), "id", ["files"], []).collect() == []
    long = ",".join(f"d/f{i}.ts" for i in range(20_000))
    rows = packed_values(spark.createDataFrame([(1, long, None, None, None, None, None, None)], SCHEMA), "id", ["files"], []).collect()
    assert len(rows) == 20_000 and rows[-1].value == "d/f19999.ts"
