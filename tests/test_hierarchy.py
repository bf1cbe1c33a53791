import random

from tracewell.operators.hierarchy import ancestors, descendants, nested_sets, resolve_links

LINKS = "node_id long, parent_id long, size int, lo int"


def brute(parent):
    out = {}
    for v in parent:
        path, u = [v], parent[v]
        while u is not None and u not in path:
            path.append(u)
            u = parent[u]
        if u is None:
            out[v] = (path[-1], len(path) - 1)
        else:
            out[v] = (min(path[path.index(u):]), -1)
    return out


def check(df, parent):
    rows = {r.node_id: r for r in df.collect()}
    assert len(rows) == df.count() == len(parent)
    assert {v: (r.root_id, r.depth) for v, r in rows.items()} == brute(parent)
    for top in {r.top_id for r in rows.values()}:
        held = sorted(r.lo for r in rows.values() if r.top_id == top)
        assert held == list(range(len(held)))  # ranges without gap or overlap
    for v, r in rows.items():
        p = parent[v]
        if p is not None and not r.on_loop:
            q = rows[p]
            assert q.top_id == r.top_id and q.lo < r.lo and r.hi <= q.hi
    return rows


def test_random_forests_with_loops(spark):
    rng = random.Random(7)
    for n, wide in ((1, 1), (60, 3), (300, 40)):
        parent = {i * 7: (None if rng.random() < 0.1 else rng.randrange(max(1, i // wide + 1)) * 7) for i in range(n)}
        parent[0] = None
        ids = list(parent)
        if n > 20:
            a, b, c, d = rng.sample(ids[1:], 4)
            parent[a], parent[b], parent[c], parent[d] = b, a, c, c  # a loop of two, a loop of one, one below it
        rows = [(v, p, 1, 1) for v, p in parent.items()]
        rows += rows[: n // 3]
        check(nested_sets(spark.createDataFrame(rows, LINKS)), parent)


def test_chain_star_and_paths(spark):
    parent = {i: i - 1 if i else None for i in range(200)} | {1000 + i: 1000 if i else None for i in range(300)}
    df = nested_sets(spark.createDataFrame([(v, p, 0, 0) for v, p in parent.items()], LINKS), paths=True)
    rows = check(df, parent)
    assert rows[150].path == list(range(151)) and rows[1007].path == [1000, 1007]
    of = spark.createDataFrame([(190,), (1000,)], "node_id long")
    assert {r.descendant_id for r in descendants(df, of).where("node_id = 190").collect()} == set(range(191, 200))
    assert descendants(df, of).where("node_id = 1000").count() == 299
    assert {r.ancestor_id for r in ancestors(df, of).where("node_id = 190").collect()} == set(range(190))


def test_all_descendants_of_star_chain_and_random_trees(spark):
    rng = random.Random(3)
    parent = {i: i - 1 if i else None for i in range(90)} | {1000 + i: 1000 if i else None for i in range(130)}
    parent |= {2000 + i: 2000 + rng.randrange(i) if i else None for i in range(150)} | {9000: 9001, 9001: 9000, 9002: 9001, 9003: 9002, 9004: 9004}
    df = nested_sets(spark.createDataFrame([(v, p, 0, 0) for v, p in parent.items()], LINKS))
    want, loops = set(), {9000, 9001, 9004}
    for v in parent:
        u = v
        while u not in loops and parent[u] is not None:
            u = parent[u]
            want.add((u, v))
    rows = [tuple(r) for r in descendants(df).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {(b, a) for a, b in map(tuple, ancestors(df).collect())} == want
    assert descendants(df.limit(0)).collect() == []


def test_empty_and_unknown_parents(spark):
    assert nested_sets(spark.createDataFrame([], LINKS)).collect() == []
    rows = nested_sets(spark.createDataFrame([(1, 99, 0, 0), (2, None, 0, 0)], LINKS)).collect()
    assert {(r.node_id, r.root_id, r.depth) for r in rows} == {(1, 1, 0), (2, 2, 0)}


def test_link_resolution(spark):
    graph = [
        (1, "a", "src/app.ts", ["@/lib/x", " ./src\\lib\\y.ts\t", None, "", "node:fs", "src/gone"], None, 0),
        (2, "a", "src/lib/x/index.ts", [], None, 0),
        (3, "a", "./src/lib/y.ts", None, None, 0),
        (4, "a", "src/lib/z.ts", ["src/lib/z"], "", 0),
        (5, "b", "src/lib/y.ts", None, "src/app", 0),
        (6, "a", "src/q.ts", None, "/src/app.ts/", 0),
        (6, "a", "src/q.ts", None, "././src/app", 0),
        (7, None, None, None, None, 0),
    ]
    specs = [("a", {"@/": "src/"}, None), ("c", None, None)]
    g = spark.createDataFrame(graph, "node_id long, repo string, file_path string, imports array<string>, imported_by string, name int")
    s = spark.createDataFrame(specs, "name string, alias_map map<string,string>, repo string").select("name", "alias_map")
    assert {tuple(r) for r in resolve_links(g, s).collect()} == {(1, None), (2, 1), (3, 1), (4, 4), (5, None), (6, 1), (7, None)}
