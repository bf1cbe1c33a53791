import math
import random

from tracewell.operators import detect, dml, evaluate as ev, graph, privacy, retrieval, risk
from tracewell.plans import governance
from pyspark.sql import functions as F


def test_set_metrics(spark):
    t = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "k string, item string")
    p = spark.createDataFrame([("a", "x"), ("a", "z"), ("a", "x"), ("c", "q")], "k string, item string")
    got = {r.k: r for r in ev.set_metrics(t, p, ["k"]).collect()}
    assert [(got[k].tp, got[k].fp, got[k].fn) for k in "abc"] == [(1, 1, 1), (0, 0, 1), (0, 1, 0)]
    assert got["a"].f1 == 0.5 and got["c"].precision == 0
    m = ev.micro(ev.set_metrics(t, p, ["k"]), []).first()
    assert (m.tp, m.fp, m.fn) == (1, 2, 2) and abs(m.f1 - 1 / 3) < 1e-12


def test_rank_statistics(spark):
    rng = random.Random(1)
    a = [rng.randrange(8) for _ in range(60)]
    b = [rng.randrange(8) for _ in range(60)]
    pairs = spark.createDataFrame([("g", float(x), float(y)) for x, y in zip(a, b)], "g string, a double, b double")
    rank = lambda xs: [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]
    ra, rb = rank(a), rank(b)
    ma, mb = sum(ra) / 60, sum(rb) / 60
    rho = sum((x - ma) * (y - mb) for x, y in zip(ra, rb)) / math.sqrt(sum((x - ma) ** 2 for x in ra) * sum((y - mb) ** 2 for y in rb))
    assert abs(ev.spearman(pairs, ["g"]).first().rho - rho) < 1e-9
    d = [x - y for x, y in zip(a, b) if x != y]
    r = rank([abs(x) for x in d])
    w = min(sum(q for q, x in zip(r, d) if x > 0), sum(q for q, x in zip(r, d) if x < 0))
    got = ev.wilcoxon(pairs, ["g"]).first()
    assert (got.n, got.w) == (len(d), w)
    s = spark.createDataFrame([("g", "a", float(x)) for x in a] + [("g", "b", float(x)) for x in b[:40]], "g string, side string, value double")
    delta = sum((x > y) - (x < y) for x in a for y in b[:40]) / (60 * 40)
    assert abs(ev.cliffs_delta(s, ["g"]).first().delta - delta) < 1e-12
    same = spark.createDataFrame([("g", 1.0, 1.0), ("g", 1.0, 1.0)], "g string, a double, b double")
    assert ev.spearman(same, ["g"]).first().rho == 0 and ev.wilcoxon(same, ["g"]).count() == 0


def test_mcnemar_and_median(spark):
    rows = [("g", True, False)] * 16 + [("g", True, True)] * 3 + [("h", True, False)] * 2 + [("h", False, True)] * 5 + [("h", None, True)] + [("i", True, True)]
    got = {r.g: r for r in ev.mcnemar(spark.createDataFrame(rows, "g string, a boolean, b boolean"), ["g"]).collect()}
    exact = lambda n, k: min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    assert abs(got["g"].p - exact(16, 0)) < 1e-12 and abs(got["h"].p - exact(7, 2)) < 1e-12 and got["i"].p == 1
    df = spark.createDataFrame([(x,) for x in (5, 1, 9, 7)], "x int")
    assert df.agg(ev.upper_median("x")).first()[0] == 7


def test_bootstrap(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), rng.randrange(3), rng.randrange(3)) for _ in range(80)]
    df = spark.createDataFrame(rows + [(0, 0, 0)] * 5, "tp int, fp int, fn int").withColumn("g", F.lit("g"))
    one, two = ev.bootstrap(df, ["g"], 400).first(), ev.bootstrap(df.repartition(3), ["g"], 400).first()
    assert one == two and one.low < one.f1 < one.high and one.high - one.low < 0.3


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x"), (None, "q")], "src string, dst string")
    s = spark.createDataFrame([("a", "a"), ("x", "x"), ("d", "d")], "seed string, node string")
    pairs = lambda df: {(r.seed, r.node) for r in df.collect()}
    assert pairs(graph.reachability(e, s)) == {("a", n) for n in "abcd"} | {("x", "x")}
    assert pairs(graph.reachability(e, s, 1)) == {("a", "b"), ("x", "x")}
    assert pairs(graph.reachability(e, s, 2, include_seeds=True)) == {("a", "a"), ("a", "b"), ("a", "c"), ("x", "x"), ("d", "d")}
    assert pairs(graph.reachability(e.limit(0), s)) == set()
    nodes = spark.createDataFrame([(n,) for n in "abcdz"], "node string")
    assert {r.node: r.n for r in graph.in_degree(nodes, e).collect()} == {"a": 1, "b": 1, "c": 1, "d": 1, "z": 0}


def test_risk_and_privacy(spark):
    df = spark.createDataFrame([(0, 0, 0, 0), (4, 0, 0, 0), (1, 3, 3, 2)], "f int, n int, r int, p int")
    pts = risk.score(F.col("f"), F.col("n"), F.col("r"), F.col("p"))
    assert [tuple(r) for r in df.select(pts, risk.severity(pts)).collect()] == [(0, "low"), (8, "moderate"), (23, "high")]
    names = ["email", "E_MAIL", "user_email", "first_name", "session_id", "ip", "notes", "created_at", None, "phone number", "age"]
    got = {r.name: (r.category, r.sensitivity) for r in privacy.classify(spark.createDataFrame([("t", n) for n in names], "tbl string, name string")).collect()}
    assert got["email"] == ("contact", "high") and got["user_email"] == ("non_personal", "none") and got["phone number"] == ("contact", "high")
    assert got["session_id"] == ("credentials", "medium") and got["age"] == ("demographic", "high") and got[None] == ("non_personal", "none")


def test_detection(spark):
    tables = spark.createDataFrame([("user",), ("order",)], "name string")
    cols = spark.createDataFrame([("user", "email"), ("order", "email"), ("order", "total")], "tbl string, name string")
    files = spark.createDataFrame([("src/api/pay.ts",)], "file string")
    texts = ["Change user.email now", "the order and ORDER", "only total here", "email", "see SRC/api/pay.ts please", "user_email nothing", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: (r.entity_type, r.entity_name) for r in detect.best_entity(df, tables, cols, files).collect()}
    assert got == {0: ("column", "user.email"), 1: ("table", "order"), 2: ("column", "order.total"), 3: ("column", "order.email"), 4: ("file", "src/api/pay.ts"), 5: ("unknown", ""), 6: ("unknown", "")}
    c = [(r.entity_name, r.score) for r in detect.candidates(df.where("id = 0"), tables, cols, files).orderBy("rank").collect()]
    assert c == [("user.email", 30), ("order.email", 15), ("user", 10)]
    assert {r.score for r in detect.candidates(df.where("id = 4"), tables, cols, files).collect()} == {8}


def test_file_candidates(spark, small):
    paths = ["src/api/pay-order.v2.ts", "src/Invoice.py", "src/db/7q4.sql", "a.c", "lib/.env", "src/modules/invoice.go", "x/page.ts"]
    texts = ["the PAY-ORDER.V2 job", "reinvoiced", "7q4 alone", "see mysrc/db/7q4.sql", "in a.c here", "the env", "src/invoice.py", "homepages", "", None]
    f = spark.createDataFrame([(p,) for p in paths], "file string")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    none = spark.createDataFrame([], "tbl string, name string")
    got = {(r.id, r.entity_name): r.score for r in detect.candidates(df, none.select("name"), none, f).collect()}
    want = {}
    for i, t in enumerate(texts):
        for p in paths:
            stem = p.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower()
            if t and p.lower() in t.lower():
                want[i, p] = 8
            elif t and len(stem) > 3 and stem in t.lower():
                want[i, p] = 3
    assert got == want and len(want) == 8
    assert governance.q14_candidates(spark, small).where("entity_type = 'file'").count() > 0


def test_retrieval(spark):
    q = spark.createDataFrame([("q", "src/user_list.ts"), ("r", "a.b")], "query string, name string")
    t = spark.createDataFrame([("1", "user user LIST"), ("2", "list"), ("3", "none"), ("4", "aab")], "id string, text string")
    got = {(r.query, r.id): r.score for r in retrieval.scores(q, t).collect()}
    assert got == {("q", "1"): 3, ("q", "2"): 1, ("r", "4"): 3}
    assert [(r.id, r.rank) for r in retrieval.top(retrieval.scores(q, t), 1).where("query = 'q'").collect()] == [("1", 1)]
    assert retrieval.ends(spark.range(300).toDF("n"), "n").count() == 120


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, title string, note string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", None)], "id int, title string, note string")
    assert {tuple(r) for r in dml.upsert_nodes(old, new, ["id"]).collect()} == {(1, "a", None), (2, "b", "y"), (3, "c", None)}
    e = spark.createDataFrame([("a", "b"), ("a", "z"), ("a", "b")], "src string, dst string")
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [tuple(r) for r in dml.upsert_edges(e.limit(0), e, ids, ids).collect()] == [("a", "b")]
    left, edges = dml.delete_cascade(ids, e, spark.createDataFrame([("z",)], "id string"))
    assert left.count() == 2 and edges.count() == 2
    assert dml.prune_stale(spark.createDataFrame([("t", "c")], "tbl string, name string"), ids.limit(0).select(F.col("id").alias("name")), "tbl").count() == 1
