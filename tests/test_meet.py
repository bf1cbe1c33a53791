from pyspark.sql import functions as F

from tracewell.operators import governance
from tracewell.operators.meet import placed, shared


def test_shared_gives_each_pair_once_without_distinct(spark):
    a = [(i, w) for i, ws in enumerate(["x y z", "y z", "q", "x x", "z"]) for w in ws.split()]
    b = [(i, w) for i, ws in enumerate(["z y", "x", "x y z q", "n"]) for w in ws.split()]
    left, right = spark.createDataFrame(a, "a int, word string"), spark.createDataFrame(b, "b int, word string")
    got = sorted((r.a, r.b) for r in shared(placed(left, "a"), placed(right, "b")).collect())
    assert got == sorted({(i, j) for i, v in a for j, w in b if v == w})


def test_shared_where_hashed_bits_collide(spark):
    """With far more than 64 names the bits say nothing, and the names themselves decide."""
    names = [f"n{i}" for i in range(200)]
    left = spark.createDataFrame([(k, w) for k in range(3) for w in names[k:]], "a int, word string")
    right = spark.createDataFrame([(k, w) for k in range(3) for w in names[: 200 - k]], "b int, word string")
    assert sorted(map(tuple, shared(placed(left, "a"), placed(right, "b")).collect())) == [(i, j) for i in range(3) for j in range(3)]


def test_impact_counts_are_those_of_the_blast_radius(spark, small):
    g = governance.build(spark, small)
    col = F.concat_ws(".", "tbl", "name")
    entities = g.tables.select(F.lit("table").alias("entity_type"), F.col("name").alias("entity")).union(g.columns.select(F.lit("column"), col)).union(g.files.select(F.lit("file"), "file")).distinct()
    per = governance.blast_radius(g, entities).groupBy("entity_type", "entity").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))
    want = {(r.entity_type, r.entity): (r.n, r.files) for r in per.collect()}
    for r in governance.impact(g, entities).collect():
        assert (r.direct_files + r.transitive_files + r.calling_files, r.affected_files) == want.get((r.entity_type, r.entity), (0, 0))


def test_traces_and_burdens_form_no_pairs_to_be_made_distinct(spark, small):
    """Counts and lists of files and requirements pass no exchange that has a file and a requirement."""
    g = governance.build(spark, small)
    pairs = shared(placed(g._mentions, "file"), placed(g._ruled, "req"))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("\n")[0].startswith("Project") and "Distinct" not in plan
    used = g._mentions.join(g._ruled, "word").select("file", "req").distinct().groupBy("file").agg(F.count("*").alias("n"))
    assert {(r.file, r.requirements) for r in governance.file_burden(g).collect()} == {(r.file, r.n) for r in used.collect()}
