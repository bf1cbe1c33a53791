from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.test_rules_gate import EVENTS, LOG, WANT
from tracewell.streaming import changes


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_token_stream(spark, tmp_path):
    spark.createDataFrame(LOG, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    got = {r.event_id: r.error for r in run(changes.consume_tokens(events, timeouts=False), "tokens").collect()}
    assert got == WANT


def test_bursts_and_dispatch(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("a", t), ("a", t + timedelta(seconds=1)), ("a", t + timedelta(seconds=5)), ("b", t), ("z", t + timedelta(days=1))]
    df = spark.createDataFrame(rows, "key string, ts timestamp")
    assert sorted((r.key, r.n) for r in changes.bursts(df).collect()) == [("a", 1), ("a", 2), ("b", 1), ("z", 1)]
    df.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")).withWatermark("ts", "1 second")
    assert sorted((r.key, r.n) for r in run(changes.bursts(stream), "bursts").collect())[:3] == [("a", 1), ("a", 2), ("b", 1)]
    p = spark.createDataFrame([("src/a.ts",), ("docs/r.md",), ("srcx/a",)], "path string")
    got = [r[0] for r in p.select(changes.dispatch(F.col("path"), {"code": ["src"], "requirement": ["docs/"]})).collect()]
    assert got == ["code", "requirement", "other"]


def test_apply_changes(spark, tmp_path):
    target = [str(tmp_path / "t0")]
    spark.createDataFrame([("a", "1"), ("b", "1")], "path string, content string").write.parquet(target[0])

    def write(df):
        nxt = str(tmp_path / f"t{len(target)}")
        df.write.mode("overwrite").parquet(nxt)
        target.append(nxt)

    f = changes.apply_changes(lambda: spark.read.parquet(target[-1]), write)
    batch = spark.createDataFrame([("./a", "modified", "2", 1, 0), ("a", "modified", "3", 2, 0), ("b", "deleted", None, 3, 0), ("c", "created", "1", 1, 0)], "path string, kind string, content string, ts int, seq int")
    for _ in range(2):  # a replay changes nothing
        f(batch, 0)
        assert {tuple(r) for r in spark.read.parquet(target[-1]).collect()} == {("a", "3"), ("c", "1")}


def test_rule_cache(spark):
    now, loads = [0.0], []
    cache = changes.RuleCache(lambda: (loads.append(1), spark.range(1))[1], 300, lambda: now[0])
    assert cache.get() is cache.get() and len(loads) == 1
    now[0] = 301
    cache.get()
    cache.invalidate()
    cache.get()
    assert len(loads) == 3
