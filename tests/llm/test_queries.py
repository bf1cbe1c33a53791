from tracewell.llm import queries


def test_all_run_on_the_smallest_tables(spark, small):
    for name, f in queries.QUERIES.items():
        rows = f(spark, small).collect()
        assert rows, name
        if name.endswith("_found"):
            assert len(rows) == len({tuple(r) for r in rows}), name
