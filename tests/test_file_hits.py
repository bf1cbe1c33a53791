from tracewell.operators import detect


def test_file_hits_in_long_runs_and_with_white_space(spark):
    files = ["src/a/run_x1.py", "src/b/My File.ts", "src/c/zz.go", "src/d/été-9.py"]
    texts = ["see src/a/run_x1.py.", "x" * 5000 + "run_x1" + "y" * 5000, "MY FILE or src/c/zz.go", "zz", "(src/b/my file.ts)", "aété-9b", "a" * 14 + "src/a/run_x1.py"]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = set()
    for i, x in enumerate(texts):
        for f in files:
            stem = f.rsplit("/")[-1].lower().rsplit(".", 1)[0]
            score = 8 if f.lower() in x.lower() else 3 if len(stem) > 3 and stem in x.lower() else 0
            want |= {(i, f, score)} if score else set()
    got = detect.file_hits(t, spark.createDataFrame([(f,) for f in files], "file string")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
