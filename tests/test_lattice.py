import random

from pyspark.sql import functions as F

from cuewright.operators import ctc

STEPS = "region long, steps array<array<struct<ch: string, p: double>>>"


def test_fold_reads_what_the_paths_read(spark):
    rng = random.Random(6)
    bigrams = {(a, b): rng.random() for a in "abcde" for b in "abcde" if rng.random() < 0.6}
    rows = []
    for region in range(60):
        steps = []
        for _ in range(rng.randrange(0, 12)):
            p = sorted((rng.random() for _ in range(rng.choice((1, 2, 4)))), reverse=True)
            steps.append(list(zip(rng.sample(["", *"abcde"], len(p)), p)))
        rows.append((region if region else None, steps))
    rows.append((99, None))
    want = sorted(((r, ctc.best_path(s or [], bigrams)) for r, s in rows), key=repr)
    df = spark.createDataFrame(rows, STEPS).repartition(3)
    table = spark.createDataFrame([(a, b, p) for (a, b), p in bigrams.items()] + [("x", "y", 0.5)], "a string, b string, p double")
    for given in (bigrams, table):
        assert sorted(map(tuple, ctc.lattice_decode(df, given).collect()), key=repr) == want
    assert ctc.lattice_decode(df.where(F.lit(False)), table).collect() == []


def test_no_python_is_run(spark):
    df = spark.createDataFrame([(1, [[("a", 0.5)]])], STEPS)
    table = spark.createDataFrame([("a", "b", 0.5)], "a string, b string, p double")
    plan = ctc.lattice_decode(df, table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
