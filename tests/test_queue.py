import json

import pytest
from pyspark.sql import functions as F

from cuewright.sources import queue


def put(spark, folder, name, ids):
    queue.enqueue(spark.createDataFrame([(i, f"u{i}") for i in ids], "unique_id long, url string"), folder, name, "unique_id")


def run(spark, tmp_path, limit=20, fail=False):
    def work(rows):
        return rows.withColumn("n", F.raise_error(F.lit("lost")).cast("int") if fail else F.lit(1))

    jobs = queue.stream(spark, f"file://{tmp_path}/queue", f"file://{tmp_path}/log", limit)
    queue.serve(jobs, work, f"file://{tmp_path}/done", f"file://{tmp_path}/log").awaitTermination()


def done(spark, tmp_path):
    rows = spark.read.parquet(f"{tmp_path}/done").collect()
    return sorted((r.batch, int(r.unique_id)) for r in rows)


def test_runs_take_up_where_the_last_ended(spark, tmp_path):
    put(spark, f"file://{tmp_path}/queue", "0", range(30))
    run(spark, tmp_path)
    assert done(spark, tmp_path) == [(0, i) for i in range(20)]
    put(spark, f"file://{tmp_path}/queue", "1", range(30, 37))
    for _ in range(3):
        run(spark, tmp_path)
    assert done(spark, tmp_path) == [(0, i) for i in range(20)] + [(1, i) for i in range(20, 37)]
    put(spark, f"file://{tmp_path}/queue", "2", [99])
    run(spark, tmp_path)
    assert [i for _, i in done(spark, tmp_path)] == [*range(37), 99]


def test_a_failed_batch_is_run_again_and_no_job_twice(spark, tmp_path):
    put(spark, f"file://{tmp_path}/queue", "0", range(25))
    run(spark, tmp_path, limit=10)
    with pytest.raises(Exception, match="lost"):
        run(spark, tmp_path, limit=10, fail=True)
    put(spark, f"file://{tmp_path}/queue", "1", range(25, 40))
    run(spark, tmp_path, limit=10)
    for _ in range(3):
        run(spark, tmp_path, limit=10)
    assert [i for _, i in done(spark, tmp_path)] == list(range(40))


def test_offsets_of_a_reader(spark, tmp_path):
    options = {"path": f"file://{tmp_path}/queue", "checkpoint": f"file://{tmp_path}/log", "limit": "7"}
    reader = queue.Reader(options)
    assert reader.latestOffset() == reader.initialOffset()  # no queue yet
    put(spark, options["path"], "a", range(12))
    (tmp_path / "queue/b").mkdir()
    for f in (tmp_path / "queue/a").glob("*.parquet"):
        (tmp_path / "queue/b" / f.name).write_bytes(f.read_bytes())  # not yet whole
    seen, at = [], reader.initialOffset()
    for _ in range(4):
        end = queue.Reader(options).latestOffset()  # as after a restart
        parts = reader.partitions(at, end)
        again = reader.partitions(at, end)
        assert parts == again and sum(p.last - p.first for p in parts) <= 7
        seen += [int(row[0]) for p in parts for row in reader.read(p)]
        at = end
    assert seen == list(range(12)) and json.loads((tmp_path / "log/admitted.json").read_text()) == at


def test_the_queue_in_ticks(spark, tmp_path):
    put(spark, f"file://{tmp_path}/queue", "0", range(33))
    jobs = queue.stream(spark, f"file://{tmp_path}/queue", f"file://{tmp_path}/log", 10)
    serving = queue.serve(jobs, lambda rows: rows, f"file://{tmp_path}/done", f"file://{tmp_path}/log", seconds=1)
    serving.processAllAvailable()
    serving.stop()
    assert done(spark, tmp_path) == [(i // 10, i) for i in range(33)]
