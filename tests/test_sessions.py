import random

import numpy as np
from pyspark.sql import functions as F

from cuewright import streaming
from cuewright.operators import segments as S
from cuewright.streaming import sessions

SCHEMA = "video_id long, time_ms long, texts array<string>"


def put(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def held(df):
    return sorted((r.video_id, r.start_ms, r.end_ms, list(r.texts)) for r in df.collect() if r.video_id is not None and r.video_id >= 0)


def many(rng, videos, n):
    lines = ["one two three", "one two threes", "something else", "something else!", " ", "third"]
    return [(v, t * 50 + rng.randrange(50), rng.sample(lines, rng.randrange(3))) for v in range(videos) for t in range(1, n)]


def test_many_batches_equal_one_table_and_a_restart_repeats_nothing(spark, tmp_path):
    rng = random.Random(4)
    rows = many(rng, 3, 60)
    end = [(v, 50 * 60 + 10, None) for v in range(3)]
    every = sorted(rows + end, key=lambda r: r[1] // 400 + rng.random() * 0.9)  # out of order by less than a second
    folder, path = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    stream = lambda: sessions.islands(streaming.file_stream(spark, folder, SCHEMA), "1 second")
    cut = len(every) // 2
    for part in (every[:cut], every[cut:] + [(-1, 10**6, []), (-1, 2 * 10**6, [])]):
        step = len(part) // 4 + 1
        for i in range(0, len(part), step):
            put(spark, part[i : i + step], folder)
        found = streaming.run_to_files(stream(), path, sessions.CONF)
    put(spark, [(-1, 3 * 10**6, [])], folder)
    found = streaming.run_to_files(stream(), path, sessions.CONF)
    batch = spark.createDataFrame(rows + [(v, t, []) for v, t, _ in end], SCHEMA)
    assert held(found) == held(S.merge(S.segments(batch)))


def test_idle_videos_end_by_a_timer_and_late_events_are_dropped(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    put(spark, [(1, 1000, ["a line"]), (1, 1500, ["a line"]), (2, 1200, ["other"])], folder)
    put(spark, [(3, 60_000, ["x"])], folder)
    put(spark, [(-1, 61_000, [])], folder)  # lateness is judged by the watermark of the batch before
    put(spark, [(1, 1100, ["too late"]), (3, 120_000, ["y"])], folder)
    put(spark, [(-1, 10**6, [])], folder)
    put(spark, [(-1, 10**7, [])], folder)
    found = streaming.run_to_files(sessions.islands(streaming.file_stream(spark, folder, SCHEMA), "1 second", idle_ms=5000), conf=sessions.CONF)
    said = [(1, 0, 1000, []), (1, 1000, 6500, ["a line"]), (2, 0, 1200, []), (2, 1200, 6200, ["other"]), (3, 0, 60_000, []), (3, 0, 120_000, []), (3, 60_000, 65_000, ["x"]), (3, 120_000, 125_000, ["y"])]
    assert held(found) == said


def test_sums_of_a_long_island_are_kept_short(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/in"
    rows = [(1, t, ["same text", "below it"]) for t in range(10, 1500)] + [(1, 1500, None)]
    for i in range(0, len(rows), 400):
        put(spark, rows[i : i + 400], folder)
    put(spark, [(-1, 10**6, [])], folder)
    put(spark, [(-1, 10**7, [])], folder)
    found = streaming.run_to_files(sessions.islands(streaming.file_stream(spark, folder, SCHEMA), "1 second"), conf=sessions.CONF)
    assert held(found) == [(1, 0, 10, []), (1, 10, 1500, ["same text", "below it"])]


def test_no_events(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    found = streaming.run_to_files(sessions.islands(streaming.file_stream(spark, f"file://{tmp_path}/in", SCHEMA), "1 second"), conf=sessions.CONF)
    assert found.where(F.lit(True)).collect() == []


def test_segments_of_late_events_by_slices(spark, tmp_path):
    """Events in any order within the delay, over restarts, equal the plain segments."""
    made = np.random.default_rng(12)
    schema, late = "video_id long, time_ms long, texts array<string>", 4000
    times = [(v, int(t)) for v in range(3) for t in np.sort(made.integers(0, 40_000, 60))]
    texts = {(v, t, i): [f"{v}-{t}-{i}"] for i, (v, t) in enumerate(times)}
    batch = {k: int((k[1] + made.integers(0, 1500)) // 2000) for k in texts}
    source = lambda: streaming.file_stream(spark, str(tmp_path / "in"), schema, max_files=9)
    path = str(tmp_path / "run")
    for n in range(max(batch.values()) + 1):
        rows = [(v, t, texts[v, t, i]) for (v, t, i), b in batch.items() if b == n]
        if n == 15:
            rows.append((1, 100, ["too late"]))
        spark.createDataFrame([rows[i] for i in made.permutation(len(rows))], schema).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        if n % 5 == 4:
            streaming.run_to_files(sessions.segments(source(), late), path, sessions.CONF)
    for k in (1, 2):
        spark.createDataFrame([(9, 10**6 * k, [])], schema).write.mode("append").parquet(str(tmp_path / "in"))
        found = streaming.run_to_files(sessions.segments(source(), late), path, sessions.CONF)
    want = []
    for v in range(3):
        at, said = 0, []
        for t, x in sorted((t, x) for (w, t, _), x in texts.items() if w == v):
            want.append((v, at, t, tuple(said)))
            at, said = t, x
    assert sorted((r.video_id, r.start_ms, r.end_ms, tuple(r.texts)) for r in found.where("video_id < 9").collect()) == sorted(want)
