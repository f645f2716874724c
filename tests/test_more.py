import itertools
import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright import cli, streaming
from cuewright.functions import pixels as P
from cuewright.functions import text as T
from cuewright.operators import ctc, frames, neighbors, regions, segments
from cuewright.sources import flv, mp4, packets, sinks, tables


def test_union_find_and_the_rule_of_boxes(spark):
    assert regions.united(6, [(4, 5), (1, 4), (0, 2)]) == [0, 1, 0, 3, 1, 1]
    made = np.random.default_rng(1)
    boxes = [tuple(map(int, b)) for b in made.integers((0, 0, 5, 5), (30, 30, 40, 20), (40, 4))] + [(0, 0, 5, 10), (0, 3, 40, 10)]
    pairs = list(itertools.product(range(len(boxes)), repeat=2))
    kind = "i int, j int, a struct<x: int, y: int, width: int, height: int>, b struct<x: int, y: int, width: int, height: int>"
    from cuewright.functions import geometry as G

    rows = spark.createDataFrame([(i, j, boxes[i], boxes[j]) for i, j in pairs], kind).select("i", "j", G.can_merge(F.col("a"), F.col("b")).alias("m"))
    assert all(regions._mergeable(boxes[r.i], boxes[r.j]) == r.m for r in rows.collect())


def test_mp4_details_and_start_codes():
    sps, pps = b"\x67abc", b"\x68d"
    avcc = bytes([1, 100, 0, 31, 0xFF, 0xE1]) + struct.pack(">H", 4) + sps + bytes([1]) + struct.pack(">H", 2) + pps
    avc1 = bytes(6) + struct.pack(">H", 1) + bytes(16) + struct.pack(">2H", 640, 360) + bytes(12) + struct.pack(">H", 1) + bytes(32) + struct.pack(">H", 24) + b"\xff\xff" + mp4.write_atom("avcC", avcc)
    found = mp4.details("stsd", struct.pack(">II", 0, 1) + mp4.write_atom("avc1", avc1))["entries"]
    assert found == [("avc1", avc1)]
    one = mp4.details("avc1", avc1)
    assert (one["reference"], one["width"], one["height"], one["frames"], one["depth"], one["inner"]) == (1, 640, 360, 1, 24, [("avcC", avcc)])
    own = mp4.details("avcC", avcc)
    assert own == {"profile": 100, "level": 31, "length_size": 4, "sps": [sps], "pps": [pps]}
    assert mp4.details("hdlr", bytes(8) + b"vide" + bytes(12) + b"Handler\0")["handler"] == "vide"
    assert mp4.details("vmhd", struct.pack(">I4H", 1, 0, 1, 2, 3)) == {"mode": 0, "colour": (1, 2, 3)}
    assert mp4.annex_b(struct.pack(">I", 2) + b"xy" + struct.pack(">I", 1) + b"z", 4, [sps]) == b"\0\0\0\1" + sps + b"\0\0\0\1xy\0\0\0\1z"
    with pytest.raises(ValueError):
        mp4.annex_b(struct.pack(">I", 9) + b"xy", 4)
    with pytest.raises(ValueError):
        mp4.details("free", b"")


def test_packets_of_a_stream(spark, tmp_path):
    for name, n in (("a", 3), ("b", 2)):
        (tmp_path / f"{name}.flv").write_bytes(flv.write_tags([(9 if i % 2 else 8, i * 40, bytes([i])) for i in range(n)]))
    packets.register(spark)
    read = lambda stream: spark.read.format("flv").option("path", str(tmp_path)).option("stream", stream).load()
    assert sorted((r.video_id[-5:], r.seq, r.pts_ms, bytes(r.data)) for r in read("video").collect()) == [("a.flv", 1, 40, b"\1"), ("b.flv", 1, 40, b"\1")]
    assert read("all").count() == 5 and read("script").count() == 0


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "WEBVTT\n\n0\na\n\n"), (2, "WEBVTT\n\n")], "video_id long, vtt string")
    sinks.write_documents(docs, str(tmp_path / "out"))
    assert [p.read_text() for p in sorted((tmp_path / "out").glob("video_id=1/*.txt"))] == ["WEBVTT\n\n0\na\n\n"]
    got = docs.select(sinks.result(F.col("video_id"), F.col("vtt")).alias("r")).collect()
    assert json.loads(got[0].r) == {"unique_id": 1, "format": "vtt", "version": 7, "content": "WEBVTT\n\n0\na\n\n"}
    docs.write.parquet(str(tmp_path / "in"))
    log, seen = sinks.RunLog(str(tmp_path / "log")), []
    spark.streams.addListener(log)
    stream = streaming.file_stream(spark, str(tmp_path / "in"), docs.schema)
    streaming.poll(stream, lambda jobs: jobs.withColumn("status", F.lit("Done")), lambda done: seen.extend(done.collect()), str(tmp_path / "check")).awaitTermination()
    spark.streams.removeListener(log)
    assert sorted((r.video_id, r.status) for r in seen) == [(1, "Done"), (2, "Done")]


def test_command_line(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.flv").write_bytes(flv.write_tags([(9, 0, b"x"), (9, 40, b"y")]))
    cli.main(["join-flv", str(tmp_path / "a.flv"), str(tmp_path / "b.flv"), "--output", str(tmp_path / "all.flv")])
    assert [t for _, t, *_ in flv.read_tags((tmp_path / "all.flv").read_bytes())] == [0, 40, 40, 80]
    spark.createDataFrame([(1, 0, ["hello"]), (1, 5000, ["hello!"]), (1, 9000, [])], "video_id long, time_ms long, texts array<string>").write.parquet(str(tmp_path / "events"))
    cli.main(["cues", str(tmp_path / "events"), str(tmp_path / "vtt")])
    text, = [p.read_text() for p in (tmp_path / "vtt").glob("video_id=1/*.txt")]
    assert text == "WEBVTT\n\n0\n00:00:00.000 --> 00:00:09.000\nhello!\n\n" or text == "WEBVTT\n\n0\n00:00:00.000 --> 00:00:09.000\nhello\n\n"


def test_guards(spark):
    rows = spark.createDataFrame([("v", 1, 8, 8), ("v", 2, 8, 8), ("w", 1, 4, 4)], "video string, n int, width int, height int")
    assert frames.one_geometry(rows, ["video"], "n").count() == 3
    with pytest.raises(Exception, match="geometry"):
        frames.one_geometry(rows.union(spark.createDataFrame([("v", 3, 8, 9)], rows.schema)), ["video"], "n").collect()
    codes = spark.createDataFrame([("YUV420",), ("YUV444",)], "c string")
    assert spark.createDataFrame([("YUV420",)], "c string").select(P.only_nv12(F.col("c"))).first()[0] == "YUV420"
    with pytest.raises(Exception, match="NV12"):
        codes.select(P.only_nv12(F.col("c"))).collect()


def test_bilateral_against_its_sum():
    img = np.random.default_rng(3).integers(0, 256, (3, 6, 7), dtype=np.uint8)
    got = P.bilateral(img)
    at = lambda i, n: -i if i < 0 else 2 * n - 2 - i if i >= n else i
    for y, x in itertools.product(range(6), range(7)):
        top, total = np.zeros(3), 0.0
        for dy, dx in itertools.product(range(-2, 3), repeat=2):
            if dy * dy + dx * dx <= 4:
                near = img[:, at(y + dy, 6), at(x + dx, 7)].astype(float)
                colour = np.abs(near - img[:, y, x]).sum()
                k = math.exp(-(dy * dy + dx * dx) / (2 * 80.0**2) - colour**2 / (2 * 80.0**2))
                top, total = top + near * k, total + k
        assert (np.abs(got[:, y, x] - top / total) <= 1.001).all()


def test_preprocess_is_its_parts():
    nv12 = np.random.default_rng(5).integers(0, 256, 16 * 8 * 3 // 2, dtype=np.uint8)
    got = P.preprocess(nv12, 16, 8, 40)
    assert got.shape == (3, 32, 64) and not got[:, 20:].any() and not got[:, :, 40:].any()
    assert (got[:, :20, :40] == P.bilateral(P.nv12_to_rgb(nv12, 16, 8, 40, 20, 40, 20))).all()


def test_lattice_against_all_readings():
    made = np.random.default_rng(7)
    bigrams = {("a", "b"): 0.5, ("b", "a"): 0.2, ("a", "a"): 0.1, ("b", "c"): 0.4}
    cost = lambda p: -math.log(max(p, 1e-30))
    for _ in range(60):
        steps = []
        for _ in range(made.integers(1, 6)):
            p = made.dirichlet(np.ones(4))
            steps.append(sorted(zip(["", "a", "b", "c"], map(float, p), strict=True), key=lambda c: -c[1])[: made.integers(1, 4)])
        columns = []
        for step in steps:
            if step[0][0] == "" and step[0][1] >= 0.9 or columns and columns[-1][0][0] == step[0][0]:
                continue
            columns.append(step[:1] if step[0][1] >= 0.9 else step)

        def total(path):
            sum_, last, text = 0.0, "", ""
            for ch, p in path:
                if ch == "":
                    sum_ += 10 * cost(p)
                else:
                    pair = bigrams.get((last, ch)) if last else 1.0
                    sum_ += cost(p) + (cost(pair) if pair else ctc.MISSING_COST)
                    last, text = ch, text + ch
            return sum_, text

        best = min(total(path) for path in itertools.product(*columns))
        got = ctc.best_path(steps, bigrams)
        assert min(s for s, t in map(total, itertools.product(*columns)) if t == got) == pytest.approx(best[0])


def test_neighbours_in_blocks(spark):
    made = np.random.default_rng(9).normal(size=(60, 5))
    made[7] = made[8]
    made[9] = 0
    rows = spark.createDataFrame([(i, v.tolist() if i != 5 else None) for i, v in enumerate(made)], "id long, v array<double>")
    unit = made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-300)
    whole = {}
    for i in (0, 7, 20):
        order = sorted((j for j in range(60) if j not in (i, 5, 9)), key=lambda j: (-round(float(unit[i] @ unit[j]), 12), j))
        whole[i] = order[:4]
    for block in (7, 1000):
        got = neighbors.top_cosine(rows, rows.where("id in (0, 5, 7, 9, 20)"), 4, block).orderBy("query", "rank").collect()
        assert {i: [r.neighbour for r in got if r.query == i] for i in whole} == whole and {r.query for r in got} == set(whole)


def test_names_and_text(spark):
    row = spark.createDataFrame([("clip-1_a.flv", "clip-1_b.flv", "é😀x", "b ", "")], "a string, b string, t string, i string, e string")
    got = row.select(T.joined_name(F.col("a"), F.col("b"), F.lit("flv")).alias("n"), T.joined_name(F.col("a"), F.col("t"), F.lit("flv")).alias("o"), T.code_points(F.col("t")).alias("p"), T.from_utf32(T.to_utf32(F.col("t"))).alias("u"), T.first_ignored(F.col("i")).alias("f"), T.first_ignored(F.col("t")).alias("g"), T.common_prefix(F.col("e"), F.col("a")).alias("c")).first()
    assert (got.n, got.o, got.p, got.u, got.f, got.g, got.c) == ("clip-1.flv", "output.flv", [0xE9, 0x1F600, 0x78], "é😀x", 1, None, "")


def test_late_events_wait_for_the_watermark(spark, tmp_path):
    schema = "video_id long, time_ms long, texts array<string>"
    batches = [[(1, 3000, ["c"]), (1, 1000, ["a"])], [(1, 2000, ["b"]), (2, 500, ["x"])], [(1, 100_000, [])], [(2, 90_000, [])], [(1, 1500, ["too late"]), (3, 500_000, [])], [(3, 600_000, [])]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = streaming.run_to_files(streaming.late_segments(streaming.file_stream(spark, str(tmp_path / "in"), schema), "30 seconds")).where("video_id < 3")
    assert sorted((r.video_id, r.start_ms, r.end_ms, tuple(r.texts)) for r in got.collect()) == [(1, 0, 1000, ()), (1, 1000, 2000, ("a",)), (1, 2000, 3000, ("b",)), (1, 3000, 100_000, ("c",)), (2, 0, 500, ()), (2, 500, 90_000, ("x",))]


def test_requeue_and_upsert(spark):
    jobs = spark.createDataFrame([("a", "Processing", "w1", 1), ("b", "Done", "w1", 1), ("c", "Processing", "w2", 1)], "job string, status string, worker_id string, at int")
    back = tables.requeued(jobs, "w1", F.lit(9))
    got = {r.job: (r.status, r.worker_id) for r in tables.upserted(jobs, back, "job", "at").collect()}
    assert got == {"a": ("Queuing", None), "b": ("Done", "w1"), "c": ("Processing", "w2")}


def test_distance_against_its_table():
    made = np.random.default_rng(11)
    for _ in range(400):
        a, b = ("".join(made.choice(list("abé"), made.integers(0, 12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        assert segments.distance(a, b) == row[-1]
