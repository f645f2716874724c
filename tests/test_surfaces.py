"""Surfaces of all layouts, a detector's input as a job, and models that workers keep."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.functions import pixels as P
from cuewright.functions import surfaces as S
from cuewright.operators import models, surfaces


def plain_rgb(y, u, v, bits, standard):
    """One pixel, by the definition."""
    red, blue, black, white, most = S.STANDARDS[standard]
    scale, low, mid = most / (white - black), 1 << bits - 4, 1 << bits - 1
    y, u, v = y - low, u - mid, v - mid
    r, b = scale * (y + 2 * (1 - red) * v), scale * (y + 2 * (1 - blue) * u)
    g = (scale * y - red * r - blue * b) / (1 - red - blue)
    return [min(max(x, 0), (1 << bits) - 1) for x in (r, g, b)]


@pytest.mark.parametrize(("layout", "standard"), [*itertools.product(S.LAYOUTS, ["BT709", "BT601"]), ("P016", "BT2020"), ("YUV444P16", "BT2020")])
def test_rgb_of_each_pixel(layout, standard):
    size, quarter = S.LAYOUTS[layout]
    data = np.random.default_rng(3).integers(0, 256, S.length(layout, 6, 4), dtype=np.uint8).tobytes()
    samples = np.frombuffer(data, "<u2" if size == 2 else "u1").astype(int)
    got = S.to_rgb(S.planes(data, layout, 6, 4), standard, size)
    for y, x in itertools.product(range(4), range(6)):
        at = [24 + (y // 2 * 3 + x // 2) * 2 + k for k in (0, 1)] if quarter else [24 + y * 6 + x, 48 + y * 6 + x]
        want = plain_rgb(samples[y * 6 + x], *samples[at], 8 * size, standard)
        assert np.abs(got[:, y, x] - np.array(want)).max() < 1.001
    low = S.to_rgb(S.planes(data, layout, 6, 4), standard, 1)
    assert (low == (got >> 8 if size == 2 else got)).all()


def test_there_and_back():
    made = np.random.default_rng(4)
    rgb = made.integers(0, 65536, (3, 4, 6)).astype("<u2")
    again = S.to_rgb(S.planes(S.surface(S.from_rgb(rgb, "BT2020"), "YUV444P16"), "YUV444P16", 6, 4), "BT2020", 2)
    assert np.abs(again.astype(int) - rgb).max() <= 4
    flat = np.broadcast_to(np.array([9000, 40000, 20000], "<u2").reshape(3, 1, 1), (3, 4, 6))
    again = S.to_rgb(S.planes(S.surface(S.from_rgb(flat), "P016"), "P016", 6, 4), size=2)
    assert np.abs(again.astype(int) - flat).max() <= 4
    assert S.pixels(rgb, "bgra")[:8] == np.array([rgb[2, 0, 0], rgb[1, 0, 0], rgb[0, 0, 0], 0], "<u2").tobytes()
    assert S.pixels(rgb, "rgba")[8:16] == np.array([*rgb[:, 0, 1], 0], "<u2").tobytes()


def test_frames_of_all_layouts_as_rows(spark):
    made = np.random.default_rng(5)
    rows = [(i, layout, 6, 4, made.integers(0, 256, S.length(layout, 6, 4), dtype=np.uint8).tobytes()) for i, layout in enumerate(S.LAYOUTS)]
    kind = "id long, layout string, width int, height int, surface binary"
    frames = spark.createDataFrame([*rows, rows[0], (9, "NV12", 6, 4, None)], kind)
    got = [(r.id, r.px) for r in surfaces.to_rgb(frames, ["id"]).collect()]
    want = {r[0]: S.to_rgb(S.planes(r[4], r[1], 6, 4)).tobytes() for r in rows}
    assert sorted(got, key=str) == sorted([*want.items(), (0, want[0]), (9, None)], key=str)
    assert surfaces.to_rgb(frames.limit(0), ["id"]).count() == 0
    back = surfaces.from_rgb(surfaces.to_rgb(frames, ["id", "width", "height"], bits=16), ["id"], "P016")
    assert {len(r.surface) for r in back.where("surface is not null").collect()} == {S.length("P016", 6, 4)}
    with pytest.raises(Exception, match="not a .* surface of 8 x 4"):
        surfaces.to_rgb(frames.withColumn("width", F.lit(8)), ["id"]).collect()


def test_preprocessing_as_rows(spark):
    nv12 = np.random.default_rng(6).integers(0, 256, 16 * 8 * 3 // 2, dtype=np.uint8)
    frames = spark.createDataFrame([(1, 16, 8, nv12.tobytes()), (2, 16, 8, None)], "id long, width int, height int, surface binary")
    got = {r.id: r for r in surfaces.preprocessed(frames, ["id"], 40).collect()}
    want = P.preprocess(nv12, 16, 8, 40)
    assert (got[1].height, got[1].width, got[1].px) == (32, 64, want.tobytes())
    assert (got[2].height, got[2].width, got[2].px) == (None, None, None)


def test_one_load_a_worker_and_one_padded_batch_a_shape(spark, tmp_path):
    (tmp_path / "weights-a.txt").write_text("3")
    loads, padded = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def make(path):
        loads.add(1)
        factor = float(open(path).read())

        def of(x):
            if not x[-1].any():
                padded.add(1)
            return x[:, 0] * factor, x[:, 1]

        return of

    load = models.shipped(spark, str(tmp_path / "weights-a.txt"), make)
    # shapes in turn, 101 rows each of 3 shapes in one partition, Arrow batches of 7 rows
    rows = spark.range(303).coalesce(1).selectExpr("id", "cast(id % 3 + 1 as int) as height", "cast(2 as int) as width").withColumn("px", F.array_repeat((F.col("id") + 1).cast("float"), F.col("height") * 6))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = models.detect(rows, ["id", "height"], load, 8)
        for _ in range(3):
            got = {r.id: r for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert all(r.text == [3.0 * (i + 1)] * r.height * 2 and r.link == [i + 1.0] * r.height * 2 for i, r in got.items()) and len(got) == 303
    assert padded.value == 3 * 3
    assert 1 <= loads.value <= 3  # one task a run; Spark may have given it another worker


def test_models_that_a_worker_keeps():
    models._kept.clear()
    made = []
    for key in ["a", "b", "a", "c", "d", "a", "e", "b"]:
        assert models.kept(key, lambda k=key: made.append(k) or (lambda x: (x, k)))(0) == (0, key)
    assert made == ["a", "b", "c", "d", "e", "b"] and list(models._kept) == ["d", "a", "e", "b"]
    models._kept.clear()
