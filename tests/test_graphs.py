import random

import numpy as np
from pyspark.sql import functions as F

from cuewright.functions.pixels import label_components
from cuewright.operators import frames, graphs, regions, tiles

TILES = "image int, row int, column int, top int, left int, height int, width int, mask binary, score binary"


def test_chains_in_log_rounds(spark, monkeypatch):
    rng, made = random.Random(1), []
    real = graphs.stored
    monkeypatch.setattr(graphs, "stored", lambda df, name: made.append(name) or real(df, name))
    names = rng.sample(range(10_000), 300)
    rows = [(names[i], names[i - 1] if i % 150 else names[i]) for i in range(300)] + [(20_000, 20_000)]
    found = graphs.roots(spark.createDataFrame(rows, "node long, up long"))
    assert {r.node: r.root for r in found.collect()} == {x: names[i // 150 * 150] for i, x in enumerate(names)} | {20_000: 20_000}
    assert len(made) <= 10
    assert graphs.roots(spark.createDataFrame([], "node long, up long")).collect() == []


def test_unions_of_paths_stars_and_nulls(spark):
    rng = random.Random(2)
    path = rng.sample(range(1000), 120)
    pairs = list(zip(path, path[1:])) + [(5000, 5000 + k) for k in range(1, 60)] + [(7000, 7001), (7001, 7000), (8000, 8000), (None, 3), (9001, None)]
    rng.shuffle(pairs)
    found = {r.node: r.root for r in graphs.unions(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {x: min(path) for x in path} | {5000 + k: 5000 for k in range(60)} | {7000: 7000, 7001: 7000, 8000: 8000, 9001: 9001, 3: found.get(3)}
    assert found == want
    assert graphs.unions(spark.createDataFrame([], "a long, b long")).collect() == []


def test_long_tracks_are_the_short_ones(spark):
    rng = random.Random(3)
    rows = [(v, seq, k) for v in (0, 1) for seq in range(40) for k in range(3) if rng.random() < 0.9]
    there = set(rows)
    edges = [(v, s, a, b) for v in (0, 1) for s in range(40) for a, b in zip(range(3), rng.sample(range(3), 3)) if (v, s + 1, b) in there and rng.random() < 0.9]
    r = spark.createDataFrame(rows, "v int, seq long, region_idx int")
    e = spark.createDataFrame(edges, "v int, seq long, src int, dst int")
    get = lambda df: sorted(map(tuple, df.select("v", "seq", "region_idx", "first_seq", "first_region").collect()))
    assert get(regions.long_tracks(r, e, ["v"])) == get(regions.tracks(r, e, ["v"]))


def cut(image, mask, score, height, width):
    rows, columns = [range(0, n, size) for n, size in zip(mask.shape, (height, width))]
    out = []
    for i, y in enumerate(rows):
        for j, x in enumerate(columns):
            m, s = mask[y : y + height, x : x + width], score[y : y + height, x : x + width]
            out.append((image, i, j, y, x, *m.shape, m.astype(np.uint8).tobytes(), s.astype("<f4").tobytes()))
    return out


def test_tiled_components_are_those_of_whole_images(spark):
    rng = np.random.default_rng(4)
    spiral = np.zeros((23, 23), bool)
    for k in range(0, 12, 4):  # one long thin component over all tiles
        spiral[k, k : 23 - k] = spiral[k : 23 - k, 22 - k] = spiral[22 - k, k : 23 - k] = spiral[k + 2 : 23 - k, k] = True
        spiral[k + 2, k : k + 3] = True
    images = [rng.random((17, 31)) < 0.6, rng.random((20, 9)) < 0.45, np.ones((9, 14), bool), np.zeros((5, 5), bool), spiral]
    rows, want = [], []
    for k, mask in enumerate(images):
        score = rng.random(mask.shape).astype("<f4")
        rows += cut(k, mask, score, 5, 4)
        labels = label_components(mask)
        for n in range(1, labels.max() + 1):
            ys, xs = np.nonzero(labels == n)
            want.append((k, (int(ys[0]) << 32) + int(xs[0]), len(ys), int(xs.min()), int(ys.min()), int(xs.max() - xs.min() + 1), int(ys.max() - ys.min() + 1), float(score[ys, xs].max())))
    found = tiles.components(spark.createDataFrame(rows, TILES).repartition(4), ["image"]).collect()
    assert sorted((r.image, r.first, r.area, r.x, r.y, r.width, r.height, r.peak) for r in found) == sorted(want)


def test_odd_tiles(spark):
    rows = [(None, 0, 0, 0, 0, 1, 2, b"\1\0", None), (1, 0, 0, 0, 0, 0, 0, b"", None), (2, 0, 0, 0, 0, 2, 2, None, None)]
    found = tiles.components(spark.createDataFrame(rows, TILES), ["image"]).collect()
    assert [(r.image, r.first, r.area, r.peak) for r in found] == [(None, 0, 1, None)]
    assert tiles.components(spark.createDataFrame([], TILES), ["image"]).collect() == []


def test_batches_without_events(spark):
    rows = spark.createDataFrame([(v, f // 4, f) for v in (1, None) for f in range(10)], "video_id int, batch_id long, frame_id long")
    events = spark.createDataFrame([(1, 0, 40, ["a"]), (1, 2, 360, ["b"]), (None, 1, 160, ["c"])], "video_id int, batch_id long, time_ms long, texts array<string>")
    get = lambda emit: sorted(map(repr, map(tuple, frames.with_empty_batches(events, rows, F.col("frame_id") * 40, emit).collect())))
    own = [(1, 40, ["a"]), (1, 360, ["b"]), (None, 160, ["c"])]
    assert get(False) == sorted(map(repr, own))
    assert get(True) == sorted(map(repr, own + [(1, 160, []), (None, 0, []), (None, 320, [])]))
