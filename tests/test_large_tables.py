"""What only large tables or rare rows show."""

from datetime import datetime
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from cuewright.functions import pixels as P
from cuewright.operators import regions
from cuewright.operators.assign import assign, assign_all
from cuewright.plans import media as made
from cuewright.sources import flv, media, mp4
from cuewright.streaming import sessions


def against_sql(spark, folder, name, table, rows):
    """Rows of a query over ``rows`` as a table, and those of its SQL."""
    rows.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    got = entry.queries()[name](spark, str(folder))
    with duckdb.connect() as c:
        c.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
        want = c.execute(f"select {', '.join(f'\"{x}\"' for x in got.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp_ntz"


def test_a_component_as_large_as_the_map_is_a_row(spark, tmp_path):
    places = [(1, 0, 0), (1, 299, 149), (1, 7, 9), (2, 3, 3), (2, 5, 4), (2, 4, 5)]
    rows = [(k, x, y, i, 1.0, 1.0, 0.1, datetime(2024, 1, 1)) for i, (k, x, y) in enumerate(places)]
    got, want = against_sql(spark, tmp_path, "component_boxes", "lineitem", spark.createDataFrame(rows, LINES))
    assert got == want and len(got) == 2
    px = spark.createDataFrame([(1, 0, x, y, 1.0) for x in range(4) for y in range(4)], "k int, label int, x int, y int, score float")
    assert regions.component_boxes(px, ["k"], 4, 4).count() == 0


def test_probabilities_that_are_equal_as_floats_tie(spark, tmp_path):
    """In doubles b is a little above c, as floats both are 0.6019014120101929."""
    one = [0.0] * 64
    one[1:4] = [-0.9, 0.20380283892154694, 0.20380282402038574]
    one[4:8] = [-0.9, 0.9, -0.9, -0.9]
    for k in range(2, 16):
        one[4 * k] = 1.0
    made = np.random.default_rng(3).uniform(-1, 1, (40, 64)).astype(np.float32)
    rows = [(0, [float(np.float32(x)) for x in one])] + [(i + 1, [float(x) for x in v]) for i, v in enumerate(made)]
    assert np.float32(one[2]) > np.float32(one[3]) and np.float32(one[2]) + np.float32(1) == np.float32(one[3]) + np.float32(1)
    got, want = against_sql(spark, tmp_path, "lattice_decode", "embeddings", spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert got == want and dict(got)[0] == "ca"


def test_a_blur_in_doubles_does_not_depend_on_numpys_exp(monkeypatch):
    """Some processors' exp() is off by a last bit, and a whole mean is cut off."""
    images = [np.random.default_rng(i).integers(0, 256, (3, 9, 7)).astype(np.uint8) for i in range(20)] + [np.full((3, 9, 7), v, np.uint8) for v in range(1, 256, 7)]
    want = [P.bilateral(x, kind=np.float64) for x in images]
    monkeypatch.setattr(np, "exp", lambda x, f=np.exp: np.nextafter(f(x), 0) if np.ndim(x) else f(x))
    assert all((a == P.bilateral(x, kind=np.float64)).all() for a, x in zip(want, images, strict=True))


class Held:
    """A state of transformWithState, without Spark."""

    def __init__(self):
        self.states, self.timers = {}, set()

    def state(self, name, *_):
        return self.states.setdefault(name, State())

    getMapState = getValueState = getListState = state

    def registerTimer(self, at):
        self.timers.add(at)


class State(dict):
    def exists(self):
        return bool(self)

    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.pop

    def get(self):
        return self["own"]

    def update(self, x):
        self["own"] = x

    put = update


@pytest.mark.parametrize("kind", ["segments", "islands"])
def test_videos_of_a_lane_share_a_state(kind):
    """A batch of many videos reads and writes some states a lane, not some a video."""
    made = sessions.Segments(100) if kind == "segments" else sessions.Islands(0.8, None, 100)
    made.init(handle := Held())
    rows = pd.DataFrame([(v, v == 0, t, [f"{v} at {t}"] * (v != 2), [f"{v}at{t}"] * (v != 2)) for v in range(40) for t in (70, 10, 180)], columns=["video_id", "unnamed", "time_ms", "texts", "filtered"])
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 200)
    out = list(made.handleInputRows((5,), iter([rows]), clock))
    assert len(handle.timers) <= 2 and sum(map(len, handle.states.values())) <= 2
    for at in sorted(handle.timers):
        out += made.handleExpiredTimer((5,), clock, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))
    got = pd.concat(out)
    spans = {v: list(zip(x["start_ms"], x["end_ms"])) for v, x in got.fillna({"video_id": -1}).groupby("video_id")}
    whole = [(0, 10), (10, 70), (70, 180)]
    assert set(spans) | {2} == {-1, *range(1, 40)} and all(x == (whole if kind == "segments" else whole[:1]) for v, x in spans.items() if v != 2)


def test_many_splits_are_few_partitions(spark, tmp_path, monkeypatch):
    """Partitions don't grow with the splits of an index, and each reads a file's tables once."""
    rows = pd.DataFrame({"o_orderkey": range(1, 401), "o_orderpriority": [f"text {i}" for i in range(400)]})
    for name in "ab":
        made.put(f"file://{tmp_path}/in/{name}.mp4", made.mp4_of(rows))
    index = media.write_index(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/index", split=100)
    splits = spark.read.parquet(index).count()
    runs = media.Reader({"index": index, "parts": "4"}).partitions()
    assert splits > 60 and len(runs) <= 5 and sum(len(r.splits) for r in runs) == splits
    times, tracks = [], media.tracks
    monkeypatch.setattr(media, "tracks", lambda file: times.append(1) or tracks(file))
    got = [x for r in runs for x in media.Reader({"index": index, "parts": "4"}).read(r)]
    assert len(times) <= len(runs) + 1 and len(got) == 800
    assert sorted(x[4].decode() for x in got) == sorted([f"text {i}" for i in range(400)] * 2)
    assert len(media.Reader({"index": index}).partitions()) == splits


def test_tags_and_atoms_of_many_small_files_come_in_few_tables():
    files = pd.DataFrame({"path": [str(i) for i in range(300)], "content": [flv.write_tags([(9, 0, b"a"), (8, 40, b"b")])] * 300})

    class Caught:
        def select(self, *names):
            return self

        def mapInPandas(self, of, schema):
            return list(of(iter([files])))

    tables = flv.tag_rows(Caught())
    assert len(tables) == 1 and len(tables[0]) == 600 and list(tables[0]["seq"][:4]) == [0, 1, 0, 1]
    files["content"] = [flv.write_tags([(9, 0, b"a"), (18, 0, b"m"), (8, 40, b"b")])] * 300
    tables = flv.tag_rows(Caught(), (18,))  # what isn't asked for leaves no task, and the others keep their numbers
    assert len(tables) == 1 and len(tables[0]) == 300 and set(tables[0]["seq"]) == {1} and set(tables[0]["data_type"]) == {18}
    files["content"] = [mp4.write_atom("moov", b"") + mp4.write_atom("mdat", b"x")] * 300
    tables = mp4.atom_rows(Caught())
    assert len(tables) == 1 and len(tables[0]) == 600


def test_tables_as_arrays_equal_rows():
    for kind, rows in (("stsz", [(3,), (4,)]), ("stsz", []), ("stts", [(1, 2), (3, 4)]), ("stsc", [(1, 2, 1)]), ("stco", []), ("co64", [(1 << 40,)]), ("stss", [(7,)])):
        body = mp4.write_table(kind, rows)[8:]
        assert [tuple(x) for x in mp4.table_array(kind, body).tolist()] == mp4.sample_table(kind, body) == rows
    with pytest.raises(ValueError):
        mp4.table_array("stts", mp4.write_table("stts", [(1, 2)])[8:-1])


def test_tracks_in_blocks_of_frames(spark):
    """A block is some frames of a video: chains across any number of blocks are followed."""
    rows = [(v, s, r) for v in (1, None) for s in range(-3, 21) for r in range(3) if (s, r) != (9, 2)]
    edges = [(v, s, r, (r + 1) % 3) for v, s, r in rows if (s + r) % 7] + [(1, 9, 2, 0)]
    b, e = spark.createDataFrame(rows, "v long, seq long, region_idx int"), spark.createDataFrame(edges, "v long, seq long, src int, dst int")
    up = {(v, s + 1, d): (v, s, r) for v, s, r, d in edges if (v, s, r) in set(rows)}

    def first(at):
        while at in up:
            at = up[at]
        return at

    want = {(*at, *first(at)[1:]) for at in rows}
    for block in (3, 8192):
        found = regions.tracks(b, e, ["v"], block)
        assert sorted({tuple(r) for r in found.collect()} ^ want, key=repr) == [] and found.count() == len(rows)
        assert found.dtypes == [("v", "bigint"), ("seq", "bigint"), ("region_idx", "int"), ("first_seq", "bigint"), ("first_region", "int")]


def test_frames_come_many_a_call_and_whole(spark, monkeypatch):
    """Frames over the borders of Arrow's batches and of calls, null keys, and a frame larger than a call."""
    draw = np.random.default_rng(5)
    boxes = [(k or None, *(int(x) for x in draw.integers(0, 90, 2)), *(int(x) for x in draw.integers(5, 40, 2))) for k in range(60) for _ in range(60 if k == 7 else k % 5)]
    calls, merged_frames = [], regions.merged_frames
    monkeypatch.setattr(regions, "merged_frames", lambda *a: calls.append(1) or merged_frames(*a))
    rows = spark.createDataFrame(boxes, "k long, x int, y int, width int, height int").coalesce(1)
    assert not [x for x in regions.merge_boxes(rows, ["k"])._jdf.queryExecution().executedPlan().toString().split("\n") if "collect_list" in x]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = regions.merge_boxes(rows, ["k"]).collect()
        costs = [(k, a, b, int(draw.integers(0, 4))) for k in range(30) for a in range(k % 4 + 1) for b in range(k % 3 + 1)]
        edges = regions.assignments(spark.createDataFrame(costs, "k int, src int, dst int, cost int"), ["k"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for k in {b[0] for b in boxes}:
        found = [b[1:] for b in boxes if b[0] == k]
        want += [(k, i, *b) for i, b in enumerate(regions.merged(regions.merged(found)))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    want = []
    for k in range(30):
        table = [[next(c[3] for c in costs if c[:3] == (k, a, b)) for b in range(k % 3 + 1)] for a in range(k % 4 + 1)]
        want += [(k, a, b, table[a][b]) for a, b in enumerate(assign(table)) if b >= 0]
    assert sorted(map(tuple, edges)) == sorted(want)


def test_frames_without_pairs_are_done_at_once(spark, monkeypatch):
    """Only frames of which boxes merged are looked at again, and rows are sorted by their key alone."""
    frames = [[(0, 0, 5, 5), (500, 200, 5, 5)]] * 50 + [[(0, 0, 20, 20), (500, 200, 5, 5), (1, 1, 5, 5)], [(1 << 30, 0, 9, 9), ((1 << 30) + 9, 1, 9, 9)], [(3, 3, 3, 3)]]
    boxes, frame = np.array(sum(frames, []), np.int64).T, np.repeat(np.arange(53), [len(x) for x in frames])
    seen, pairs_of = [], regions.pairs_of
    monkeypatch.setattr(regions, "pairs_of", lambda b, sizes: seen.append(b.shape[1]) or pairs_of(b, sizes))
    found, of = regions.merged_frames(boxes, frame, 2)
    assert seen == [106, 3]
    want = [(k, *b) for k, x in enumerate(frames) for b in regions.merged(regions.merged(x))]
    assert list(zip(of.tolist(), *found.tolist(), strict=True)) == want and len(want) == 104
    for kind, key in (("long", lambda k: k - 9 if k else None), ("string", str)):
        rows = spark.createDataFrame([(key(k), *b) for k, x in enumerate(frames) for b in x], f"k {kind}, x int, y int, width int, height int").repartition(3)
        merged = regions.merge_boxes(rows, ["k"])
        assert ("Window" in merged._jdf.queryExecution().executedPlan().toString()) == (kind == "string")
        assert sorted(((r.k, *r[2:]) for r in merged.collect()), key=repr) == sorted(((key(k), *b) for k, *b in want), key=repr)


def test_assignments_of_many_frames_equal_those_of_each():
    draw = np.random.default_rng(6)
    for n, m in [(a, b) for a in range(1, 6) for b in range(1, 6)]:
        for top in (2, 1000):
            costs = draw.integers(0, top, (40, n, m))
            assert assign_all(costs).tolist() == [assign(c) for c in costs.tolist()]
    with pytest.raises(ValueError, match="has no cost"):
        regions.edges_of(np.array([[0, 0, 1], [0, 1, 1], [1, 0, 1]]), np.zeros(3, np.int64))


def test_tracks_are_dealt_to_all_partitions(spark, monkeypatch):
    """Few bytes of a shuffle may be many rows to sort: they aren't packed into one task."""
    rows = spark.range(4000).selectExpr("id % 50 as v", "id div 50 as seq", "0 as region_idx").repartition(4)
    links = rows.where("seq < 79").selectExpr("v", "seq", "0 as src", "0 as dst")
    kept, stored = [], regions.stored
    monkeypatch.setattr(regions, "stored", lambda df, name: kept.append(df) or stored(df, name))
    assert regions.tracks(rows, links, ["v"]).where("first_seq = 0").count() == 4000
    assert kept[0].rdd.getNumPartitions() == 4
