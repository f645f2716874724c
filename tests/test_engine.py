import random
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright import streaming
from cuewright.functions import geometry as G
from cuewright.functions import pixels as P
from cuewright.functions import text as T
from cuewright.operators import ctc, models, regions
from cuewright.operators import segments as S
from cuewright.operators.assign import assign
from cuewright.plans import graphs, lines, long_videos, media, registry, sessions  # noqa: F401  each registers its queries
from cuewright.sources import flv, jobs, mp4, tables

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def box(*v):
    return G.box(*map(F.lit, v))


def norm(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "iu":
            df[c] = df[c].astype(float)
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "part", "lineitem", "orders", "embeddings", "documents", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert norm(registry.QUERIES[name](spark, SF).toPandas()) == norm(con.sql(registry.SQL[name]).df())


def test_geometry(spark):
    a = box(0, 0, 10, 10)
    got = one(spark, G.iou(a, a), G.iou(a, box(10, 0, 10, 10)), G.iou(a, box(12, 0, 10, 10)), G.crop(box(-5, 2, 20, 10), F.lit(100), F.lit(100)), G.inflate(box(10, 20, 40, 10), F.lit(300)))
    assert (got[0], round(got[1], 4), got[2]) == (1.0, 0.0582, 0.0)
    assert tuple(got[3]) == (0, 2, 20, 10) and tuple(got[4]) == (10, 30, 100, 40)
    assert tuple(one(spark, G.canvas(F.lit(1920), F.lit(1080)))[0]) == (640, 360, 640, 384)


def test_text(spark):
    got = one(spark, T.time_string(F.lit(3723004)), T.time_string(F.lit(360000000)), F.round(T.edit_ratio(F.lit("kitten"), F.lit("sitting")).cast("double"), 4), T.match_cost(F.lit(0.9).cast("float")), T.strip_ignored(F.lit("a, é。b")))
    assert got == ("01:02:03.004", "100:00:00.000", 0.7692, 100, "aéb")


def test_ctc(spark):
    steps = F.array(*map(F.lit, [0, 1, 1, 0, 1, 2, 2, 0]))
    assert one(spark, ctc.spelled(ctc.collapse(steps), "abc")) == ("aab",)
    assert ctc.best_path([[("a", 0.6), ("b", 0.4)], [("", 0.95)], [("b", 0.5), ("c", 0.5)]], {("a", "c"): 0.9, ("a", "b"): 0.1}) == "ac"


def test_assignment_is_optimal():
    r = random.Random(3)
    for _ in range(200):
        n, m = r.randint(1, 5), r.randint(1, 5)
        cost = [[r.randint(0, 9) for _ in range(m)] for _ in range(n)]
        got = assign(cost)
        assert sorted(j for j in got if j >= 0) == sorted(set(j for j in got if j >= 0)) and sum(j >= 0 for j in got) == min(n, m)
        rows, t = (cost, n) if n <= m else ([list(c) for c in zip(*cost)], m)
        best = min(sum(rows[i][p[i]] for i in range(t)) for p in permutations(range(max(n, m)), t))
        assert sum(cost[i][j] for i, j in enumerate(got) if j >= 0) == best


def test_merged_boxes():
    assert regions.merged([(0, 0, 10, 10), (12, 0, 10, 10), (100, 100, 5, 5)]) == [(0, 0, 22, 10), (100, 100, 5, 5)]


def test_multi_line_merge(spark):
    segs = spark.createDataFrame([(1, 0, 100, ["hello world", "second"]), (1, 100, 400, ["second", "hello worle"]), (1, 400, 450, ["other"]), (1, 450, 500, [])], S.SEGMENT)
    got = [tuple(r) for r in S.merge(segs).orderBy("start_ms").collect()]
    assert got == [(1, 0, 400, ["hello worle", "second"]), (1, 400, 450, ["other"]), (1, 450, 500, [])]
    assert [r.end_ms for r in S.long_enough(segs, 100).collect()] == [400]


def test_single_line_merge_is_the_same(spark):
    segs = S.segments(registry.events(spark, SF)).where("video_id < 5")
    assert sorted(map(str, S.merge(segs).collect())) == sorted(map(str, S.merge(segs, lines=False).collect()))


def test_streaming_segments(spark, tmp_path):
    ev = registry.events(spark, SF)
    ev.repartitionByRange(1, "time_ms").sortWithinPartitions("time_ms").write.parquet(str(tmp_path / "in"))
    stream = streaming.segments(streaming.file_stream(spark, str(tmp_path / "in"), ev.schema))
    got = streaming.run_available(stream, "segs", str(tmp_path / "check"))
    assert sorted(map(tuple, registry.flat(got).collect())) == sorted(map(tuple, registry.flat(S.segments(ev)).collect()))


def test_flv_round_trip(spark, tmp_path):
    meta = flv.amf_write("onMetaData") + flv.amf_write(flv.Mixed(duration=2.0, ok=True, name="é", parts=[1.0, None], inner={"a": "b"}))
    a = flv.write_tags([(18, 0, meta), (9, 0, b"key"), (8, 40, b"sound"), (9, 70000000, b"late")])
    (tmp_path / "a.flv").write_bytes(a)
    rows = flv.flv_tags(spark, str(tmp_path / "a.flv")).orderBy("seq").collect()
    assert [(r.data_type, r.ts, bytes(r.body)) for r in rows[1:]] == [(9, 0, b"key"), (8, 40, b"sound"), (9, 70000000, b"late")]
    both = list(flv.read_tags(flv.join_files([a, a])))
    assert [t[1] for t in both] == [0, 0, 40, 70000000, 70000000, 70000040, 140000000]
    name, at = flv.amf_read(both[0][3])
    assert name == "onMetaData" and flv.amf_read(both[0][3], at)[0]["duration"] == 4.0


def movie(samples, payload):
    table = lambda k, r: mp4.write_table(k, r)
    head = lambda kind, n: mp4.write_atom(kind, b"\0" * 12 + (1000).to_bytes(4, "big") + n.to_bytes(4, "big") + b"\0" * 8)
    tk = mp4.write_atom("tkhd", b"\0" * 20 + (len(samples) * 40).to_bytes(4, "big") + b"\0" * 8)

    def build(offset):
        stbl = mp4.write_atom("stbl", table("stts", [(len(samples), 40)]) + table("stss", [(1,)]) + table("stsc", [(1, len(samples), 1)]) + table("stsz", [(s,) for s in samples]) + table("stco", [(offset,)]))
        mdia = mp4.write_atom("mdia", head("mdhd", len(samples) * 40) + mp4.write_atom("minf", stbl))
        return mp4.write_atom("moov", head("mvhd", len(samples) * 40) + mp4.write_atom("trak", tk + mdia))

    return (m := build(len(build(0)) + 8)) + mp4.write_atom("mdat", payload)


def test_mp4_merge(spark, tmp_path):
    a, b = movie([3, 4], b"abcdefg"), movie([2], b"hi")
    out = mp4.merge_files([a, b])
    (tmp_path / "o.mp4").write_bytes(out)
    rows = {r.type: bytes(r.body) for r in mp4.mp4_atoms(spark, str(tmp_path / "o.mp4")).collect() if r.body is not None}
    assert mp4.header("mvhd", rows["mvhd"])["duration"] == 120 and mp4.header("tkhd", rows["tkhd"])["duration"] == 120
    assert mp4.sample_table("stts", rows["stts"]) == [(3, 40)] and mp4.sample_table("stss", rows["stss"]) == [(1,), (3,)]
    assert mp4.sample_table("stsc", rows["stsc"]) == [(1, 2, 1), (2, 1, 1)] and mp4.sample_table("stsz", rows["stsz"]) == [(3,), (4,), (2,)]
    first, second = (x for (x,) in mp4.sample_table("stco", rows["stco"]))
    assert out[first : first + 7] == b"abcdefg" and out[second : second + 2] == b"hi"


def test_kernels():
    img = P.nv12_to_rgb(np.r_[np.full(64, 100, np.uint8), np.full(32, 128, np.uint8)], 8, 8, 16, 12, 32, 32)
    assert img[:, :12, :16].min() == img.max() == 100 and img[:, 12:].max() == 0
    assert (P.bilateral(img)[:, 3:9, 3:9] == 100).all()
    assert P.region(img, 0, 0, 16, 8, 96).shape == (3, 32, 96)
    assert P.label_components(np.array([[1, 1, 0], [0, 0, 1], [1, 0, 1]])).tolist() == [[1, 1, 0], [0, 0, 2], [3, 0, 2]]


def test_symbol_tables(spark, tmp_path):
    (tmp_path / "a.txt").write_text("ab\né", encoding="utf-8")
    assert [tuple(r) for r in tables.alphabet(spark, str(tmp_path / "a.txt")).orderBy("idx").collect()] == [(0, "\0"), (1, "a"), (2, "b"), (3, "\n"), (4, "é")]
    (tmp_path / "b.txt").write_text("ab 0.5\né中 0.25\n", encoding="utf-8")
    assert {tuple(r) for r in tables.bigrams(spark, str(tmp_path / "b.txt")).collect()} == {("a", "b", 0.5), ("é", "中", 0.25)}
    (tmp_path / "c.txt").write_text("abc 0.5\n")
    with pytest.raises(Exception, match="two characters"):
        tables.bigrams(spark, str(tmp_path / "c.txt")).collect()
    rows = spark.createDataFrame([(1, 0, "1080p", "x"), (1, 1, "360p", "y"), (2, 0, "720p", "z")], "v int, pos int, quality string, url string")
    assert {tuple(r) for r in tables.resolution(rows, "v").collect()} == {(1, "y"), (2, "z")}


def test_models_in_batches_of_one_shape(spark):
    rows = [(i, 2, 4 if i % 3 else 2, [float(i)] * (24 if i % 3 else 12)) for i in range(11)]
    frames = spark.createDataFrame(rows, "id int, height int, width int, px array<float>").coalesce(1)

    def load():
        def of(x):
            assert x.shape[:3] == (4, 3, 2)
            return x[:, 0], x[:, 1] * 2

        return of

    got = {r.id: (r.text, r.link) for r in models.detect(frames, ["id"], load, 4).collect()}
    assert got == {i: ([float(i)] * 2 * w, [2.0 * i] * 2 * w) for i, _, w, _ in rows}
    best = models.recognise(frames, ["id"], lambda: lambda x: (x[:, 0], (x[:, 0] + 1).astype(int)), 16)
    assert {r.id: r.symbols[0][0] for r in best.collect()} == {i: i + 1 for i in range(11)}
    assert models.detect(frames.limit(0), ["id"], load, 4).collect() == []


def test_jobs_are_tried_again(spark, tmp_path):
    rows = [(1, "exit 0"), (2, "echo no >&2; exit 3"), (3, "exit 9"), (4, f"test -e {tmp_path}/x || (touch {tmp_path}/x; exit 1)")]
    table = spark.createDataFrame(rows, "job int, script string")
    done = jobs.run(table, "job", lambda r: ["sh", "-c", r["script"]], fatal=(9,))
    assert {r.job: (r.status, r.tries, r.code, r.message) for r in done.collect()} == {1: ("Done", 1, 0, ""), 2: ("Error", 3, 3, "no"), 3: ("Error", 1, 9, ""), 4: ("Done", 2, 0, "")}
    assert [(r.status, r.code) for r in jobs.run(table.limit(1), "job", lambda r: ["/no/such/program"]).collect()] == [("Error", None)]
