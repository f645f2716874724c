import os
import struct

import pandas as pd
import pytest
from pyspark.sql import Row

from cuewright.plans import media as made
from cuewright.sources import flv, media, mp4, mp4_merge, ranges


def orders(keys):
    return pd.DataFrame({"o_orderkey": keys, "o_orderpriority": [f"p{k % 5}-" + "x" * (k % 13) for k in keys]})


def put_files(folder, n, of=made.mp4_of, end="mp4"):
    data = [of(orders(list(range(i * 100 + 1, i * 100 + 30 + 7 * i)))) for i in range(n)]
    for i, x in enumerate(data):
        made.put(f"{folder}/{i}.{end}", x)
    return data


def written(folder):
    return sorted(os.path.join(a, x) for a, _, names in os.walk(folder) for x in names if not x.endswith(".crc"))


def test_merged_files_are_those_of_one_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mp4_merge, "COPY", 64)
    data = put_files(tmp_path / "in", 4)
    parts = spark.createDataFrame([("a", i, f"file://{tmp_path}/in/{i}.mp4") for i in (2, 0, 1)] + [("b", 0, f"file://{tmp_path}/in/3.mp4")], "job string, part int, path string")
    mp4_merge.merge(parts, f"file://{tmp_path}/out")
    assert written(tmp_path / "out") == [f"{tmp_path}/out/{x}.mp4" for x in "ab"]
    assert (tmp_path / "out/a.mp4").read_bytes() == mp4.merge_files(data[:3])
    assert (tmp_path / "out/b.mp4").read_bytes() == mp4.merge_files(data[3:])


def test_tables_are_read_and_moved_in_pieces(spark, tmp_path, monkeypatch):
    """No task holds a table: heads leave its rows where they are, and ranges are of a few."""
    monkeypatch.setattr(mp4_merge, "PIECE", 7)
    data = [made.mp4_of(orders(list(range(1, 400 + i)))) for i in range(2)]
    sized = lambda x: x.replace(mp4.write_table("stsz", [(3,)] * 3), mp4.write_atom("stsz", struct.pack(">III", 0, 3, 3) + bytes(12)))
    data.append(sized(made.mp4_of(pd.DataFrame({"o_orderkey": range(6), "o_orderpriority": ["abc"] * 6}))))
    for i, x in enumerate(data):
        made.put(f"{tmp_path}/in/{i}.mp4", x)
    parts = spark.createDataFrame([("a", i, f"file://{tmp_path}/in/{i}.mp4") for i in range(3)], "job string, part int, path string")
    atoms = mp4_merge.heads(parts)
    assert max(len(r.body or b"") for r in atoms.collect()) <= 100
    tables = mp4_merge.measured(mp4_merge.tables_of(atoms), ["stsz", "stss"]).collect()
    whole = {(i, kind, len(mp4.sample_table(kind, body)), sum(x[0] for x in mp4.sample_table(kind, body))) for i, x in enumerate(data) for _, kind, _, _, body in mp4.atoms(x) if kind in ("stsz", "stss")}
    assert {(r.part, r.type, r.n, r.total) for r in tables if r.total is not None} == whole and len(tables) == 27
    assert max(r.length for r in mp4_merge.ranges(parts).where("data is not null").collect()) <= 120
    mp4_merge.merge(parts, f"file://{tmp_path}/out")
    assert (tmp_path / "out/a.mp4").read_bytes() == mp4.merge_files(data)


def test_no_parts_give_no_files_and_other_tracks_an_error(spark, tmp_path):
    put_files(tmp_path / "in", 1)
    parts = spark.createDataFrame([("a", 0, f"file://{tmp_path}/in/0.mp4"), ("a", 1, f"file://{tmp_path}/in/1.mp4")], "job string, part int, path string")
    mp4_merge.merge(parts.limit(0), f"file://{tmp_path}/none")
    assert written(tmp_path / "none") == []
    whole = (tmp_path / "in/0.mp4").read_bytes()
    traks = [x for x in mp4.atoms(whole) if x[1] == "trak"]
    cut = whole[: traks[1][2]]
    moov = next(x for x in mp4.atoms(whole) if x[1] == "moov")
    cut = cut[: moov[2]] + struct.pack(">I", len(cut) - moov[2]) + cut[moov[2] + 4 :]
    made.put(f"{tmp_path}/in/1.mp4", cut)
    with pytest.raises(Exception, match="different tracks"):
        mp4_merge.merge(parts, f"file://{tmp_path}/bad")
    assert written(tmp_path / "bad") == []


def test_splits_of_one_file(spark, tmp_path):
    rows = orders(list(range(1, 900)))
    made.put(f"{tmp_path}/in/1.flv", made.flv_of(rows))
    made.put(f"{tmp_path}/in/2.mp4", made.mp4_of(rows))
    made.put(f"{tmp_path}/in/3.txt", b"other")
    index = media.write_index(spark, str(tmp_path / "in"), f"file://{tmp_path}/index", split=500)
    found = media.packets(spark, index)
    assert found.rdd.getNumPartitions() > 20
    tags = list(flv.read_tags(made.flv_of(rows)))
    want = [(i, kind, ts, body) for i, (kind, ts, _, body, _) in enumerate(tags)]
    assert sorted((r.seq, r.stream, r.pts_ms, bytes(r.data)) for r in found.where("video_id like '%flv'").collect()) == want
    samples = found.where("video_id like '%mp4'").collect()
    for stream, odd in ((9, 1), (8, 0)):
        own = sorted((r.seq, bytes(r.data).decode()) for r in samples if r.stream == stream)
        assert own == list(enumerate(t for k, t in zip(rows["o_orderkey"], rows["o_orderpriority"]) if k % 2 == odd))


def test_options_leave_out_splits(spark, tmp_path):
    made.put(f"{tmp_path}/in/1.flv", made.flv_of(orders(list(range(1, 900)))))
    index = media.write_index(spark, str(tmp_path / "in"), f"file://{tmp_path}/index", split=500)
    every, some = media.packets(spark, index), media.packets(spark, index, [9], 4000, 5000)
    want = sorted((r.seq, r.pts_ms) for r in every.collect() if r.stream == 9 and 4000 <= r.pts_ms <= 5000)
    assert want and sorted((r.seq, r.pts_ms) for r in some.collect()) == want
    assert some.rdd.getNumPartitions() < every.rdd.getNumPartitions() / 4
    assert every.count() == 899 and media.packets(spark, index, [], 0).collect() == media.packets(spark, index, until=-1).collect() == []


def test_a_broken_file_is_an_error(spark, tmp_path):
    made.put(f"{tmp_path}/in/1.flv", b"FLW")
    with pytest.raises(Exception, match="FLV"):
        media.write_index(spark, str(tmp_path / "in"), f"file://{tmp_path}/index")


def test_a_cut_last_tag_is_left_out(tmp_path):
    whole = made.flv_of(orders(list(range(1, 40))))
    made.put(f"{tmp_path}/1.flv", whole[:-9])
    with media.opened(f"{tmp_path}/1.flv") as file:
        n = sum(r[7] for r in media.flv_index("x", file, 100))
    assert n == len(list(flv.read_tags(whole))) - 1


def test_ranges_of_a_file_by_many_tasks(spark, tmp_path):
    made.put(f"{tmp_path}/source", bytes(range(256)) * 10)
    rows = [("d/one.bin", i * 7, 7, None, f"file://{tmp_path}/source", i * 7) for i in range(300)] + [("d/one.bin", 2100, 3, b"end", None, None), ("two.bin", 0, 1, b"x", None, None)]
    ranges.write_ranges(spark.createDataFrame(rows, ranges.SCHEMA), f"file://{tmp_path}/out")
    assert written(tmp_path / "out") == [f"{tmp_path}/out/d/one.bin", f"{tmp_path}/out/two.bin"]
    assert (tmp_path / "out/d/one.bin").read_bytes() == (bytes(range(256)) * 10)[:2100] + b"end"


def test_failed_writes_leave_nothing(spark, tmp_path):
    made.put(f"{tmp_path}/source", b"short")
    for rows in ([("a", 0, 9, None, f"file://{tmp_path}/source", 0)], [("a", 3, 1, b"x", None, None)]):
        with pytest.raises(Exception, match="ends before|bytes"):
            ranges.write_ranges(spark.createDataFrame(rows, ranges.SCHEMA), f"file://{tmp_path}/out")
        assert written(tmp_path / "out") == []


def test_a_range_written_twice_is_the_same(tmp_path):
    sink = ranges.Writer(f"file://{tmp_path}/out")
    rows = [Row(file="a", at=0, length=2, data=b"ab", source=None, source_at=None), Row(file="a", at=2, length=1, data=b"c", source=None, source_at=None)]
    sink.write(iter(rows[:1]))  # a task that is lost before it tells
    sink.commit([sink.write(iter(rows[:1])), sink.write(iter(rows[1:]))])
    assert (tmp_path / "out/a").read_bytes() == b"abc" and written(tmp_path / "out") == [f"{tmp_path}/out/a"]
