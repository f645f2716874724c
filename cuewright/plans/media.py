"""Queries of media files in the shared folder, and their SQL."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import functions as F

from cuewright.plans.registry import query, read
from cuewright.sources import flv, media, mp4
from cuewright.sources import mp4_merge as merging
from cuewright.streaming import shared_path


def put(path: str, data: bytes) -> None:
    """A file under its name when it's whole."""
    where, inner = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    folder, _, name = inner.rpartition("/")
    where.create_dir(folder, recursive=True)
    hidden = f"{folder}/.{uuid.uuid4().hex}"
    with where.open_output_stream(hidden) as out:
        out.write(data)
    where.move(hidden, inner)


def files(spark, sf, end, made):
    """(path, part) of a file for every 40th of the customers, made of its orders."""
    folder = shared_path(spark, "media")

    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        path = f"{folder}/{key[0]}.{end}"
        put(path, made(rows.sort_values("o_orderkey")))
        return pd.DataFrame({"path": [path], "part": [key[0]]})

    orders = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    found = orders.groupBy((F.col("o_custkey") % 40).alias("part")).applyInPandas(of, "path string, part long")
    found.write.parquet(listed := shared_path(spark, "media-list"))
    return folder, spark.read.schema(found.schema).parquet(listed)


def flv_of(rows: pd.DataFrame) -> bytes:
    tags = [(9 if k % 2 else 8, i * 40, t.encode()) for i, (k, t) in enumerate(zip(rows["o_orderkey"], rows["o_orderpriority"], strict=True))]
    return flv.write_tags(tags)


def table(kind: str, rows: np.ndarray) -> bytes:
    """mp4.write_table() of an array."""
    return mp4.write_atom(kind, bytes(8 if kind == "stsz" else 4) + struct.pack(">I", len(rows)) + rows.astype(">u4").tobytes())


def mp4_of(rows: pd.DataFrame) -> bytes:
    """A video track of the odd orders and a sound track of the even ones, ten samples
    a chunk, a sync sample every seventh."""
    data, traks, keys, texts = [], [], rows["o_orderkey"].to_numpy(), rows["o_orderpriority"].to_numpy()
    lead, held = mp4.write_atom("ftyp", b"isom"), 0
    for odd, name in ((1, b"vide"), (0, b"soun")):
        own = texts[keys % 2 == odd]
        data.append("".join(own).encode())
        sizes = np.fromiter((len(t.encode()) for t in own), np.int64, len(own))
        places = (np.cumsum(sizes) - sizes)[::10] + len(lead) + 8 + held
        held += len(data[-1])
        chunks, last = len(places), len(own) % 10
        runs = [(1, 10, 1)] * (chunks > (last > 0)) + [(chunks, last, 1)] * (last > 0)
        steps = np.array([[len(own), 40]]) if odd else np.stack([np.ones(len(own), np.int64), 20 + np.arange(len(own)) % 3], 1)
        tables = [("stts", steps), ("stsc", np.array(runs, np.int64).reshape(-1, 3)), ("stsz", sizes), ("stco", places)]
        tables += [("stss", np.arange(0, len(own), 7) + 1)] * odd
        stbl = mp4.write_atom("stbl", b"".join(table(*t) for t in tables))
        mdhd = struct.pack(">IIIII", 0, 0, 0, 1000, int((steps[:, 0] * steps[:, 1]).sum())) + bytes(4)
        hdlr = bytes(8) + name + bytes(13)
        mdia = mp4.write_atom("mdhd", mdhd) + mp4.write_atom("hdlr", hdlr) + mp4.write_atom("minf", stbl)
        traks.append(mp4.write_atom("trak", mp4.write_atom("tkhd", bytes(20) + struct.pack(">I", 40 * len(own)) + bytes(60)) + mp4.write_atom("mdia", mdia)))
    mvhd = struct.pack(">IIIII", 0, 0, 0, 1000, 40 * len(rows)) + bytes(80)
    return lead + mp4.write_atom("mdat", b"".join(data)) + mp4.write_atom("moov", mp4.write_atom("mvhd", mvhd) + b"".join(traks))


PARTS = "o as (select o_custkey % 40 as part, o_orderkey as k, o_orderpriority as x, o_orderkey % 2 as odd, row_number() over (partition by o_custkey % 40 order by o_orderkey) - 1 as i, row_number() over (partition by o_custkey % 40, o_orderkey % 2 order by o_orderkey) - 1 as j from orders)"


@query("with " + PARTS + " select part, i as seq, i * 40 as pts_ms, x as data from o where odd = 1 and i * 40 >= 1000 and i * 40 < 9000")
def flv_packets(spark, sf):
    """The video tags of some seconds, each file read by several tasks."""
    folder, _ = files(spark, sf, "flv", flv_of)
    index = media.write_index(spark, folder, shared_path(spark, "index"), split=2048)
    found = media.packets(spark, index, [9], 1000, 8999)
    return found.select(part("video_id"), "seq", "pts_ms", F.decode("data", "UTF-8").alias("data"))


@query("with " + PARTS + " select part, j as seq, case odd when 1 then 9 else 8 end as stream, case odd when 1 then j * 40 else 20 * j + j // 3 * 3 + [0, 0, 1][j % 3 + 1] end as pts_ms, x as data from o")
def mp4_packets(spark, sf):
    """All samples of files of two tracks, each read by several tasks."""
    folder, _ = files(spark, sf, "mp4", mp4_of)
    found = media.packets(spark, media.write_index(spark, folder, shared_path(spark, "index"), split=2048))
    return found.select(part("video_id"), "seq", F.col("stream"), "pts_ms", F.decode("data", "UTF-8").alias("data"))


MERGED = PARTS + ", m as (select *, part % 4 as job, row_number() over (partition by part % 4, odd order by part, j) - 1 as seq from o), c as (select job, part, odd, count(*) as n, sum(strlen(x)) as bytes from m group by 1, 2, 3), b as (select *, sum(bytes) over (partition by job order by part, odd desc rows unbounded preceding) - bytes as at from c)"


@query("with " + MERGED + " select job, case odd when 1 then 9 else 8 end as stream, seq, x as data, case when odd = 1 then seq * 40 end as pts_ms from m")
def mp4_merge(spark, sf):
    """The files of each fourth of the parts merged into one, read back by samples."""
    _, found = files(spark, sf, "mp4", mp4_of)
    out = shared_path(spark, "merged")
    merge_fourths(found, out)
    read_back = media.packets(spark, media.write_index(spark, out, shared_path(spark, "index"), split=8192))
    times = F.when(F.col("stream") == 9, F.col("pts_ms"))
    return read_back.select(part("video_id").alias("job"), "stream", "seq", F.decode("data", "UTF-8").alias("data"), times.alias("pts_ms"))


@query("with " + MERGED + ", s as (select part, job, odd, row_number() over (partition by job, odd order by part, j) as sample, j from m) select job, odd as track, 'stss' as type, cast(count(*) as bigint) as n, cast(sum(sample) as bigint) as total from s where odd = 1 and j % 7 = 0 group by 1, 2 union all select job, odd, 'stsz', cast(sum(n) as bigint), cast(sum(bytes) as bigint) from b group by 1, 2 union all select job, odd, 'stts', case odd when 1 then 1 else cast(sum(n) as bigint) end, cast(sum(n) as bigint) from b group by 1, 2 union all select job, odd, 'stco', cast(sum((n + 9) // 10) as bigint), null from b group by 1, 2")
def mp4_merged_tables(spark, sf):
    """Rows and sums of the tables of merged files, from their atoms."""
    _, found = files(spark, sf, "mp4", mp4_of)
    out = shared_path(spark, "merged")
    merge_fourths(found, out)
    listed = spark.read.format("binaryFile").load(f"{out}/*.mp4").select("path")
    tables = merging.tables_of(merging.heads(listed.select(part("path").alias("job"), F.lit(0).alias("part"), "path")))
    known = merging.measured(tables.where("type <> 'stsc'"), ["stss", "stsz", "stts"])
    own = F.when(F.col("type") != "stco", F.coalesce("total", F.lit(0)))
    return known.select(F.col("job").cast("long").alias("job"), (1 - F.col("track")).cast("long").alias("track"), "type", "n", own.alias("total"))


def merge_fourths(found, out):
    merging.merge(found.select((F.col("part") % 4).alias("job"), "part", "path"), out)


def part(path: str):
    return F.regexp_extract(path, "([0-9]+)\\.[a-z0-9]+$", 1).cast("long").alias("part")
