"""MP4 files merged by a Spark job: nothing but headers goes through a task whole.

A part's atoms are read without its media data and without the rows of its sample
tables, a task for some files. What a merged file needs of its parts are sums over them:
rows, samples and chunks of the parts before, bytes of media data before. They come from
windows over a row a part. Each job's layout (where its tables and its media data go) is
made of the first part's atoms and these sums. Then each part's tables are moved on,
PIECE rows at a time, and its media data is copied, range by range, into the merged
file, by as many tasks as there are pieces and ranges.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.sources import mp4
from cuewright.sources.ranges import opened, write_ranges
from cuewright.store import stored
from cuewright.streaming import shared_path

#: Bytes of media data that are a range.
COPY = 32 << 20
#: Rows of a table that are read at a time.
PIECE = 1 << 17
#: Bytes of a row of each table, and of its atom before the rows.
ROW = {"stts": 8, "ctts": 8, "stsc": 12, "stss": 4, "stco": 4, "co64": 8, "stsz": 4}
HEAD = {"stsz": 20}
TABLES = list(ROW)
ATOMS = "job string, part long, source string, path string, type string, track int, offset long, size long, body binary, rows_at long, rows long, constant long"
KEYS = ["job", "part", "track", "type"]
LAYOUT = "job string, track int, type string, at long, data binary"


def table_head(file, kind: str, at: int, end: int) -> tuple[int, int, int]:
    """(place of the rows, how many, size of all samples or 0) of the table whose body is
    from ``at`` to ``end``."""
    if kind == "stsz":
        constant, n = struct.unpack_from(">II", file.read_at(min(12, end - at), at), 4)
        if not constant and at + 12 + 4 * n > end:
            raise ValueError(f"stsz at {at} is cut off")
        return at + 12, n, constant
    found = min(struct.unpack_from(">I", file.read_at(min(8, end - at), at), 4)[0] * ROW[kind], end - at - 8)
    if found % ROW[kind]:
        raise ValueError(f"{kind} at {at} is cut off")
    return at + 8, found // ROW[kind], 0


def heads(parts: DataFrame) -> DataFrame:
    """ATOMS of (job, part, path), media data left out and of sample tables but where
    their rows are and how many; ``track`` from 0 within a trak."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for job, part, source in zip(batch["job"], batch["part"], batch["path"], strict=True):
                with opened(source) as file:
                    found = list(mp4.walked(file))
                    if any(sum(x[0] == f"/{k}" for x in found) != 1 for k in ("moov", "mdat")):
                        raise ValueError(f"{source} hasn't one moov and one mdat")
                    traks = [x for x in found if x[1] == "trak"]
                    rows = []
                    for path, kind, at, inner, end in found:
                        track = next((k for k, t in enumerate(traks) if t[2] < at < t[4]), None)
                        table = kind in ROW and track is not None
                        bare = table or kind in mp4.CONTAINERS or kind in mp4.LAZY
                        told = table_head(file, kind, inner, end) if table else (None,) * 3
                        rows.append((job, part, source, path, kind, track, at, end - at, None if bare else file.read_at(end - inner, inner), *told))
                made = pd.DataFrame(rows, columns=[x.split()[0] for x in ATOMS.split(", ")])
                yield made.astype({"track": "Int32", "rows_at": "Int64", "rows": "Int64", "constant": "Int64"})

    named = parts.select(F.col("job").cast("string").alias("job"), F.col("part").cast("long").alias("part"), "path")
    return named.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "job", "part").mapInPandas(of, ATOMS)


def tables_of(atoms: DataFrame) -> DataFrame:
    """(KEYS, source, rows_at, constant, n) of the sample tables: where their ``n`` rows are."""
    return atoms.where(F.col("type").isin(TABLES) & F.col("track").isNotNull()).select(*KEYS, "source", "rows_at", "constant", F.col("rows").alias("n"))


def pieces(tables: DataFrame) -> DataFrame:
    """Rows of tables with the runs of PIECE rows that each is read in: ``length`` rows
    after ``skipped``, dealt to all tasks. A table without rows has none."""
    step = F.lit(PIECE).cast("long")
    cut = F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step)).otherwise(F.array().cast("array<long>"))).alias("skipped")
    found = tables.select("*", cut).withColumn("length", F.least(step, F.col("n") - F.col("skipped")))
    return found.repartition(int(tables.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEYS, "skipped")


def rows_of(piece, files: dict) -> np.ndarray:
    """A piece's rows as numbers, those of a constant sample size as well; ``files``: the
    open one."""
    if piece.constant:
        return np.full((piece.length, 1), piece.constant, np.int64)
    if piece.source not in files:
        for f in files.values():
            f.close()
        files.clear()
        files[piece.source] = opened(piece.source)
    size = ROW[piece.type]
    found = files[piece.source].read_at(piece.length * size, piece.rows_at + piece.skipped * size)
    kind = np.dtype(">u8" if piece.type == "co64" else ">u4")
    return np.frombuffer(found, kind).astype(np.int64).reshape(piece.length, size // kind.itemsize)


def each_piece(rows: DataFrame, schema: str, of: Callable) -> DataFrame:
    """Rows of ``schema``, one that ``of`` makes of each piece and the opened files."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files: dict = {}
        for batch in batches:
            for piece in batch.itertuples(index=False):
                yield pd.DataFrame([of(piece, files)], columns=[x.split()[0] for x in schema.split(", ")])
        for f in files.values():
            f.close()

    return rows.mapInPandas(each, schema)


def packed(kind: str, rows: np.ndarray) -> bytes:
    most = (1 << 64 if kind == "co64" else 1 << 32) - 1
    if len(rows) and (rows.max() > most or rows.min() < 0):
        raise ValueError(f"{kind} doesn't hold {rows.max()}")
    return rows.astype(">u8" if kind == "co64" else ">u4").tobytes()


def measured(tables: DataFrame, kinds: list[str]) -> DataFrame:
    """tables_of() with the ``total`` of the first numbers of their rows, and ``low`` and
    ``high``, bounds of the last; null for kinds that aren't asked for and without rows."""

    def of(piece, files: dict) -> tuple:
        rows = rows_of(piece, files)
        return *(getattr(piece, k) for k in own), int(rows[:, 0].sum()), int(rows[:, -1].min()), int(rows[:, -1].max())

    own = [*KEYS, "rows_at"]
    found = each_piece(pieces(tables.where(F.col("type").isin(kinds))), "job string, part long, track int, type string, rows_at long, total long, low long, high long", of)
    sums = found.groupBy(*own).agg(F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    return tables.join(sums, own, "left")


def merged_rows(tables: DataFrame) -> DataFrame:
    """Rows of each merged table: (job, track, type, n, single), ``single`` the
    duration where all of an stts are equal and one row stands for all."""
    sums = tables.groupBy("job", "track", "type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    one = (F.col("type") == "stts") & (F.col("low") == F.col("high"))
    return sums.select("job", "track", "type", F.when(one, 1).otherwise(F.col("n")).alias("n"), F.when(one, F.col("low")).alias("single"), "total")


def before(rows: DataFrame, keys: list[str], n: str, name: str) -> DataFrame:
    """Rows with the sum of ``n`` over the parts before."""
    w = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long"))


def layouts(atoms: DataFrame, merged: DataFrame) -> DataFrame:
    """LAYOUT of each job: the bytes of all that isn't a table, and with null data where
    tables' rows and the media data (type mdat) start."""

    @F.pandas_udf("long")
    def duration(kind: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([mp4.header(k, bytes(b))["duration"] for k, b in zip(kind, body, strict=True)])

    timed = atoms.where(F.col("type").isin("mvhd", "tkhd", "mdhd")).groupBy("job", "path", F.coalesce("track", F.lit(-1)).alias("own")).agg(F.sum(duration("type", "body")).alias("sum"))
    media = atoms.where("type = 'mdat'").groupBy("job").agg(F.sum(F.col("size") - 8).alias("media"), F.min("part").alias("first"))
    tracks = atoms.where("type = 'trak'").groupBy("job", "part").count().groupBy("job").agg(F.countDistinct("count").alias("kinds"))
    first = atoms.join(media, "job").where("part = first").join(tracks, "job", "left").withColumn("own", F.coalesce("track", F.lit(-1)))
    body = F.when(~F.col("type").isin(TABLES) | F.col("track").isNull(), F.col("body"))
    known = first.withColumn("body", body).join(timed, ["job", "path", "own"], "left").join(merged.select("job", F.col("track").alias("own"), "type", "n"), ["job", "own", "type"], "left")

    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if (rows["kinds"] > 1).any():
            raise ValueError(f"files of {key[0]} have different tracks")
        out: list[tuple] = []

        def inside(parent) -> list:
            near = [r for r in rows.sort_values("offset").itertuples(index=False) if r.path.rpartition("/")[0] == (parent.path if parent else "") and r.type not in ("mdat", "udta")]
            return [r for r in near if not parent or parent.offset < r.offset < parent.offset + parent.size]

        def size(r) -> int:
            if r.type in mp4.CONTAINERS:
                return 8 + sum(map(size, inside(r)))
            return HEAD.get(r.type, 16) + ROW[r.type] * int(r.n) if is_table(r) else 8 + len(r.body or b"")

        def is_table(r) -> bool:
            return r.type in ROW and not pd.isna(r.track)

        def put(r, at: int) -> int:
            head = struct.pack(">I", size(r)) + r.type.encode("latin-1")
            track = None if pd.isna(r.track) else int(r.track)
            if r.type in mp4.CONTAINERS:
                out.append((key[0], None, None, at, head))
                at += 8
                for x in inside(r):
                    at = put(x, at)
                return at
            if is_table(r):
                more = struct.pack(">III", 0, 0, int(r.n)) if r.type == "stsz" else struct.pack(">II", 0, int(r.n))
                out.append((key[0], None, None, at, head + more))
                at += len(head + more)
                out.append((key[0], track, r.type, at, None))
                return at + ROW[r.type] * int(r.n)
            body = bytearray(r.body or b"")
            if r.type in ("mvhd", "tkhd", "mdhd"):
                wide = body[0] == 1
                place = {"tkhd": 28 if wide else 20}.get(r.type, 24 if wide else 16)
                struct.pack_into(">Q" if wide else ">I", body, place, int(r.sum))
            out.append((key[0], None, None, at, head + bytes(body)))
            return at + 8 + len(body)

        at = 0
        for r in inside(None):
            at = put(r, at)
        out.append((key[0], None, None, at, struct.pack(">I", int(rows["media"].iloc[0]) + 8) + b"mdat"))
        out.append((key[0], None, "mdat", at + 8, None))
        return pd.DataFrame(out, columns=[x.split()[0] for x in LAYOUT.split(", ")]).astype({"track": "Int32"})

    return known.select("job", "path", "type", "track", "offset", "size", "body", "sum", "n", "media", "kinds").groupBy("job").applyInPandas(of, LAYOUT)


def ranges(parts: DataFrame) -> DataFrame:
    """The ranges of the merged files (sources.ranges.SCHEMA) of (job, part, path)."""
    spark = parts.sparkSession
    path = shared_path(spark, "mp4-heads")
    heads(parts).write.parquet(path)
    atoms = spark.read.schema(ATOMS).parquet(path)
    tables = stored(measured(tables_of(atoms), ["stts"]), "mp4-tables")
    merged = merged_rows(tables)
    placed_at = shared_path(spark, "mp4-layout")
    layouts(atoms, merged).write.parquet(placed_at)
    layout = spark.read.schema(LAYOUT).parquet(placed_at)
    file = F.concat("job", F.lit(".mp4"))
    none = F.lit(None)
    fixed = layout.where("data is not null").select(file.alias("file"), "at", F.octet_length("data").cast("long").alias("length"), "data", none.cast("string").alias("source"), none.cast("long").alias("source_at"))

    start = layout.where("type = 'mdat' and data is null").select("job", F.col("at").alias("start"))
    media = before(atoms.where("type = 'mdat'").select("job", "part", "source", (F.col("offset") + 8).alias("source_at"), (F.col("size") - 8).alias("length")), ["job"], "length", "move").join(start, "job")
    cut = F.explode(F.when(F.col("length") > 0, F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(COPY).cast("long"))).otherwise(F.array().cast("array<long>"))).alias("k")
    copied = media.select("*", cut).select(file.alias("file"), (F.col("start") + F.col("move") + F.col("k")).alias("at"), F.least(F.lit(COPY).cast("long"), F.col("length") - F.col("k")).alias("length"), none.cast("binary").alias("data"), "source", (F.col("source_at") + F.col("k")).alias("source_at"))

    keys = ["job", "track"]
    sizes = tables.groupBy(*keys, "part").agg(F.coalesce(F.sum(F.when(F.col("type") == "stsz", F.col("n"))), F.lit(0)).alias("samples"), F.coalesce(F.sum(F.when(F.col("type").isin("stco", "co64"), F.col("n"))), F.lit(0)).alias("chunks"))
    sizes = before(before(sizes, keys, "samples", "samples_before"), keys, "chunks", "chunks_before")
    known = before(tables, [*keys, "type"], "n", "rows_before").join(sizes, [*keys, "part"]).join(media.select("job", "part", (F.col("start") + F.col("move") - F.col("source_at")).alias("bytes")), ["job", "part"])
    known = known.join(merged.select(*keys, "type", "single", F.col("total").alias("all")), [*keys, "type"]).where("single is null or rows_before = 0 and n > 0")
    move = F.when(F.col("type") == "stss", F.col("samples_before")).when(F.col("type") == "stsc", F.col("chunks_before")).when(F.col("type").isin("stco", "co64"), F.col("bytes")).otherwise(0)

    placed = known.join(layout.where("data is null and track is not null").select(*keys, "type", "at"), [*keys, "type"])
    width = F.create_map(*[F.lit(x) for kv in ROW.items() for x in kv])[F.col("type")]
    one = placed.withColumn("move", move.cast("long")).withColumn("n", F.when(F.col("single").isNull(), F.col("n")).otherwise(1))

    def moved(piece, files: dict) -> tuple:
        if pd.isna(piece.single):
            rows = rows_of(piece, files)
            rows[:, 0] += int(piece.move)
        else:
            rows = np.array([[int(piece.all), int(piece.single)]])
        return piece.job, piece.place, packed(piece.type, rows)

    cut = pieces(one).withColumn("place", F.col("at") + (F.col("rows_before") + F.col("skipped")) * width)
    packed_rows = each_piece(cut, "job string, at long, data binary", moved).withColumn("file", file)
    told = packed_rows.select("file", "at", F.octet_length("data").cast("long").alias("length"), "data", none.cast("string").alias("source"), none.cast("long").alias("source_at"))
    return fixed.unionByName(told.where("length > 0")).unionByName(copied)


def merge(parts: DataFrame, folder: str) -> None:
    """Writes ``folder``/job.mp4 of the files of (job, part, path), parts in order: the
    same bytes as mp4.merge_files() makes. Files over 4 GB are an error, as their
    boxes are of 32 bits, unless co64 tells the places and no box outgrows them."""
    write_ranges(ranges(parts), folder)
