"""Executed bin-packed compaction of Parquet files.

write_lots() deals a table's rows to files by day, lot and piece, one sorted file
each. planned() packs each day's small files into groups, largest first, each into
the first group with room: the groups' room has a staircase of prefix maxima, whose
first step that reaches the file's size is found by binary search; then the staircase
is repaired from there until it is as before. compacted() writes a group's files one
after the other into a new file, a task streaming each, and then removes them; other
files stay as they are. described() reads the final files back.

All sizes are shares of the table's rows, so a day has at most some 600 files and the
table some 600 more than four times its days, however large it is: lists of files go
by day, never whole, through a task. A file is written under a hidden name and renamed
when whole, its sources go when all groups' files are told of in a stored table: a
task that runs again writes the same file again, and a lost executor loses nothing.

Cases: null time: a day of its own, null. Null key: hashed as an empty text, first in
its file and empty in the digest of ids. Null, infinite and NaN values count 0 cents.
Repeated rows: all kept. Extra columns: written like others; day, lot and piece take
names that the table doesn't have. Empty table: no files, empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, stored, table, trim

#: Parts of the table's rows: those of a lot, of a file that stays, of a full group.
LOT, SMALL, FULL = 150, 600, 500
#: Rows that are read at a time, and bytes of a row group that is written.
READ_ROWS, GROUP_BYTES = 1 << 16, 64 << 20
FILES = "day long, lot long, piece long, n_rows long, path string"
FINAL = "day long, lot long, piece long, n_rows long, sources array<string>, path string, rewritten boolean"
TOLD = "day long, lot long, piece long, n_rows long, min_click_id long, max_click_id long, cents long, sources string, ids_sha256 string, columns string, path string, rewritten boolean"


def share(rows: int, parts: int) -> int:
    return 1 + rows // parts


class Packing:
    """Groups of room ``most``; an item joins the earliest that has room for it."""

    def __init__(self, most: int) -> None:
        self.most, self.room, self.steps = most, [], []
        self.groups: list[list] = []

    def put(self, item: object, size: int) -> None:
        at = bisect_left(self.steps, size)
        if at == len(self.steps):
            self.groups.append([])
            self.room.append(self.most)
            self.steps.append(max(self.most, self.steps[-1] if self.steps else 0))
        self.groups[at].append(item)
        self.room[at] -= size
        high = self.steps[at - 1] if at else -1
        for i in range(at, len(self.steps)):
            high = max(high, self.room[i])
            if self.steps[i] == high:
                break  # from here on all is as before
            self.steps[i] = high


def fresh(names: list[str], wanted: str) -> str:
    while wanted.lower() in {x.lower() for x in names}:
        wanted += "_"
    return wanted


def write_lots(rows: DataFrame, folder: str, at: str, key: str) -> tuple[DataFrame, int]:
    """(FILES, number of rows) of the table written under ``folder``: a file for each
    day of ``at``, lot and piece of the hashed ``key``, sorted by both."""
    day, lot, piece, lots = (fresh(rows.columns, x) for x in ("day", "lot", "piece", "lots"))
    dated = rows.withColumn(day, F.unix_date(F.col(at).cast("date")).cast("long"))
    days = stored(dated.groupBy(day).agg(F.count("*").alias("r")), "days")
    total = days.agg(F.coalesce(F.sum("r"), F.lit(0))).first()[0]
    known = days.select(F.col(day).alias("d"), (1 + F.floor(F.col("r") / share(total, LOT))).alias(lots))
    h = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    dealt = dated.join(known, dated[day].eqNullSafe(known.d), "left").drop("d")
    dealt = dealt.withColumns({lot: F.floor(h / 16) % F.col(lots), piece: F.least(h % 4, F.floor(h / 4) % 4)}).drop(lots)
    ordered = dealt.repartition(day, lot, piece).sortWithinPartitions(day, lot, piece, at, key)
    ordered.write.option("maxRecordsPerFile", 0).partitionBy(day, lot, piece).parquet(folder)
    spark = rows.sparkSession
    there = spark.read.schema(dealt.schema).parquet(folder) if total else dealt.limit(0).withColumn("_metadata", F.lit(None).cast("struct<file_path: string>"))
    found = there.groupBy(F.col(day).alias("day"), F.col(lot).alias("lot"), F.col(piece).alias("piece"), F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n_rows"))
    return stored(found.select("day", "lot", "piece", "n_rows", "path"), "files"), total


def planned(files: DataFrame, total: int, small: int = SMALL, full: int = FULL) -> DataFrame:
    """(day, lot, piece, n_rows, sources, paths) of the files that shall be: groups of
    small ones of a day, in the order they join, and the rest alone."""
    least, most = share(total, small), share(total, full)

    def of_day(rows: list[tuple]) -> Iterator[tuple]:
        packing = Packing(most)
        for row in rows:
            if row[3] >= least:
                packing.groups.append([row])
                packing.room.append(-1)
                packing.steps.append(packing.steps[-1] if packing.steps else -1)
            else:
                packing.put(row, row[3])
        for own in packing.groups:
            yield (*own[0][:3], sum(r[3] for r in own), [f"{r[1]}-{r[2]}" for r in own], [r[4] for r in own])

    names = ["day", "lot", "piece", "n_rows", "sources", "paths"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # the rows of a day

        def out() -> pd.DataFrame:
            made = pd.DataFrame(list(of_day(held)), columns=names)
            held.clear()
            return made.astype({"day": "Int64"})

        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                row = (None if pd.isna(row[0]) else int(row[0]), *map(int, row[1:4]), row[4])
                if held and held[0][0] != row[0]:
                    yield out()
                held.append(row)
        if held:
            yield out()

    by_day = files.repartition("day").sortWithinPartitions("day", F.desc("n_rows"), "lot", "piece")
    return by_day.mapInPandas(run, "day long, lot long, piece long, n_rows long, sources array<string>, paths array<string>")


def opened(path: str):
    where, inner = fs.FileSystem.from_uri(path)
    return where.open_input_file(inner)


def joined(sources: list[str]) -> str:
    """The files of some rows as one, in the first's folder; gives its path. Rows
    stream from file to file, GROUP_BYTES at a time."""
    where, first = fs.FileSystem.from_uri(sources[0])
    name = f"joined-{hashlib.sha1('|'.join(sources).encode()).hexdigest()[:16]}.parquet"
    inside = first.rpartition("/")[0]
    hidden = f"{inside}/.{uuid.uuid4().hex}.{name}"
    held: list[pa.RecordBatch] = []
    with opened(sources[0]) as f:
        schema = pq.read_schema(f)
    with where.open_output_stream(hidden, compression=None) as out, pq.ParquetWriter(out, schema) as writer:

        def flush() -> None:
            if held:
                rows = pa.Table.from_batches(held, schema)
                writer.write_table(rows, row_group_size=max(1, rows.num_rows))
                held.clear()

        for source in sources:
            with opened(source) as f:
                for batch in pq.ParquetFile(f).iter_batches(READ_ROWS):
                    held.append(batch)
                    if sum(x.nbytes for x in held) >= GROUP_BYTES:
                        flush()
        flush()
    where.move(hidden, f"{inside}/{name}")
    return sources[0].rpartition("/")[0] + f"/{name}"


def removed(paths: list[str]) -> None:
    """Files go, and their checksums, and what a lost task has left half written in
    the first's folder; those that are gone already are left out."""
    where, first = fs.FileSystem.from_uri(paths[0])
    for x in where.get_file_info(fs.FileSelector(first.rpartition("/")[0])):
        if x.base_name.startswith(".") and x.base_name.endswith(".parquet"):
            where.delete_file(x.path)
    for path in paths:
        where, inner = fs.FileSystem.from_uri(path)
        folder, _, name = inner.rpartition("/")
        for each in (inner, f"{folder}/.{name}.crc"):
            if where.get_file_info(each).type == fs.FileType.File:
                where.delete_file(each)


def tasks(plan: DataFrame) -> int:
    """A task for a few files; there are some hundreds at any size."""
    return max(1, min(512, plan.count() // 2))


def compacted(plan: DataFrame) -> DataFrame:
    """FINAL of a stored planned() table, carried out."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            several = batch["paths"].map(len) > 1
            batch["path"] = [joined(list(x)) if s else x[0] for x, s in zip(batch["paths"], several, strict=True)]
            batch["rewritten"] = several
            yield batch.drop(columns="paths").astype({"day": "Int64"})
            trim()

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for paths in batch["paths"]:
                removed(list(paths))
            yield pd.DataFrame({"n": [len(batch)]})

    n = tasks(plan)
    final = stored(plan.repartition(n, "day", "lot", "piece").mapInPandas(write, FINAL), "compacted")
    plan.where(F.size("paths") > 1).repartition(n, "day", "lot", "piece").mapInPandas(remove, "n long").agg(F.sum("n")).collect()
    return final


def told(path: str, key: str, value: str) -> tuple:
    """(rows, least and greatest key, cents, digest of keys, columns) of a file."""
    rows, cents, least, most, digest = 0, 0, None, None, hashlib.sha256()
    with opened(path) as f:
        file = pq.ParquetFile(f)
        for batch in file.iter_batches(READ_ROWS, columns=[key, value]):
            keys = batch.column(key).to_pylist()
            digest.update(("," * (rows > 0) + ",".join("" if k is None else str(k) for k in keys)).encode())
            real = [k for k in keys if k is not None]
            least, most = (f([x for x in (old, f(real, default=None)) if x is not None], default=None) for f, old in ((min, least), (max, most)))
            v = batch.column(value).to_numpy(zero_copy_only=False).astype(float)
            cents += int(np.floor(100 * v[np.isfinite(v)] + 0.5).astype(np.int64).sum())
            rows += len(keys)
        return rows, least, most, cents, digest.hexdigest(), ",".join(file.schema_arrow.names)


def described(final: DataFrame, key: str, value: str) -> DataFrame:
    """TOLD of compacted() files, read back, each in one streaming task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([told(x, key, value) for x in batch["path"]], columns=["n_rows", "min_click_id", "max_click_id", "cents", "ids_sha256", "columns"], index=batch.index, dtype=object)
            out = batch.drop(columns="n_rows").join(found)
            out["sources"] = batch["sources"].map(",".join)
            yield out[[x.split()[0] for x in TOLD.split(", ")]].astype({x: "Int64" for x in ("day", "n_rows", "min_click_id", "max_click_id", "cents")})
            trim()

    return final.repartition(tasks(final), "path").mapInPandas(run, TOLD)


def op11_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, total = write_lots(table(spark, sf_dir, "clicks"), shared_path(spark, "clicks"), "arrived_at", "click_id")
    return described(compacted(stored(planned(files, total), "plan")), "click_id", "value")
