"""A splittable source of the packets of FLV and MP4 files: ``spark.read.format("media")``.

write_index() walks the files' headers, a task for some files and none holding one, and
writes a row for each SPLIT bytes of a file: where they start, which packets they have,
of which stream and times. The source, option ``index``, has a partition for each such
run of such rows that its options leave, and reads just their bytes: an FLV split is a
run of whole tags, an MP4 split a run of samples of one track. Option ``parts``: about
how many partitions there are at most while none has over SPLIT bytes, as a partition
reads the tables of its files once.

Options ``streams`` (comma-joined), ``since`` and ``until`` (ms) are applied while
reading, and splits without such packets are no partitions at all. They are options and
not pushed filters, as Spark 4.1 keeps one reader for all DataFrames of a load(): what
is pushed for one would be missing in the others.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import TYPE_CHECKING

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cuewright.sources.ranges import opened

if TYPE_CHECKING:  # what plans a read is light: the driver runs one such process a plan
    import numpy as np
    import pandas as pd

SPLIT = 64 << 20
#: Partitions that small splits aren't packed below.
LEAST = 64
#: Bytes that are read at a time while walking.
WINDOW, BLOCK = 64 << 10, 4 << 20
INDEX = "path string, kind string, track int, stream int, start long, end long, first long, n long, min_ts long, max_ts long"
PACKETS = "video_id string, seq long, stream int, pts_ms long, data binary"
#: The stream numbers of an MP4 track's handlers; others are script data.
HANDLERS = {"vide": 9, "soun": 8}
SCRIPT = 18


class Window:
    """Bytes of a file at rising places, a window at a time."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.at, self.data, self.end = file, size, 0, b"", file.size()

    def get(self, at: int, n: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.data):
            self.at, self.data = at, self.file.read_at(min(max(n, self.size), max(0, self.end - at)), at)
        return self.data[at - self.at : at - self.at + n]


def tags(file, start: int, end: int, window: int = BLOCK) -> Iterator[tuple[int, int, int, int, Window]]:
    """(place of the body, type, timestamp, size, window) of the FLV tags that start
    in a range, whose first starts at ``start``; a cut last tag is left out."""
    seen = Window(file, window)
    while start + 11 <= min(end, seen.end):
        head = seen.get(start, 11)
        size = int.from_bytes(head[1:4], "big")
        if start + 11 + size > seen.end:
            return
        yield start + 11, head[0], int.from_bytes(head[4:7], "big") | head[7] << 24, size, seen
        start += 15 + size


def flv_index(path: str, file, split: int) -> Iterator[tuple]:
    head = file.read_at(9, 0)
    if head[:3] != b"FLV" or head[3] != 1:
        raise ValueError(f"{path} isn't an FLV file of version 1")
    start, first, own = struct.unpack_from(">I", head, 5)[0] + 4, 0, []
    for seq, (at, _, ts, size, _) in enumerate(tags(file, start, file.size(), WINDOW)):
        own.append(ts)
        if at + size + 4 - start >= split:
            yield path, "flv", None, None, start, at + size + 4, first, len(own), min(own), max(own)
            start, first, own = at + size + 4, seq + 1, []
    if own:
        yield path, "flv", None, None, start, file.size(), first, len(own), min(own), max(own)


@dataclass
class Track:
    """The samples of a track: places, sizes and times in ms."""

    stream: int
    offsets: np.ndarray
    sizes: np.ndarray
    times: np.ndarray


def tracks(file) -> list[Track]:
    """The tracks of an MP4 file, of its moov alone."""
    import numpy as np

    from cuewright.sources import mp4

    found = list(mp4.head_atoms(file))
    out = []
    for top in (x for x in found if x[1] == "trak"):
        own = {k: b for _, k, at, _, b in found if top[2] < at < top[2] + top[3] and b is not None}
        table = {k: mp4.table_array(k, own[k]) if k in own else np.zeros(0, np.int64) for k in ("stsz", "stsc", "stco", "co64", "stts", "ctts")}
        sizes = table["stsz"].reshape(-1)
        chunks = np.concatenate([table["stco"].reshape(-1), table["co64"].reshape(-1)])
        if not len(table["stsc"]):
            table["stsc"] = np.array([[1, max(1, len(sizes)), 1]])
        runs = table["stsc"][:, 0] - 1
        each = np.repeat(table["stsc"][:, 1], np.diff(np.append(runs, len(chunks))))
        chunk = np.repeat(np.arange(len(each)), each)[: len(sizes)]
        before = np.cumsum(sizes) - sizes
        first = np.flatnonzero(np.diff(chunk, prepend=-1))
        offsets = chunks[chunk] + before[: len(chunk)] - np.repeat(before[first], np.diff(np.append(first, len(chunk))))
        times = np.cumsum(np.concatenate([[0], np.repeat(table["stts"][:, 1], table["stts"][:, 0])]))[: len(sizes)] if len(table["stts"]) else np.zeros(len(sizes), np.int64)
        if len(table["ctts"]):
            times = times + np.repeat(table["ctts"][:, 1], table["ctts"][:, 0])[: len(times)]
        scale = mp4.header("mdhd", own["mdhd"])["timescale"] or 1000
        stream = HANDLERS.get(own["hdlr"][8:12].decode("latin-1"), SCRIPT) if "hdlr" in own else HANDLERS["vide"]
        out.append(Track(stream, offsets, sizes[: len(offsets)], times[: len(offsets)] * 1000 // scale))
    return out


def mp4_index(path: str, file, split: int) -> Iterator[tuple]:
    import numpy as np

    for k, track in enumerate(tracks(file)):
        sums, first = np.cumsum(track.sizes), 0
        while first < len(sums):
            last = max(first + 1, int(np.searchsorted(sums, split + (sums[first - 1] if first else 0), "right")))
            own = slice(first, last)
            yield path, "mp4", k, track.stream, int(track.offsets[own].min()), int((track.offsets[own] + track.sizes[own]).max()), first, last - first, int(track.times[own].min()), int(track.times[own].max())
            first = last


def write_index(spark: SparkSession, path: str, index: str, split: int = SPLIT) -> str:
    """The index of the FLV and MP4 files below ``path``, as Parquet at ``index``. Files
    of other names are left out; a broken one is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")  # no content
    kind = F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1))
    named = files.select("path", F.when(kind.isin("flv", "f4v"), "flv").when(kind.isin("mp4", "m4v"), "mp4").alias("kind")).where("kind is not null")

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for batch in batches:
            for path, kind in zip(batch["path"], batch["kind"], strict=True):
                with opened(path) as file:
                    rows = list({"flv": flv_index, "mp4": mp4_index}[kind](path, file, split))
                made = pd.DataFrame(rows, columns=[x.split()[0] for x in INDEX.split(", ")])
                yield made.astype({"track": "Int32", "stream": "Int32"})

    named.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInPandas(of, INDEX).write.parquet(index)
    return index


@dataclass
class Run(InputPartition):
    """Splits, in order of file and place, that a task reads."""

    splits: list[Split]


@dataclass
class Split:
    path: str
    kind: str
    track: int | None
    start: int
    end: int
    first: int
    n: int


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        streams, since, until = (options.get(k) for k in ("streams", "since", "until"))
        self.index, self.streams = options["index"], None if streams is None else {int(x) for x in streams.split(",") if x}
        self.low, self.high = (None if x is None else int(x) for x in (since, until))
        self.parts = int(options["parts"]) if "parts" in options else None

    def wanted(self, stream: int, ts: int) -> bool:
        return (self.streams is None or stream in self.streams) and (self.low is None or ts >= self.low) and (self.high is None or ts <= self.high)

    def partitions(self) -> list[InputPartition]:
        """Runs of the rows of the index, of a split or SPLIT bytes, that have what is asked for."""
        import pyarrow.parquet as pq

        where, inner = fs.FileSystem.from_uri(self.index if ":" in self.index else f"file://{self.index}")
        out: list[Split] = []
        for r in pq.read_table(inner, filesystem=where).to_pylist():
            if (self.low is None or r["max_ts"] >= self.low) and (self.high is None or r["min_ts"] <= self.high) and (r["stream"] is None or self.streams is None or r["stream"] in self.streams):
                out.append(Split(*(r[k] for k in ("path", "kind", "track", "start", "end", "first", "n"))))
        if self.parts is None:
            return [Run([x]) for x in out] or [Run([])]
        out.sort(key=lambda x: (x.path, x.track or 0, x.first))
        most = min(SPLIT, sum(x.end - x.start for x in out) // self.parts)
        runs: list[Run] = []
        held = 0
        for x in out:
            if not runs or held >= most:
                runs.append(Run([]))
                held = 0
            runs[-1].splits.append(x)
            held += x.end - x.start
        return runs or [Run([])]

    def read(self, partition: Run) -> Iterator[tuple]:
        for path, splits in groupby(partition.splits, lambda x: x.path):
            with opened(path) as file:
                found, windows = None, {}
                for split in splits:
                    if split.kind == "flv":
                        for i, (at, kind, ts, size, seen) in enumerate(tags(file, split.start, split.end, max(WINDOW, min(BLOCK, split.end - split.start)))):
                            if self.wanted(kind, ts):
                                yield path, split.first + i, kind, ts, seen.get(at, size)
                        continue
                    found = found or tracks(file)
                    track, seen = found[split.track], windows.setdefault(split.track, Window(file, BLOCK))
                    if self.streams is not None and track.stream not in self.streams:
                        continue
                    own = slice(split.first, split.first + split.n)
                    for i, (ts, at, size) in enumerate(zip(track.times[own].tolist(), track.offsets[own].tolist(), track.sizes[own].tolist(), strict=True)):
                        if self.wanted(track.stream, ts):
                            yield path, split.first + i, track.stream, ts, seen.get(at, size)


class MediaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media"

    def schema(self) -> str:
        return PACKETS

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))


def packets(spark: SparkSession, index: str, streams: Iterable[int] | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    """PACKETS of the files of an index: of some streams, and of times from ``since`` to
    ``until`` in ms."""
    spark.dataSource.register(MediaSource)
    options = {"index": index, "streams": None if streams is None else ",".join(map(str, streams)), "since": since, "until": until, "parts": max(LEAST, int(spark.conf.get("spark.sql.shuffle.partitions")))}
    return spark.read.format("media").options(**{k: v for k, v in options.items() if v is not None}).load()
