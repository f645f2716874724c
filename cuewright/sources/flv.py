"""FLV files: tags as rows, AMF0 values, joined files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.sources import batches as batched

HEADER = b"FLV\x01\x05\x00\x00\x00\x09\x00\x00\x00\x00"
TAGS = "part string, seq int, data_type int, ts long, body_size int, body binary, prev_size int"
#: AMF0 type markers.
NUMBER, BOOLEAN, STRING, OBJECT, NULL, MIXED, END, ARRAY = 0, 1, 2, 3, 5, 8, 9, 10


class Mixed(dict):
    """A mixed array: an ordered mapping with its own marker."""


def amf_read(data: bytes, at: int = 0) -> tuple[object, int]:
    """(value, place after it) of the AMF0 value at ``at``."""
    kind, at = data[at], at + 1
    if kind == NUMBER:
        return struct.unpack_from(">d", data, at)[0], at + 8
    if kind == BOOLEAN:
        return bool(data[at]), at + 1
    if kind == STRING:
        return _text(data, at)
    if kind == NULL:
        return None, at
    if kind == ARRAY:
        n, out = struct.unpack_from(">I", data, at)[0], []
        at += 4
        for _ in range(n):
            value, at = amf_read(data, at)
            out.append(value)
        return out, at
    if kind in (OBJECT, MIXED):
        made: dict = Mixed() if kind == MIXED else {}
        at += 4 if kind == MIXED else 0
        while data[at : at + 3] != b"\x00\x00\x09":
            key, at = _text(data, at)
            made[key], at = amf_read(data, at)
        return made, at + 3
    raise ValueError(f"unknown AMF0 type {kind}")


def _text(data: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from(">H", data, at)[0]
    return data[at + 2 : at + 2 + n].decode("utf-8"), at + 2 + n


def amf_write(value: object) -> bytes:
    text = lambda s: struct.pack(">H", len(b := s.encode("utf-8"))) + b
    if value is None:
        return bytes([NULL])
    if isinstance(value, bool):
        return bytes([BOOLEAN, value])
    if isinstance(value, int | float):
        return bytes([NUMBER]) + struct.pack(">d", value)
    if isinstance(value, str):
        return bytes([STRING]) + text(value)
    if isinstance(value, dict):
        head = bytes([MIXED]) + struct.pack(">I", len(value)) if isinstance(value, Mixed) else bytes([OBJECT])
        return head + b"".join(text(k) + amf_write(v) for k, v in value.items()) + b"\x00\x00\x09"
    if isinstance(value, list):
        return bytes([ARRAY]) + struct.pack(">I", len(value)) + b"".join(map(amf_write, value))
    raise TypeError(f"no AMF0 type for {type(value).__name__}")


def read_tags(data: bytes) -> Iterator[tuple[int, int, int, bytes, int]]:
    """(type, timestamp, size, body, size of the tag before as the file says)."""
    if data[:3] != b"FLV" or data[3] != 1:
        raise ValueError("not an FLV file of version 1")
    at = struct.unpack_from(">I", data, 5)[0]
    before = struct.unpack_from(">I", data, at)[0]
    at += 4
    while at + 11 <= len(data):
        size = int.from_bytes(data[at + 1 : at + 4], "big")
        ts = int.from_bytes(data[at + 4 : at + 7], "big") | data[at + 7] << 24
        yield data[at], ts, size, data[at + 11 : at + 11 + size], before
        at += 11 + size
        before = struct.unpack_from(">I", data, at)[0]
        at += 4


def write_tag(kind: int, ts: int, body: bytes) -> bytes:
    return bytes([kind]) + len(body).to_bytes(3, "big") + (ts & 0xFFFFFF).to_bytes(3, "big") + bytes([ts >> 24 & 255]) + b"\0\0\0" + body + struct.pack(">I", len(body) + 11)


def write_tags(tags: list[tuple[int, int, bytes]]) -> bytes:
    return b"".join([HEADER, *(write_tag(*x) for x in tags)])


def tag_rows(files: DataFrame, kinds: tuple[int, ...] | None = None) -> DataFrame:
    """One row a tag of (path, content), of tags of ``kinds`` only where they are given:
    the others then leave no task."""

    def of(batches):
        walked = ((part, i, *tag) for batch in batches for part, data in zip(batch["path"], batch["content"], strict=True) for i, tag in enumerate(read_tags(bytes(data))))
        every = walked if kinds is None else (row for row in walked if row[2] in kinds)
        yield from batched.tables(every, TAGS, 5)

    return files.select("path", "content").mapInPandas(of, TAGS)


def flv_tags(spark: SparkSession, path: str) -> DataFrame:
    """One row a tag of the files under ``path``."""
    return tag_rows(spark.read.format("binaryFile").load(path))


def rebased(tags: DataFrame, part: str = "part", ts: str = "ts") -> DataFrame:
    """Timestamps moved on by the last of each earlier part. The parts' ends are a
    row each, so the running sum is over parts, not over tags."""
    ends = tags.groupBy(part).agg(F.max(ts).alias("__end"))
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    moves = ends.select(part, F.coalesce(F.sum("__end").over(w), F.lit(0)).cast("long").alias("__move"))
    return tags.join(moves, part).withColumn(ts, F.col(ts) + F.col("__move")).drop("__move")


def join_files(files: list[bytes]) -> bytes:
    """Some FLV files as one: script data of the first with the durations summed,
    tags one after the other."""
    out, kinds, first, durations, move = bytearray(), set(), None, [], 0
    for data in files:
        last = 0
        for kind, ts, _, body, _ in read_tags(data):
            if kind == 18 and ts == 0:
                name, at = amf_read(body)
                meta = amf_read(body, at)[0]
                kinds.add((name, type(meta)))
                first = first or (name, meta)
                if isinstance(first[1], dict) and "duration" in first[1] and len(kinds) == 1:
                    durations.append(meta["duration"])
                continue
            out += write_tag(kind, ts + move, body)
            last = max(last, ts)
        move += last
    if len(kinds) > 1:
        raise ValueError("script data of different types")
    if first is None:
        return HEADER + bytes(out)
    name, meta = first
    if durations:
        meta["duration"] = sum(durations)
    return HEADER + write_tag(18, 0, amf_write(name) + amf_write(meta)) + bytes(out)


def join_all(files: DataFrame) -> DataFrame:
    """(job, content) of (job, part, content): each job's files as one."""
    return files.groupBy("job").applyInPandas(lambda key, rows: pd.DataFrame({"job": [key[0]], "content": [join_files([bytes(x) for x in rows.sort_values("part")["content"]])]}), f"job {dict(files.dtypes)['job']}, content binary")
