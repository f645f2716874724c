"""MP4 files: atoms as rows, sample tables, merged tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.sources import batches as batched

ATOMS = "file string, path string, type string, offset long, size long, body binary"
#: Atoms that hold atoms, and those whose bodies aren't loaded.
CONTAINERS = frozenset("moov trak mdia minf dinf stbl edts".split())
LAZY = frozenset(("mdat",))
#: Struct formats of the rows of each sample table.
SAMPLE_TABLES = {"stts": (">II", ("count", "duration")), "stss": (">I", ("sample",)), "stsc": (">III", ("first_chunk", "samples", "desc")), "stco": (">I", ("offset",)), "co64": (">Q", ("offset",)), "ctts": (">II", ("count", "offset"))}


def atoms(data: bytes, at: int = 0, end: int | None = None, path: str = "") -> Iterator[tuple[str, str, int, int, bytes | None]]:
    """(path, type, offset, size, body) of all atoms in file order; containers and
    media data have no body."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind, head = struct.unpack_from(">I", data, at)[0], data[at + 4 : at + 8].decode("latin-1"), 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"atom {kind} at {at} is cut off")
        here = f"{path}/{kind}"
        bare = kind in CONTAINERS or kind in LAZY
        yield here, kind, at, size, None if bare else data[at + head : at + size]
        if kind in CONTAINERS:
            yield from atoms(data, at + head, at + size, here)
        at += size


def head_atoms(file) -> Iterator[tuple[str, str, int, int, bytes | None]]:
    """atoms() of an open file whose media data isn't read."""
    at, end = 0, file.size()
    while at + 8 <= end:
        head = file.read_at(16, at)
        size, kind = struct.unpack_from(">I", head)[0], head[4:8].decode("latin-1")
        size = struct.unpack_from(">Q", head, 8)[0] if size == 1 else size or end - at
        if size < 8 or at + size > end:
            raise ValueError(f"atom {kind} at {at} is cut off")
        if kind in LAZY:
            yield f"/{kind}", kind, at, size, None
        else:
            for path, own, inner, n, body in atoms(file.read_at(size, at)):
                yield path, own, at + inner, n, body
        at += size


def walked(file, at: int = 0, end: int | None = None, path: str = "") -> Iterator[tuple[str, str, int, int, int]]:
    """(path, type, offset, place of the body, end) of the atoms() of an open file, of
    which only heads are read."""
    end = file.size() if end is None else end
    while at + 8 <= end:
        head = file.read_at(min(16, end - at), at)
        size, kind, own = struct.unpack_from(">I", head)[0], head[4:8].decode("latin-1"), 8
        if size == 1:
            size, own = struct.unpack_from(">Q", head, 8)[0], 16
        elif size == 0:
            size = end - at
        if size < own or at + size > end:
            raise ValueError(f"atom {kind} at {at} is cut off")
        yield f"{path}/{kind}", kind, at, at + own, at + size
        if kind in CONTAINERS:
            yield from walked(file, at + own, at + size, f"{path}/{kind}")
        at += size


def atom_rows(files: DataFrame) -> DataFrame:
    """One row an atom of (path, content); each file has one moov and one mdat."""

    def each(batches):
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                rows = [(file, *x) for x in atoms(bytes(data))]
                if any(sum(r[1] == f"/{k}" for r in rows) != 1 for k in ("moov", "mdat")):
                    raise ValueError(f"{file} hasn't one moov and one mdat")
                yield from rows

    def of(batches):
        yield from batched.tables(each(batches), ATOMS, 5)

    return files.select("path", "content").mapInPandas(of, ATOMS)


def mp4_atoms(spark: SparkSession, path: str) -> DataFrame:
    """One row an atom of the files under ``path``."""
    return atom_rows(spark.read.format("binaryFile").load(path))


def sample_rows(found: DataFrame, kind: str) -> DataFrame:
    """(file, path, sample from 0, values) of the sample tables of a kind."""

    @F.pandas_udf("array<array<long>>")
    def rows(body: pd.Series) -> pd.Series:
        return pd.Series([table_array(kind, bytes(b)).tolist() for b in body], index=body.index, dtype=object)

    each = found.where(F.col("type") == kind).select("file", "path", F.posexplode(rows("body")).alias("sample", "values"))
    return each.withColumn("sample", F.col("sample").cast("long"))


def sample_table(kind: str, body: bytes) -> list[tuple[int, ...]]:
    """Rows of an stts, stss, stsc, stco, ctts or stsz body."""
    if kind == "stsz":
        size, n = struct.unpack_from(">II", body, 4)
        return [(size,)] * n if size else [(x,) for x in struct.unpack_from(f">{n}I", body, 12)]
    form = SAMPLE_TABLES[kind][0]
    return list(struct.iter_unpack(form, body[8 : 8 + struct.unpack_from(">I", body, 4)[0] * struct.calcsize(form)]))


def table_array(kind: str, body: bytes) -> np.ndarray:
    """sample_table() as an array of a row a row, without an object a number."""
    if kind == "stsz":
        size, n = struct.unpack_from(">II", body, 4)
        return np.full((n, 1), size, np.int64) if size else np.frombuffer(body, ">u4", n, 12).astype(np.int64).reshape(-1, 1)
    own, width = np.dtype(">u8" if kind == "co64" else ">u4"), len(SAMPLE_TABLES[kind][1])
    rows = body[8 : 8 + struct.unpack_from(">I", body, 4)[0] * own.itemsize * width]
    return np.frombuffer(rows, own).astype(np.int64).reshape(-1, width)


def write_atom(kind: str, body: bytes) -> bytes:
    return struct.pack(">I", len(body) + 8) + kind.encode("latin-1") + body


def write_table(kind: str, rows: list[tuple[int, ...]]) -> bytes:
    if kind == "stsz":
        return write_atom(kind, struct.pack(">III", 0, 0, len(rows)) + b"".join(struct.pack(">I", *r) for r in rows))
    return write_atom(kind, struct.pack(">II", 0, len(rows)) + b"".join(struct.pack(SAMPLE_TABLES[kind][0], *r) for r in rows))


def header(kind: str, body: bytes) -> dict[str, int]:
    """Time scale and duration of an mvhd or mdhd body, duration of a tkhd."""
    wide = body[0] == 1
    if kind == "tkhd":
        return {"duration": struct.unpack_from(">Q" if wide else ">I", body, 28 if wide else 20)[0]}
    scale, duration = struct.unpack_from(">IQ" if wide else ">II", body, 20 if wide else 12)
    return {"timescale": scale, "duration": duration}


def _moves(rows: DataFrame, key: list[str], size) -> DataFrame:
    """(key, part) with the sum of ``size`` over the earlier parts, as move."""
    each = rows.groupBy(*key, "part").agg(size.cast("long").alias("__n"))
    w = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(*key, "part", F.coalesce(F.sum("__n").over(w), F.lit(0)).cast("long").alias("move"))


def merge_offsets(rows: DataFrame, key: list[str], column: str, size) -> DataFrame:
    """``column`` moved on by the sizes of the earlier parts (stss by samples, stsc
    by chunks, stco by bytes)."""
    return rows.join(_moves(rows, key, size), [*key, "part"]).withColumn(column, F.col(column) + F.col("move")).drop("move")


def merge_stts(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row where all durations are equal, else all rows as they are."""
    total = rows.groupBy(*key).agg(F.countDistinct("duration").alias("kinds"), F.sum("count").alias("all"), F.min("duration").alias("only"))
    single = total.where("kinds = 1").select(*key, F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("seq"), F.col("all").alias("count"), F.col("only").alias("duration"))
    return single.unionByName(rows.select(*key, "part", "seq", "count", "duration").join(total.where("kinds > 1").select(*key), key, "left_semi"))


def chunks_of_runs(rows: DataFrame, key: list[str], total: str) -> DataFrame:
    """stsc rows with the number of chunks that each stands for; ``total``: the
    column with the number of all chunks."""
    w = Window.partitionBy(*key).orderBy("first_chunk")
    return rows.withColumn("chunks", F.coalesce(F.lead("first_chunk").over(w), F.col(total) + 1) - F.col("first_chunk"))


def merge_files(files: list[bytes]) -> bytes:
    """Some MP4 files of the same tracks as one: media data one after the other,
    durations summed, sample tables merged with chunk offsets moved."""
    parsed = [list(atoms(x)) for x in files]
    bodies = [{k: [y for y in p if y[1] == k] for k in ("mvhd", "tkhd", "mdhd", *SAMPLE_TABLES, "stsz")} for p in parsed]
    media = [next(y for y in p if y[1] == "mdat") for p in parsed]
    data = b"".join(f[m[2] + 8 : m[2] + m[3]] for f, m in zip(files, media, strict=True))
    starts = [sum(m[3] - 8 for m in media[:i]) for i in range(len(files))]
    n_tracks = len(bodies[0]["mdhd"])
    if any(len(b["mdhd"]) != n_tracks for b in bodies):
        raise ValueError("files have different tracks")
    merged: dict[int, bytes] = {}  # by offset of the atom in the first file

    def duration(kind: str, i: int) -> None:
        first = bytearray(bodies[0][kind][i][4])
        place, form = {"tkhd": (28, ">Q") if first[0] == 1 else (20, ">I")}.get(kind, (24, ">Q") if first[0] == 1 else (16, ">I"))
        struct.pack_into(form, first, place, sum(header(kind, b[kind][i][4])["duration"] for b in bodies))
        merged[bodies[0][kind][i][2]] = write_atom(kind, bytes(first))

    def tables(i: int, move: int) -> None:
        rows = {k: [sample_table(k, b[k][i][4]) if i < len(b[k]) else [] for b in bodies] for k in (*SAMPLE_TABLES, "stsz")}
        samples, chunks = [len(x) for x in rows["stsz"]], [len(a) + len(b) for a, b in zip(rows["stco"], rows["co64"], strict=True)]
        made = {"stts": sum(rows["stts"], []), "ctts": sum(rows["ctts"], []), "stsz": sum(rows["stsz"], [])}
        if len({d for _, d in made["stts"]}) == 1:
            made["stts"] = [(sum(n for n, _ in made["stts"]), made["stts"][0][1])]
        made["stss"] = [(s + sum(samples[:p]),) for p, r in enumerate(rows["stss"]) for (s,) in r]
        made["stsc"] = [(c + sum(chunks[:p]), *rest) for p, r in enumerate(rows["stsc"]) for c, *rest in r]
        for k in ("stco", "co64"):
            made[k] = [(o - media[p][2] - 8 + starts[p] + move,) for p, r in enumerate(rows[k]) for (o,) in r]
        for k, r in made.items():
            if i < len(bodies[0][k]):
                merged[bodies[0][k][i][2]] = write_table(k, r)

    def write(inside: str, level: list) -> bytes:
        out = b""
        for path, kind, offset, size, body in level:
            if path.rpartition("/")[0] != inside or kind in ("mdat", "udta"):
                continue
            if kind in CONTAINERS:
                own = [y for y in level if y[2] > offset and y[2] < offset + size]
                out += write_atom(kind, write(path, own))
            else:
                out += merged.get(offset, write_atom(kind, body or b""))
        return out

    for k in ("mvhd", "tkhd", "mdhd"):
        for i in range(len(bodies[0][k])):
            duration(k, i)
    move = 0
    for _ in range(2):  # the second time the tables' sizes are known
        for i in range(n_tracks):
            tables(i, move)
        head = write("", parsed[0])
        move = len(head) + 8
    return head + write_atom("mdat", data)


def merge_sizes(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, sample, size): the parts' sizes one after the other, samples from 1."""
    w = Window.partitionBy(*key).orderBy("part", "seq")
    return rows.select(*key, F.row_number().over(w).cast("long").alias("sample"), "size")


def details(kind: str, body: bytes) -> dict:
    """Fields of an hdlr, vmhd, stsd, avc1 or avcC body."""
    if kind == "hdlr":
        return {"component": body[4:8].decode("latin-1"), "handler": body[8:12].decode("latin-1"), "name": body[24:].split(b"\0")[0].decode("utf-8", "replace")}
    if kind == "vmhd":
        mode, *colour = struct.unpack_from(">4H", body, 4)
        return {"mode": mode, "colour": tuple(colour)}
    if kind == "stsd":
        entries, at = [], 8
        for _ in range(struct.unpack_from(">I", body, 4)[0]):
            size, name = struct.unpack_from(">I", body, at)[0], body[at + 4 : at + 8].decode("latin-1")
            entries.append((name, body[at + 8 : at + size]))
            at += size
        return {"entries": entries}
    if kind == "avc1":
        width, height = struct.unpack_from(">2H", body, 24)
        frames, depth = struct.unpack_from(">H", body, 40)[0], struct.unpack_from(">H", body, 74)[0]
        return {"reference": struct.unpack_from(">H", body, 6)[0], "width": width, "height": height, "frames": frames, "depth": depth, "inner": [(k, b) for _, k, _, _, b in atoms(body, 78)]}
    if kind == "avcC":
        at, sets = 5, []
        for mask in (0x1F, 0xFF):
            n, at, own = body[at] & mask, at + 1, []
            for _ in range(n):
                size = struct.unpack_from(">H", body, at)[0]
                own.append(body[at + 2 : at + 2 + size])
                at += 2 + size
            sets.append(own)
        return {"profile": body[1], "level": body[3], "length_size": (body[4] & 3) + 1, "sps": sets[0], "pps": sets[1]}
    raise ValueError(f"no details of {kind}")


def annex_b(data: bytes, length_size: int, before: list[bytes] = ()) -> bytes:
    """Units with lengths as units with start codes, ``before`` them some sets."""
    out, at = [b"\0\0\0\1" + x for x in before], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + length_size], "big")
        at += length_size
        if at + size > len(data):
            raise ValueError("a unit is cut off")
        out.append(b"\0\0\0\1" + data[at : at + size])
        at += size
    return b"".join(out)


def join_all(files: DataFrame) -> DataFrame:
    """(job, content) of (job, part, content): each job's files as one."""
    return files.groupBy("job").applyInPandas(lambda key, rows: pd.DataFrame({"job": [key[0]], "content": [merge_files([bytes(x) for x in rows.sort_values("part")["content"]])]}), f"job {dict(files.dtypes)['job']}, content binary")
