"""A sink of files that many tasks write together: ``df.write.format("ranges")``.

A row is a range of a file: (file, at, length, data, source, source_at), the bytes
``data``, or where that is null ``length`` bytes of another file from ``source_at``
on. Option ``path``: the folder. On a file system that takes writes at any place (a
shared mount), tasks write their ranges side by side into a hidden file; on others a
file's ranges must come to one task in order, which streams them: write_ranges() sees
to it. The hidden files get their names when all tasks have ended and every byte is
there; when one fails for good, they go. A task that runs again writes the same bytes.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "file string, at long, length long, data binary, source string, source_at long"
#: Bytes that are copied at a time.
BLOCK = 8 << 20


def opened(path: str):
    where, inner = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    return where.open_input_file(inner)


def blocks(row, sources: dict) -> Iterator[bytes]:
    """The bytes of a range, a block at a time."""
    if row.data is not None:
        yield bytes(row.data)
        return
    if row.source not in sources:
        for f in sources.values():
            f.close()
        sources.clear()
        sources[row.source] = opened(row.source)
    for at in range(0, row.length, BLOCK):
        found = sources[row.source].read_at(min(BLOCK, row.length - at), row.source_at + at)
        if len(found) < min(BLOCK, row.length - at):
            raise ValueError(f"{row.source} ends before {row.source_at + row.length}")
        yield found


@dataclass
class Written(WriterCommitMessage):
    """Bytes and greatest end by file."""

    files: dict[str, tuple[int, int]] = field(default_factory=dict)


class Writer(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.where, self.folder = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        self.uri, self.run = path, uuid.uuid4().hex

    def __getstate__(self) -> dict:
        return {"uri": self.uri, "run": self.run, "folder": self.folder}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.where = fs.FileSystem.from_uri(self.uri if ":" in self.uri else f"file://{self.uri}")[0]

    def hidden(self, file: str) -> str:
        return f"{self.folder}/.{self.run}/{file}"

    def write(self, iterator: Iterator) -> Written:
        done, sources, out, name = Written(), {}, None, None
        at_any_place = self.where.type_name == "local"
        for row in iterator:
            if row.file != name:
                out = self.closed(out)
                name, place = row.file, self.hidden(row.file)
                self.where.create_dir(place.rpartition("/")[0], recursive=True)
                out = os.open(place, os.O_CREAT | os.O_WRONLY) if at_any_place else self.where.open_output_stream(place)
            n, end = done.files.get(name, (0, 0))
            if not at_any_place and row.at != end:
                raise ValueError(f"ranges of {name} aren't in order at {row.at}")
            at = row.at
            for data in blocks(row, sources):
                while data:
                    put = os.pwrite(out, data, at) if at_any_place else out.write(data)
                    at, data = at + put, data[put:]
            if at != row.at + row.length:
                raise ValueError(f"range of {name} at {row.at} has {at - row.at} bytes")
            done.files[name] = n + row.length, max(end, at)
        self.closed(out)
        for f in sources.values():
            f.close()
        return done

    @staticmethod
    def closed(out) -> None:
        if isinstance(out, int):
            os.close(out)
        elif out is not None:
            out.close()

    def commit(self, messages: list) -> None:
        """Names of files and two numbers each come here, no bytes."""
        sums: dict[str, tuple[int, int]] = {}
        for message in messages:
            for file, (n, end) in (message.files if message else {}).items():
                had = sums.get(file, (0, 0))
                sums[file] = had[0] + n, max(had[1], end)
        for file, (n, end) in sums.items():
            if n != end:
                self.abort(messages)
                raise ValueError(f"{file} has {n} of {end} bytes")
        for file in sums:
            self.where.create_dir(f"{self.folder}/{file}".rpartition("/")[0], recursive=True)
            self.where.move(self.hidden(file), f"{self.folder}/{file}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        if self.where.get_file_info(f"{self.folder}/.{self.run}").type == fs.FileType.Directory:
            self.where.delete_dir(f"{self.folder}/.{self.run}")


class RangesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ranges"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options["path"])


def write_ranges(rows: DataFrame, folder: str) -> None:
    """Files of (file, at, length, data, source, source_at) below ``folder``. No two
    rows may tell of the same place, and none may be left out. No rows: no files."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(RangesSink)
    rows = rows.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in SCHEMA.split(", ")])
    where, _ = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
    if where.type_name == "local":
        dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "at")
    else:
        dealt = rows.repartition("file").sortWithinPartitions("file", "at")
    dealt.write.format("ranges").mode("append").option("path", folder).save()
