"""A data source of the packets of FLV files: ``spark.read.format("flv")``.

Options: ``path`` (a folder or file of a file system that pyarrow knows) and
``stream`` (video, audio, script or all). One partition a file; other streams'
packets are left out while reading.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cuewright.sources import flv

#: Tag types of each stream.
STREAMS = {"audio": (8,), "video": (9,), "script": (18,), "all": (8, 9, 18)}


class File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        path = options["path"]
        self.root, self.kinds = path if "://" in path else f"file://{path}", STREAMS[options.get("stream", "video")]

    def partitions(self) -> list[InputPartition]:
        where, inner = fs.FileSystem.from_uri(self.root)
        found = where.get_file_info(inner)
        if found.type == fs.FileType.Directory:
            listed = where.get_file_info(fs.FileSelector(inner, recursive=True))
            return [File(x.path) for x in sorted(listed, key=lambda x: x.path) if x.type == fs.FileType.File and x.extension in ("flv", "f4v")]
        return [File(inner)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        where, _ = fs.FileSystem.from_uri(self.root)
        with where.open_input_file(partition.path) as source:
            data = source.read()
        for seq, (kind, ts, _, body, _) in enumerate(flv.read_tags(data)):
            if kind in self.kinds:
                yield partition.path, seq, kind, ts, body


class FlvSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flv"

    def schema(self) -> str:
        return "video_id string, seq long, stream int, pts_ms long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FlvSource)
