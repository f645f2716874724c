"""A job queue as a streaming source: ``spark.readStream.format("jobs")``.

The queue is a folder of folders that enqueue() writes, each with Parquet files and
complete from the start; jobs are in order of folder, file and row, and folders' names
must rise. An offset is a file and a row in it. A batch, or a run of availableNow,
admits ``limit`` jobs at most. What has been admitted is kept in the query's checkpoint
(option ``checkpoint``, the folder given as checkpointLocation), so a query that starts
again goes on there; a batch that was planned and not ended is read again as it was.

The driver lists names and reads the row counts of the files that a batch may reach into;
rows are read by tasks, a slice of a file each. Rows: (unique_id, url, place), ``place``
telling the job's file and row.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

JOBS = "unique_id string, url string, place string"
LIMIT = 20


def system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


@dataclass
class Slice(InputPartition):
    """Rows ``first`` up to ``last`` of a file."""

    file: str
    first: int
    last: int


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.checkpoint, self.limit = options["path"], options["checkpoint"], int(options.get("limit", LIMIT))
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"file": "", "row": 0}

    def files(self, first: str) -> list[str]:
        """Names of the queue's files from ``first`` on."""
        where, root = system(self.folder)
        if where.get_file_info(root).type == fs.FileType.NotFound:
            return []
        found = where.get_file_info(fs.FileSelector(root, recursive=True))
        whole = {x.path.rpartition("/")[0] for x in found if x.base_name == "_SUCCESS"}
        names = sorted(x.path[len(root.rstrip("/")) + 1 :] for x in found if x.extension == "parquet" and x.base_name[0] not in "._" and x.path.rpartition("/")[0] in whole)
        return [x for x in names if x >= first]

    def rows(self, file: str) -> int:
        where, root = system(self.folder)
        with where.open_input_file(f"{root}/{file}") as f:
            return pq.read_metadata(f).num_rows

    def admitted(self) -> dict:
        """Where the last planned batch ended."""
        where, root = system(self.checkpoint)
        if self.at is None and where.get_file_info(f"{root}/admitted.json").type == fs.FileType.File:
            with where.open_input_file(f"{root}/admitted.json") as f:
                self.at = json.loads(f.read())
        return self.at or self.initialOffset()

    def slices(self, start: dict, end: dict | None = None, most: int | None = None) -> Iterator[Slice]:
        """What lies between two offsets, or from one on up to ``most`` rows."""
        for file in self.files(start["file"]):
            if end and file > end["file"]:
                return
            first = start["row"] if file == start["file"] else 0
            last = end["row"] if end and file == end["file"] else self.rows(file)
            if most is not None:
                last = min(last, first + most)
                most -= last - first
            if last > first:
                yield Slice(file, first, last)
            if most == 0:
                return

    def latestOffset(self) -> dict:
        at = self.admitted()
        for own in self.slices(at, most=self.limit):
            at = {"file": own.file, "row": own.last}
        return at

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        where, root = system(self.checkpoint)
        where.create_dir(root, recursive=True)
        hidden = f"{root}/.{uuid.uuid4().hex}"
        with where.open_output_stream(hidden) as out:
            out.write(json.dumps(end).encode())
        where.move(hidden, f"{root}/admitted.json")
        self.at = end
        return list(self.slices(start, end))

    def read(self, partition: Slice) -> Iterator[tuple]:
        where, root = system(self.folder)
        with where.open_input_file(f"{root}/{partition.file}") as f:
            at = 0
            for batch in pq.ParquetFile(f).iter_batches(columns=["unique_id", "url"]):
                low, high = max(partition.first - at, 0), min(partition.last - at, len(batch))
                for i, (job, url) in enumerate(zip(*(c.to_pylist() for c in batch.slice(low, max(0, high - low)).columns), strict=True)):
                    yield job, url, f"{partition.file}:{at + low + i}"
                at += len(batch)
                if at >= partition.last:
                    return


class JobSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jobs"

    def schema(self) -> str:
        return JOBS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Reader(dict(self.options))


def enqueue(jobs: DataFrame, folder: str, name: str, order: str) -> None:
    """Puts (unique_id, url) into the queue by ``order``, as the folder ``name``, which
    must come after all names before it. No part of it is seen before all is there."""
    parts = int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = jobs.repartitionByRange(parts, order).sortWithinPartitions(order)
    ordered.select(F.col("unique_id").cast("string"), F.col("url").cast("string")).write.parquet(f"{folder.rstrip('/')}/{name}")


def stream(spark: SparkSession, folder: str, checkpoint: str, limit: int = LIMIT) -> DataFrame:
    """The queue's jobs; start the query with the same ``checkpoint``."""
    spark.dataSource.register(JobSource)
    return spark.readStream.format("jobs").options(path=folder, checkpoint=checkpoint, limit=limit).load()


def serve(jobs: DataFrame, run: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, seconds: int | None = None):
    """Runs each batch of stream() and writes what comes of it to ``out``/batch=n; a
    batch that runs again replaces its results. Looks for more every ``seconds``, or ends
    with one batch."""

    def batch(rows: DataFrame, n: int) -> None:
        run(rows).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={n}")

    trigger = {"processingTime": f"{seconds} seconds"} if seconds else {"availableNow": True}
    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
