"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders made within scratch().
MADE: ContextVar[list[str] | None] = ContextVar("MADE", default=None)
#: Whether the shuffle files of a query are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: White space of the word definitions.
WS = "[\\x20\\x09-\\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` names. Only where that is unset and the
    session runs in one process (tests) a temporary folder is made and remembered
    in the session; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("cuewright.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cuewright-")
        spark.conf.set("cuewright.shared.dir", found)
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: tuple[str, ...] = (), **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, a folder for each value of
    ``by``, and read it again: cuts lineage by files that outlive any executor.
    Shuffle files of the write go when it ends, as nothing reads them again."""
    spark = df.sparkSession
    path, before = shared_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if (made := MADE.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the folders that stored() makes within, but for those that are
    taken out of the list that this gives."""
    made: list[str] = []
    token = MADE.set(made)
    try:
        yield made
    finally:
        MADE.reset(token)
        for path in made:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(there, True)


def trim() -> None:
    """Gives a worker's freed memory back to the machine; else it is kept for the
    next task, beside the executor's own."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The column that packed() keeps a user's other columns in.
REST = "__rest"


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns that are there, and all others as fields of one, so that no
    name of theirs meets one of an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*[c for c in needed if c in docs.columns], (F.struct(*rest) if rest else F.lit(0)).alias(REST))


def unpacked(found: DataFrame, docs: DataFrame, *more: str) -> DataFrame:
    """The columns of ``docs`` of rows that packed() made, in their order, and ``more``."""
    inside = set(getattr(found.schema[REST].dataType, "names", []))
    return found.select(*[F.col(REST).getField(c).alias(c) if c in inside else F.col(c) for c in docs.columns if c not in more], *more)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the
    body uses it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, other letters unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS + "+", -1), "")


def literal_array(values: list, kind: str) -> Column:
    """An array literal of many numbers, made of one string that Catalyst folds."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


