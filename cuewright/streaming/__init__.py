"""The interval operators over Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SEGMENT = "video_id long, start_ms long, end_ms long, texts array<string>"
STATE = "at long, texts array<string>"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    at, texts = state.get if state.exists else (0, [])
    rows = pd.concat(list(batches)).sort_values("time_ms", kind="stable")
    out = []
    for time_ms, now in zip(rows["time_ms"], rows["texts"], strict=True):
        out.append((key[0], at, int(time_ms), list(texts)))
        at, texts = int(time_ms), list(now)
    state.update((at, texts))
    yield pd.DataFrame(out, columns=["video_id", "start_ms", "end_ms", "texts"])


def segments(events: DataFrame) -> DataFrame:
    """(video_id, time_ms, texts) to closed segments: each event closes the one
    before it, an end event the last. Only the open segment of a video is state.
    Events of a video must come in order of time from batch to batch."""
    return events.select("video_id", "time_ms", "texts").groupBy("video_id").applyInPandasWithState(_advance, SEGMENT, STATE, "append", GroupStateTimeout.NoTimeout)


def late_segments(events: DataFrame, late: str, lanes: int = 512) -> DataFrame:
    """segments() of events that may come out of order, by up to ``late``: events wait,
    sorted, until the watermark has passed them. An event that comes when a later one
    of its video is out is dropped. The videos of one of ``lanes`` share a state."""
    name = [F.pmod(F.xxhash64("video_id"), F.lit(lanes)).cast("int").alias("lane"), F.coalesce("video_id", F.lit(0)).alias("video_id"), F.col("video_id").isNull().alias("unnamed")]
    timed = events.select(*name, "time_ms", "texts", F.timestamp_millis("time_ms").alias("ts")).withWatermark("ts", late)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        videos, at, texts, ids, times, waiting = state.get if state.exists else ([], [], [], [], [], [])
        known = {v: (t, list(x)) for v, t, x in zip(videos, at, texts, strict=True)}
        held = list(zip(times, map(list, waiting), ids, strict=True))
        if not state.hasTimedOut:
            for rows in batches:
                for v, none, t, x in zip(rows["video_id"], rows["unnamed"], rows["time_ms"], rows["texts"], strict=True):
                    video = None if none else int(v)
                    if t >= (known[video][0] if video in known else 0):
                        held.append((int(t), list(x), video))
        held.sort(key=lambda x: x[:2])
        passed, out = state.getCurrentWatermarkMs(), []
        due = sum(x[0] < passed for x in held)
        for time_ms, now, video in held[:due]:
            start, said = known.get(video, (0, []))
            out.append((video, start, time_ms, said))
            known[video] = (time_ms, now)
        held = held[due:]
        state.update((list(known), [t for t, _ in known.values()], [x for _, x in known.values()], [v for *_, v in held], [t for t, *_ in held], [x for _, x, _ in held]))
        if held:
            state.setTimeoutTimestamp(max(held[0][0], passed) + 1)
        found = pd.DataFrame(out, columns=["video_id", "start_ms", "end_ms", "texts"])
        yield found.assign(video_id=pd.array([r[0] for r in out], "Int64"))

    state = "videos array<long>, at array<long>, texts array<array<string>>, ids array<long>, times array<long>, waiting array<array<string>>"
    return timed.groupBy("lane").applyInPandasWithState(advance, SEGMENT, state, "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that the source has now, as a table in memory."""
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Only a session in
    one process (tests) may leave that unset, and gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cuewright-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_to_files(stream: DataFrame, path: str | None = None, conf: dict[str, str] | None = None) -> DataFrame:
    """All that the source has now, written as Parquet and read again. A ``path`` of
    an earlier run goes on where it ended. ``conf`` holds while the query starts."""
    spark = stream.sparkSession
    path = path or shared_path(spark, "stream")
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def per_minute(events: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Events a minute and their rate a second."""
    counts = events.withWatermark(ts, late).groupBy(F.window(ts, "1 minute")).agg(F.count("*").alias("frames"))
    return counts.select(F.col("window.start").alias("minute"), "frames", (F.col("frames") / 60).alias("rate"))


def file_stream(spark: SparkSession, path: str, schema, max_files: int = 1, latest_first: bool = False) -> DataFrame:
    """Parquet files as a stream, ``max_files`` a batch: what the source holds back
    while a batch is worked on."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("latestFirst", latest_first).parquet(path)


def poll(stream: DataFrame, run: Callable[[DataFrame], DataFrame], put: Callable[[DataFrame], None], checkpoint: str, seconds: int | None = None):
    """Jobs of a stream, run batch by batch: ``put`` gets what ``run`` makes of each.
    Looks for more every ``seconds``, or ends with what there is now."""

    def batch(jobs: DataFrame, _: int) -> None:
        put(run(jobs))

    trigger = {"processingTime": f"{seconds} seconds"} if seconds else {"availableNow": True}
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
