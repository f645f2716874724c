"""Queries of streams with state, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright import streaming
from cuewright.plans.registry import EPOCH, FLAT, flat, merge_sql, query, read, timed
from cuewright.sources import queue
from cuewright.streaming import sessions

SLICES = 6
#: Events that come when the watermark has passed them: some of the first half's.
DROPPED = "k % 50 = 7 and slice < 3"
SLICED = f"t0 as (select user_id as v, event_id as k, epoch_us(ts) // 1000 - {EPOCH} as t, event_type || ' ' || regexp_extract(props, '([0-9]+)', 1) as x from events), b as (select min(t) as lo, (max(t) - min(t)) // {SLICES} + 1 as span from t0), e as (select v, t, x from (select *, (t - lo) // span as slice from t0, b) where not ({DROPPED})), a as (select v, t, x from e union all select v, max(t) + 60000, null from e group by v)"
SEGMENTS = SLICED + ", s0 as (select v, t as a, lead(t) over (partition by v order by t, coalesce(x, '')) as b, x from a), s as (select v, a, b, x from s0 where b is not null union all select v, 0, min(t), null from a group by v)"


@query("with " + SEGMENTS + merge_sql("s", "m").replace("order by a, b", "order by a, b, coalesce(x, '')") + " " + FLAT + "m")
def stream_islands(spark, sf):
    """Merged islands of a stream of batches, one a slice of time. A quarter of the
    events comes a slice late, in time for the watermark; some come at last, too late."""
    source, late = sliced(spark, sf)
    found = streaming.run_to_files(sessions.islands(source, f"{late} milliseconds"), conf=sessions.CONF)
    return flat(found.where("video_id >= 0"))


@query("with " + SEGMENTS + " " + FLAT + "s")
def stream_delayed_segments(spark, sf):
    """Segments of the same stream, with the watermark's delay of some two slices."""
    source, late = sliced(spark, sf)
    found = streaming.run_to_files(sessions.segments(source, late), conf=sessions.CONF)
    return flat(found.where("video_id >= 0"))


def sliced(spark, sf):
    """A stream of batches of events, and by how many ms they may be late."""
    rows = numbered(read(spark, sf, "events"))
    low, span = rows.agg(F.min("time_ms"), F.floor((F.max("time_ms") - F.min("time_ms")) / SLICES) + 1).first()
    rows = rows.withColumn("slice", F.floor((F.col("time_ms") - low) / span))
    rows = rows.withColumn("late", F.expr(DROPPED))
    kept = rows.where("not late")
    ends = kept.groupBy("video_id").agg((F.max("time_ms") + 60_000).alias("time_ms")).withColumns({"texts": F.lit(None).cast("array<string>"), "k": F.lit(1), "late": F.lit(False), "slice": F.lit(SLICES)})
    every = rows.unionByName(ends).withColumn("batch", F.when(F.col("late"), SLICES + 1).otherwise(F.col("slice") + (F.col("k") % 4 == 0).cast("int")))
    schema, folder = "video_id long, time_ms long, texts array<string>", streaming.shared_path(spark, "batches")
    for batch in range(SLICES + 2):
        every.where(F.col("batch") == batch).select("video_id", "time_ms", "texts").repartition(4).write.mode("append").parquet(folder)
    for k in (1, 2):  # events that tell that time has passed
        spark.createDataFrame([(-1, low + (SLICES + 9) * span * k, [])], schema).write.mode("append").parquet(folder)
    source = streaming.file_stream(spark, folder, schema, max_files=4)
    return source, 2 * span + 60_000


def numbered(events):
    """timed() with the event's number."""
    rows = timed(events.withColumn("user_id", F.struct("user_id", "event_id")))
    return rows.select(F.col("video_id.user_id").alias("video_id"), "time_ms", "texts", F.col("video_id.event_id").alias("k"))


@query("with j as (select event_id, user_id, row_number() over (order by event_id) - 1 as i, count(*) over () as n from events where event_type = 'signup') select cast(event_id as varchar) as unique_id, 'user/' || user_id as url, cast(i // (n // 3 + 1) as bigint) as batch from j")
def job_stream(spark, sf):
    """Jobs of a queue, in three runs that each take up where the one before ended; the
    second half is put into the queue after the first run."""
    jobs = read(spark, sf, "events").where("event_type = 'signup'").select("event_id", F.col("event_id").alias("unique_id"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("url"))
    n, middle = jobs.agg(F.count("*"), F.percentile("event_id", F.lit(0.5))).first()
    path = streaming.shared_path(spark, "jobs")
    queue.enqueue(jobs.where(F.col("event_id") <= middle), f"{path}/queue", "0", "event_id")
    for k in range(3):
        found = queue.stream(spark, f"{path}/queue", f"{path}/log", limit=n // 3 + 1)
        queue.serve(found, lambda rows: rows, f"{path}/done", f"{path}/log").awaitTermination()
        if k == 0:
            queue.enqueue(jobs.where(F.col("event_id") > middle), f"{path}/queue", "1", "event_id")
    return spark.read.schema(queue.JOBS + ", batch long").parquet(f"{path}/done").select("unique_id", "url", "batch")
