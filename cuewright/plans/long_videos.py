"""Queries over one video of all events, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright.operators import ranges
from cuewright.operators import segments as S
from cuewright.plans.registry import FLAT, HOUR, SEGMENTS, TIME, merge_sql, query, read, timed
from cuewright.plans.registry import flat as flat_of

#: The CTEs of the registry for one video of all users' events, ties by text; the end's null text is the empty one.
ONE = SEGMENTS.replace("user_id as v", "0 as v").replace("order by t)", "order by t, coalesce(x, ''))")
TIED = lambda source, out: merge_sql(source, out).replace("order by a, b", "order by a, b, coalesce(x, '')")


def one_video(spark, sf):
    """All events as those of one video, in ranges of time."""
    return S.wide(S.with_end(timed(read(spark, sf, "events")).withColumn("video_id", F.lit(0).cast("long"))))


@query("with " + ONE + " " + FLAT + "s")
def long_segments(spark, sf):
    return flat_of(S.segments(one_video(spark, sf)))


@query("with " + ONE + TIED("s", "m") + " " + FLAT + "m")
def long_islands(spark, sf):
    return flat_of(S.merge(S.segments(one_video(spark, sf)), lines=False))


@query("with " + ONE + TIED("s", "m") + f", l as (select v, a, b, x from m where b - a > {HOUR // 36})" + TIED("l", "z") + f""", c as (select v as video_id, row_number() over (order by a, b, x) - 1 as cue_id, {TIME.format('a')} as start, {TIME.format('b')} as "end", x as body from z where x is not null) select video_id, cue_id, start, "end", body from c""")
def long_cues(spark, sf):
    """Cues of one long video, what lasts up to 100 seconds left out between the merges."""
    return S.cues(S.merge_twice(S.segments(one_video(spark, sf)), least_ms=HOUR // 36, lines=False))


@query("select o_orderkey, cast(sum(o_custkey) over (order by o_orderkey rows unbounded preceding) - o_custkey as bigint) as start_at, last_value(case when o_orderkey % 7 = 0 then o_orderpriority end ignore nulls) over (order by o_orderkey rows unbounded preceding) as priority from orders")
def long_offsets(spark, sf):
    """Where each order's bytes start in one long file, and the last priority told."""
    rows = ranges.cut(read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), [], ["o_orderkey"])
    placed = ranges.running(rows, [], ["o_orderkey"], "start_at", F.col("o_custkey"), so_far=False)
    told = ranges.last_known(placed, [], ["o_orderkey"], "priority", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderpriority")))
    return told.select("o_orderkey", "start_at", "priority")
