"""Interval operators: events to segments, merged islands, cues.

A video is a task's work, unless its events went through wide(): then its rows stay
in ranges of time through all operators of single lines, and many tasks share them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions.text import edit_ratio, filtered_lines, time_string
from cuewright.operators import ranges
from cuewright.operators.assign import assign
from cuewright.store import stored

SEGMENT = "video_id long, start_ms long, end_ms long, texts array<string>"
THRESHOLD = 0.8
MIN_DURATION = 100


def with_end(events: DataFrame, extra_ms: int = 60_000) -> DataFrame:
    """(video_id, time_ms, texts) and one closing row a video."""
    last = events.groupBy("video_id").agg((F.max("time_ms") + extra_ms).alias("time_ms"))
    return events.unionByName(last.withColumn("texts", F.array().cast("array<string>")))


def _order(*columns: str) -> list:
    return [*columns, F.array_join("texts", "\n")]


def wide(events: DataFrame, parts: int | None = None) -> DataFrame:
    """Events in ranges of time, so that a long video is the work of many tasks."""
    return ranges.cut(events.select("video_id", "time_ms", "texts"), ["video_id"], _order("time_ms"), parts)


def _kept(rows: DataFrame) -> list[str]:
    return [ranges.RANGE] * ranges.is_cut(rows)


def segments(events: DataFrame) -> DataFrame:
    """[t, next t) with the texts of t, and an empty one from 0 to the first."""
    own = ["video_id", *_kept(events)]
    marked = ranges.beside(events.select(*own, "time_ms", "texts"), ["video_id"], _order("time_ms"), {"before": F.lit(1)}, {"end_ms": F.col("time_ms")})
    none = F.array().cast("array<string>")
    rows = F.array(F.struct(F.when(F.col("before").isNull(), F.lit(0).cast("long")).alias("start_ms"), F.col("time_ms").alias("end_ms"), none.alias("texts")), F.struct(F.col("time_ms").alias("start_ms"), "end_ms", "texts"))
    return marked.select(*own, F.explode(rows).alias("s")).where("s.start_ms is not null and s.end_ms is not null").select(*own, "s.*")


def distance(a: str, b: str) -> int:
    """Edit distance, a column of the table at a time as bits of two numbers: where
    it grows and where it falls by 1 from one place of ``a`` to the next."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    every, last, found = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    grows, falls = every, 0
    for ch in b:
        same = at.get(ch, 0)
        level = ((same & grows) + grows ^ grows) | same | falls
        up, down = falls | ~(level | grows) & every, grows & level
        found += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & every, down << 1 & every
        grows, falls = down | ~(same | falls | up) & every, up & (same | falls)
    return found


def _ratio(a: str, b: str) -> float:
    n = np.float32(len(a) + len(b))
    return np.float32(n - np.float32(distance(a, b))) / n if n else np.float32("nan")


def match_lines(a: list[str], b: list[str], scale: float = 1000.0) -> list[int]:
    """For each line of ``a`` the line of ``b``, at the least cost of all; ties: the
    first of such matchings in the order of their lines of ``b``."""
    if len(a) == len(b) == 1:
        return [0]
    size = len(b) + 1
    return assign([[int((np.float32(1) - _ratio(x, y)) * np.float32(scale)) * size ** (len(a) + 1) + j * size ** (len(a) - i) for j, y in enumerate(b)] for i, x in enumerate(a)])


def alike(a: list[str], b: list[str], least: float = THRESHOLD) -> bool:
    """Whether texts have as many lines, each at least so like the one it matches."""
    return len(a) == len(b) and all(_ratio(a[i], b[j]) >= np.float32(least) for i, j in enumerate(match_lines(a, b)))


def _steps(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    out = []
    for x, y, t in zip(a, b, least, strict=True):
        both = x is not None and y is not None and len(x) == len(y) > 1  # others aren't asked for
        out.append(match_lines(list(x), list(y)) if both and alike(list(x), list(y), t) else None)
    return pd.Series(out, index=a.index, dtype=object)


def mergeable(a: Column, b: Column, threshold: float = THRESHOLD, lines: bool = True) -> Column:
    """The matching (place in ``b`` of each line of ``a``) of neighbouring segments that
    say the same, else null: as many significant lines, each matched pair at least
    ``threshold`` alike. ``lines`` False: for texts of one line at most, without
    Python."""
    least, same = F.lit(threshold).cast("float"), F.size(a) == F.size(b)
    alone = edit_ratio(F.get(a, F.lit(0)), F.get(b, F.lit(0))) >= least
    single = F.when(same & (F.size(a) == 0), F.array().cast("array<int>")).when(same & (F.size(a) == 1) & alone, F.array(F.lit(0)))
    if not lines:
        return single
    several = same & (F.size(a) > 1)
    pairs = F.pandas_udf(_steps, "array<int>")(F.when(several, a), F.when(several, b), least)
    return F.coalesce(single, pairs)


def islands(segs: DataFrame, threshold: float = THRESHOLD, lines: bool = True) -> DataFrame:
    """Segments with the number of the run of mergeable neighbours that each is in, and
    the step to each from the one before it in its run."""
    order = _order("start_ms", "end_ms")
    marked = ranges.beside(segs.withColumn("filtered", filtered_lines(F.col("texts"))), ["video_id"], order, {"before": F.col("filtered")})
    stepped = marked.withColumn("step", F.when(F.col("before").isNotNull(), mergeable(F.col("before"), F.col("filtered"), threshold, lines)))
    return ranges.running(stepped, ["video_id"], order, "island", F.col("step").isNull().cast("int")).drop("before")


def voted(n: int, said: list[tuple[int, str, int]]) -> list[str]:
    """What each of ``n`` lines said longest, of (line, text, time); ties: the least
    text, no time: an empty one."""
    sums: list[dict[str, int]] = [{} for _ in range(n)]
    for line, text, ms in said:
        sums[line][text] = sums[line].get(text, 0) + ms
    best = [max(x.values(), default=0) for x in sums]
    return [min(t for t, d in x.items() if d == b) if b > 0 else "" for x, b in zip(sums, best, strict=True)]


def merge(segs: DataFrame, threshold: float = THRESHOLD, lines: bool = True) -> DataFrame:
    """Each run as one segment from its start to its end; each tracked line says
    what it said for the longest time in all (ties: the least text; no time: "").

    A run's lines are those of its first segment. Where they go is the product of the
    steps so far, of which only those that move a line are kept, a short list a run.
    All else is sums, so a run of any length is shared by tasks."""
    keep, key = _kept(segs), ["video_id", "island"]
    found = islands(segs, threshold, lines)
    hull = [F.min("start_ms").alias("a"), F.max("end_ms").alias("b"), *[F.min(c).alias(c) for c in keep]]
    if not lines:
        again = [F.min("a").alias("start_ms"), F.max("b").alias("end_ms"), *hull[2:]]
        each = found.groupBy(*key, F.get("texts", F.lit(0)).alias("t")).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("d"), *hull)
        best = F.min(F.when(F.col("t").isNotNull(), F.struct((-F.col("d")).alias("d"), "t")))
        texts = F.when(F.col("v").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.when(F.col("v.d") < 0, F.col("v.t")).otherwise("")))
        return each.groupBy(*key).agg(*again, best.alias("v")).select("video_id", *keep, "start_ms", "end_ms", texts.alias("texts"))
    place = F.struct("start_ms", "end_ms", F.array_join("texts", "\n").alias("text"))
    found = stored(found.withColumn("at", place), "islands")  # lines are matched once
    moves = F.col("step") != F.sequence(F.lit(0), F.size("step") - 1)
    swaps = F.array_sort(F.collect_list(F.when((F.size("step") > 1) & moves, F.struct("at", "step"))))
    runs = found.groupBy(*key).agg(F.min_by(F.size("texts"), "at").alias("n"), swaps.alias("swaps"), *hull)
    named = runs.select(F.col("video_id").alias("v"), F.col("island").alias("i"), "n", "swaps")
    known = found.join(named, found.video_id.eqNullSafe(named.v) & (found.island == named.i)).where("n > 0")
    first = F.aggregate(F.filter("swaps", lambda x: x["at"] <= F.col("at")), F.col("line"), lambda p, x: F.coalesce(F.get(x["step"], p), p))
    each = known.withColumn("line", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    said = each.select(*key, "line", F.get("texts", first).alias("t"), (F.col("end_ms") - F.col("start_ms")).alias("d")).where("t is not null")
    sums = said.groupBy(*key, "line", "t").agg(F.sum("d").alias("d"))
    best = sums.groupBy(*key, "line").agg(F.min(F.struct((-F.col("d")).alias("d"), "t")).alias("v"))
    texts = best.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("line", F.when(F.col("v.d") < 0, F.col("v.t")).otherwise("").alias("t")))).alias("m"))
    told = texts.select(F.col("video_id").alias("v"), F.col("island").alias("i"), "m")
    whole = runs.drop("swaps").join(told, runs.video_id.eqNullSafe(told.v) & (runs.island == told.i), "left")
    all_lines = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.col("m")[i], F.lit("")))
    return whole.select("video_id", *keep, F.col("a").alias("start_ms"), F.col("b").alias("end_ms"), F.when(F.col("n") > 0, all_lines).otherwise(F.array().cast("array<string>")).alias("texts"))


def long_enough(segs: DataFrame, least_ms: int = MIN_DURATION) -> DataFrame:
    return segs.where(F.col("end_ms") - F.col("start_ms") > least_ms)


def merge_twice(segs: DataFrame, threshold: float = THRESHOLD, least_ms: int = MIN_DURATION, lines: bool = True) -> DataFrame:
    """Merge, drop what is too short, merge again."""
    return merge(long_enough(merge(segs, threshold, lines), least_ms), threshold, lines)


def cues(segs: DataFrame) -> DataFrame:
    """Numbered from 0 in each video; empty segments take no number."""
    full = ranges.running(segs.where(F.size("texts") > 0), ["video_id"], _order("start_ms", "end_ms"), "cue_id", F.lit(1), so_far=False)
    return full.select("video_id", F.col("cue_id").cast("long").alias("cue_id"), time_string(F.col("start_ms")).alias("start"), time_string(F.col("end_ms")).alias("end"), F.array_join("texts", "\n").alias("body"))


def document(found: DataFrame) -> DataFrame:
    """A WEBVTT document a video."""
    one = F.concat(F.col("cue_id").cast("string"), F.lit("\n"), "start", F.lit(" --> "), "end", F.lit("\n"), "body", F.lit("\n\n"))
    parts = F.array_sort(F.collect_list(F.struct("cue_id", one.alias("c"))))
    return found.groupBy("video_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(parts, lambda x: x["c"]), "")).alias("vtt"))
