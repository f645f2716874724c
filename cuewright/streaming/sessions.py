"""Segments of late events, and sessions by likeness: merged islands of segments, as
their events come."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuewright.functions.text import filtered_lines
from cuewright.operators.segments import SEGMENT, THRESHOLD, alike, match_lines, voted

#: Lanes that videos are dealt to. Those of a lane share a state, which is read and
#: written once a batch or timer and not once a video: each access is a message.
LANES = 512
#: What transformWithState needs of a session.
CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def dealt(events: DataFrame, lanes: int, *more: Any) -> DataFrame:
    """Events with their lane and time; ``unnamed`` tells null videos, as pandas has no
    null among whole numbers."""
    name = [F.pmod(F.xxhash64("video_id"), F.lit(lanes)).cast("int").alias("lane"), F.coalesce("video_id", F.lit(0)).alias("video_id"), F.col("video_id").isNull().alias("unnamed")]
    return events.select(*name, "time_ms", "texts", *more, F.timestamp_millis("time_ms").alias("ts"))


def videos(batch: pd.DataFrame) -> list[int | None]:
    return [None if none else int(v) for v, none in zip(batch["video_id"], batch["unnamed"], strict=True)]


def told(rows: list[tuple]) -> pd.DataFrame:
    """(video_id, start_ms, end_ms, texts)."""
    ids, starts, ends, texts = ([r[i] for r in rows] for i in range(4))
    return pd.DataFrame({"video_id": pd.array(ids, "Int64"), "start_ms": pd.array(starts, "int64"), "end_ms": pd.array(ends, "int64"), "texts": pd.Series(texts, dtype=object)})


class Islands(StatefulProcessor):
    """State of a lane: the events that wait for the watermark, by slices of time, and
    of each video the segment that is open, the island that it may join, and how long
    the island's lines said what."""

    def __init__(self, threshold: float, idle_ms: int | None, width: int) -> None:
        self.threshold, self.idle_ms, self.width = threshold, idle_ms, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slice long", "videos array<long>, times array<long>, texts array<array<string>>, filtered array<array<string>>, ends array<boolean>")
        self.slices = handle.getValueState("slices", "places array<long>, firsts array<long>")
        self.videos = handle.getListState("videos", "video_id long, at long, texts array<string>, filtered array<string>, start_ms long, end_ms long, own array<string>, places array<int>, lines array<int>, said array<string>, ms array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, new = self.known(), []
        for batch in rows:
            for video, time_ms, texts, filtered in zip(videos(batch), batch["time_ms"], batch["texts"], batch["filtered"], strict=True):
                if time_ms >= (known[video]["at"] if video in known else 0):  # else a later one has been counted
                    new.append((int(time_ms), [] if texts is None else list(texts), [] if filtered is None else list(filtered), texts is None, video))
        yield self.advanced(known, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.advanced(self.known(), [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def known(self) -> dict[int | None, dict]:
        """The state of the lane's videos that have an open segment."""
        out = {}
        for video, at, texts, filtered, start, end, own, places, lines, said, ms in self.videos.get() if self.videos.exists() else ():
            island = None if start is None else (start, end, list(own), list(places))
            out[video] = {"at": at, "texts": list(texts), "filtered": list(filtered), "island": island, "said": dict(zip(zip(lines, said, strict=True), ms, strict=True))}
        return out

    def advanced(self, known: dict, new: list[tuple], watermark: int) -> pd.DataFrame:
        """The islands that are closed by what the watermark has passed."""
        slices = dict(zip(*self.slices.get(), strict=True)) if self.slices.exists() else {}
        coming: dict[int, list[tuple]] = {}
        for event in new:
            coming.setdefault(event[0] // self.width, []).append(event)
        passed: list[tuple] = []
        for place in {*coming, *(p for p, first in slices.items() if first < watermark)}:
            held = coming.get(place, [])
            if place in slices:
                ids, times, *more = self.waiting.getValue((place,))
                held += [(t, list(x), list(f), e, v) for v, t, x, f, e in zip(ids, times, *more, strict=True)]
            passed += [x for x in held if x[0] < watermark]
            rest = [x for x in held if x[0] >= watermark]
            if rest:
                times, texts, filtered, ends, ids = map(list, zip(*rest, strict=True))
                self.waiting.updateValue((place,), (ids, times, texts, filtered, ends))
                slices[place] = min(times)
            elif slices.pop(place, None) is not None:
                self.waiting.removeKey((place,))
        out: list[tuple] = []
        for event in sorted(passed, key=lambda x: x[:4]):
            self.run(known, event[4], event, out)
        if self.idle_ms is not None:
            for video in [v for v, x in known.items() if x["at"] + self.idle_ms < watermark]:
                self.run(known, video, (known[video]["at"] + self.idle_ms, [], [], True), out)
            if known:
                self.handle.registerTimer(min(x["at"] for x in known.values()) + self.idle_ms + 1)
        if slices:
            self.slices.update((list(slices), list(slices.values())))
            self.handle.registerTimer(max(min(slices.values()), watermark) + 1)
        elif self.slices.exists():
            self.slices.clear()
        if passed or out:
            self.keep(known)
        return told(out)

    def keep(self, known: dict) -> None:
        rows = []
        for video, x in known.items():
            start, end, own, places = x["island"] or (None, None, [], [])
            lines, said = map(list, zip(*x["said"], strict=True)) if x["said"] else ([], [])
            rows.append((video, x["at"], x["texts"], x["filtered"], start, end, own, places, lines, said, list(x["said"].values())))
        if rows:
            self.videos.put(rows)
        elif self.videos.exists():
            self.videos.clear()

    def run(self, known: dict, video: int | None, event: tuple, out: list[tuple]) -> None:
        """A video's next event: (time, texts, filtered texts, whether it ends)."""
        time_ms, after, after_filtered, ends = event[:4]
        live = video in known
        state = known.setdefault(video, {"at": 0, "texts": [], "filtered": [], "island": None, "said": {}})

        def end() -> None:
            if state["island"]:
                start, stop, _, places = state["island"]
                out.append((video, start, stop, voted(len(places), [(*k, ms) for k, ms in state["said"].items()])))
            state.update(island=None, said={})

        def closed(time_ms: int) -> None:
            """The open segment ends."""
            own, filtered, island = state["texts"], state["filtered"], state["island"]
            if island and alike(island[2], filtered, self.threshold):
                step = match_lines(island[2], filtered)
                places = [step[p] if p < len(step) else p for p in island[3]]
                state["island"] = (island[0], time_ms, filtered, places)
            else:
                end()
                places = list(range(len(own)))
                state["island"] = (state["at"], time_ms, filtered, places)
            for line, p in enumerate(places):
                if p < len(own):
                    state["said"][line, own[p]] = state["said"].get((line, own[p]), 0) + time_ms - state["at"]

        if live and self.idle_ms is not None and time_ms - state["at"] > self.idle_ms:
            closed(state["at"] + self.idle_ms)
            end()
            state.update(at=0, texts=[], filtered=[])
        closed(time_ms)
        state.update(at=time_ms, texts=after, filtered=after_filtered)
        if ends:
            end()
            del known[video]


def islands(events: DataFrame, late: str, threshold: float = THRESHOLD, idle_ms: int | None = None, lanes: int = LANES) -> DataFrame:
    """(video_id, time_ms, texts) as a stream to merged segments, each when its
    island is over: by an event that says something else, by an end event (null
    texts), or, with ``idle_ms``, when a video has no event for so long: its last
    segment ends so long after the last event. After either, a video starts anew at 0.

    Events may come out of order by up to ``late``; later ones are dropped. Start the
    stream with CONF set.
    """
    late_ms = events.sparkSession.sql(f"select unix_millis(timestamp_millis(0) + interval {late})").first()[0]
    timed = dealt(events, lanes, filtered_lines(F.col("texts")).alias("filtered")).withWatermark("ts", late)
    return timed.groupBy("lane").transformWithStateInPandas(Islands(threshold, idle_ms, max(1, late_ms // 8)), SEGMENT, "append", "eventTime")


class Segments(StatefulProcessor):
    """State of a lane: the open segments of its videos, and the events that wait, by
    slices of time. A batch reads and writes only the slices that it has events of; a
    timer closes a slice when the watermark has passed its end."""

    def __init__(self, width: int) -> None:
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slice long", "videos array<long>, times array<long>, texts array<array<string>>")
        self.open = handle.getValueState("open", "videos array<long>, at array<long>, texts array<array<string>>")

    def opened(self) -> dict[int | None, tuple[int, list[str]]]:
        return {v: (at, list(x)) for v, at, x in zip(*self.open.get(), strict=True)} if self.open.exists() else {}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.opened()
        new: dict[int, list[tuple]] = {}
        for batch in rows:
            for video, time_ms, texts in zip(videos(batch), batch["time_ms"], batch["texts"], strict=True):
                if time_ms >= (known[video][0] if video in known else 0):  # else a later one is out
                    new.setdefault(int(time_ms) // self.width, []).append((video, int(time_ms), [] if texts is None else list(texts)))
        for place, events in new.items():
            if self.waiting.containsKey((place,)):
                events += zip(*self.waiting.getValue((place,)), strict=True)
            else:
                self.handle.registerTimer((place + 1) * self.width)
            self.waiting.updateValue((place,), tuple(map(list, zip(*events, strict=True))))
        yield told([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        place = (expiredTimerInfo.getExpiryTimeInMs() // self.width - 1,)
        known, out = self.opened(), []
        for video, time_ms, now in sorted(zip(*self.waiting.getValue(place), strict=True), key=lambda x: (x[1], list(x[2]))):
            at, texts = known.get(video, (0, []))
            out.append((video, at, time_ms, texts))
            known[video] = (time_ms, list(now))
        self.waiting.removeKey(place)
        self.open.update((list(known), [at for at, _ in known.values()], [x for _, x in known.values()]))
        yield told(out)

    def close(self) -> None:
        pass


def segments(events: DataFrame, late_ms: int, slices: int = 8, lanes: int = LANES) -> DataFrame:
    """(video_id, time_ms, texts) as a stream to closed segments: each event closes the
    one before it. Events may come out of order by up to ``late_ms``; later ones are
    dropped. A segment is told when the watermark has passed its slice of time, a
    ``slices``-th of ``late_ms``. Null texts are none; events of one time go by their
    texts. Start the stream with CONF set.
    """
    timed = dealt(events, lanes).withWatermark("ts", f"{late_ms} milliseconds")
    return timed.groupBy("lane").transformWithStateInPandas(Segments(max(1, late_ms // slices)), SEGMENT, "append", "eventTime")
