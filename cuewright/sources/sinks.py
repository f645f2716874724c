"""What the engine hands out: cue documents, results of jobs, run logs."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Format and version that results name.
FORMAT, VERSION = "vtt", 7


def write_documents(documents: DataFrame, path: str) -> None:
    """(video_id, vtt) as one text file a video, below video_id=..."""
    text = F.regexp_replace("vtt", "\n\\z", "")  # the writer ends each value with a line feed
    documents.select("video_id", text.alias("value")).write.partitionBy("video_id").text(path)


def result(job: Column, document: Column) -> Column:
    """The JSON that a job's result is sent as."""
    return F.to_json(F.struct(job.alias("unique_id"), F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), document.alias("content")))


def each_batch(stream: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``put`` on each micro-batch of all that the source has now; a batch
    that is run again has the same number."""
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RunLog(StreamingQueryListener):
    """Appends a line of JSON for each event of a streaming query."""

    def __init__(self, path: str) -> None:
        self.path = path

    def put(self, kind: str, **more) -> None:
        with open(self.path, "a", encoding="utf-8") as out:
            out.write(json.dumps({"at": round(time.time(), 3), "event": kind} | more) + "\n")

    def onQueryStarted(self, event) -> None:
        self.put("started", query=str(event.id))

    def onQueryProgress(self, event) -> None:
        self.put("progress", query=str(event.progress.id), batch=event.progress.batchId, rows=event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        self.put("idle", query=str(event.id))

    def onQueryTerminated(self, event) -> None:
        self.put("terminated", query=str(event.id), error=event.exception)
