"""The command line: cues of a table of events, and joined files."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from cuewright.functions.text import drop_blank_lines
from cuewright.operators import segments as S
from cuewright.sources import flv, mp4, sinks


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cuewright", description=__doc__)
    kinds = parser.add_subparsers(dest="kind", required=True)
    cues = kinds.add_parser("cues", help="events (video_id, time_ms, texts) in Parquet to WEBVTT files")
    cues.add_argument("events")
    cues.add_argument("output")
    for name in ("flv", "mp4"):
        joined = kinds.add_parser(f"join-{name}", help=f"some {name} files as one")
        joined.add_argument("files", nargs="+")
        joined.add_argument("--output", required=True)
    found = parser.parse_args(args)
    if found.kind == "cues":
        spark = SparkSession.builder.appName("cuewright").getOrCreate()
        events = spark.read.parquet(found.events).withColumn("texts", drop_blank_lines("texts"))
        sinks.write_documents(S.document(S.cues(S.merge_twice(S.segments(S.with_end(events))))), found.output)
    else:
        join = flv.join_files if found.kind == "join-flv" else mp4.merge_files
        Path(found.output).write_bytes(join([Path(x).read_bytes() for x in found.files]))


if __name__ == "__main__":
    main()
