"""Programs run for the rows of a job table."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def run(jobs: DataFrame, key: str, command: Callable[[dict], list[str]], tries: int = 3, fatal: tuple[int, ...] = (), timeout: float | None = None) -> DataFrame:
    """(key, status, tries, code, message) of each job: its ``command`` of the
    row is run until it ends with 0 (Done), with a ``fatal`` code, or ``tries``
    times (Error). ``message`` is the last line that it wrote to its error stream.

    A program that can't be started or runs out of time has no code. Lost tasks
    run again, so programs must bear a second run. Spread long jobs with
    ``repartition`` first. Empty table: no rows.
    """

    def once(argv: list[str]) -> tuple[int | None, str]:
        try:
            done = subprocess.run(argv, capture_output=True, timeout=timeout, check=False)
        except (OSError, subprocess.TimeoutExpired) as e:
            return None, str(e)
        lines = done.stderr.decode("utf-8", "replace").strip().splitlines()
        return done.returncode, lines[-1] if lines else ""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                for n in range(1, tries + 1):
                    code, message = once(command(row))
                    if code == 0 or code in fatal:
                        break
                made = pd.DataFrame({key: [row[key]], "status": ["Done" if code == 0 else "Error"], "tries": [n], "code": [code], "message": [message]})
                yield made.astype({"code": "Int64"})

    return jobs.mapInPandas(of, f"`{key}` {dict(jobs.dtypes)[key]}, status string, tries int, code long, message string")
