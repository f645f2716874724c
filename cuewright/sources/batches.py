"""Rows of many files in tables of bounded size: a table a file costs more than its rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd

#: Rows that a table has at most, and about the bytes of bodies after which one ends.
ROWS, BYTES = 20_000, 16 << 20


def tables(rows: Iterable[tuple], columns: str, body: int) -> Iterator[pd.DataFrame]:
    """Tables of rows, whose field ``body`` is bytes or None. No rows: no table."""
    names = [x.split()[0] for x in columns.split(", ")]
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[body] or b"")
        if len(held) >= ROWS or size >= BYTES:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names)
