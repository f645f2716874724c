"""Decoded frames of any layout to RGB, to other layouts, and to a detector's input.

Frames are rows with ``width``, ``height`` and the bytes of their ``surface``. A
null surface gives a null; one of the wrong length ends the query, as does a layout
that isn't known. Repeated rows and empty tables are taken as they are. Rows stay
in their partitions: nothing is shuffled, and frames leave a task when HELD bytes are made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.functions import pixels as P
from cuewright.functions import surfaces

#: Bytes of frames that a task makes before it hands them on.
HELD = 16 << 20


def _each(frames: DataFrame, key: list[str], inputs: list[str], of: Callable, out: str) -> DataFrame:
    """key and the columns ``out`` that ``of`` makes of each frame."""
    kinds = dict(frames.dtypes)
    names = [c.split()[0] for c in out.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held, first = [], 0, 0
            for i, values in enumerate(batch[inputs].itertuples(index=False), 1):
                rows.append((None,) * len(names) if values[-1] is None else of(*values))
                held += len(rows[-1][-1] or b"")
                if held >= HELD or i == len(batch):
                    made = {n: pd.Series(list(c), dtype=object) for n, c in zip(names, zip(*rows, strict=True), strict=True)}
                    yield batch[key].iloc[first:i].reset_index(drop=True).assign(**made)
                    rows, held, first = [], 0, i

    return frames.select(*key, *[c for c in inputs if c not in key]).mapInPandas(run, ", ".join([f"`{k}` {kinds[k]}" for k in key] + [out]))


def to_rgb(frames: DataFrame, key: list[str], standard: str = "BT709", bits: int = 8, order: str = "planar") -> DataFrame:
    """key and ``px``, RGB samples of 8 or 16 bits, of frames with a ``layout``
    (NV12, P016, YUV444, YUV444P16): planes, or pixels ``bgra`` or ``rgba``."""

    def of(layout: str, width: int, height: int, surface: bytes) -> tuple[bytes]:
        yuv = surfaces.planes(surface, layout, int(width), int(height))
        return (surfaces.pixels(surfaces.to_rgb(yuv, standard, bits // 8), order),)

    return _each(frames, key, ["layout", "width", "height", "surface"], of, "px binary")


def from_rgb(frames: DataFrame, key: list[str], layout: str = "P016", standard: str = "BT709", bits: int = 16) -> DataFrame:
    """key and the ``surface`` of a layout, of frames with planar RGB ``px`` of ``bits``."""

    def of(width: int, height: int, px: bytes) -> tuple[bytes]:
        rgb = np.frombuffer(px, "<u2" if bits == 16 else "u1").reshape(3, int(height), int(width))
        return (surfaces.surface(surfaces.from_rgb(rgb, standard, bits // 8), layout),)

    return _each(frames, key, ["width", "height", "px"], of, "surface binary")


def preprocessed(frames: DataFrame, key: list[str], side: int = 640, kind: type = np.float32) -> DataFrame:
    """key, ``height``, ``width`` and planar RGB ``px`` of NV12 frames as a detector
    takes them: longer side ``side``, blurred, filled to multiples of 32."""

    def of(width: int, height: int, surface: bytes) -> tuple[int, int, bytes]:
        out = P.preprocess(np.frombuffer(surface, np.uint8), int(width), int(height), side, kind)
        return out.shape[1], out.shape[2], out.tobytes()

    renamed = frames.select(*key, F.col("width").alias("from_width"), F.col("height").alias("from_height"), "surface")
    return _each(renamed, key, ["from_width", "from_height", "surface"], of, "height int, width int, px binary")
