"""Components of images that are larger than a task: labels by tile, ties along borders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.functions.pixels import label_components
from cuewright.operators import graphs
from cuewright.store import stored

#: What a tile tells: its components, and the component of each pixel of its borders.
TOLD = "struct<parts: array<struct<first: long, area: long, x: long, y: long, right: long, bottom: long, peak: double>>, left: array<long>, top: array<long>, last_column: array<long>, last_row: array<long>>"


def _told(mask: np.ndarray, score: np.ndarray | None, top: int, left: int) -> dict:
    """A component is known by its first pixel of the image, y and x in one number."""
    labels = label_components(mask)
    ys, xs = np.nonzero(labels)
    own = labels[ys, xs] - 1
    n = int(own.max(initial=-1)) + 1
    code = ((ys + top).astype(np.int64) << 32) + xs + left
    low = lambda v: np.minimum.reduceat(v[order], cuts)
    high = lambda v: np.maximum.reduceat(v[order], cuts)
    order = np.argsort(own, kind="stable")
    cuts = np.flatnonzero(np.diff(own[order], prepend=-1)) if n else np.zeros(0, int)
    first = low(code) if n else np.zeros(0, np.int64)
    names = [None, *first.tolist()]
    parts = []
    if n:
        peak = high(score[ys, xs].astype(float)) if score is not None else np.full(n, np.nan)
        columns = (first, np.bincount(own), low(xs) + left, low(ys) + top, high(xs) + left + 1, high(ys) + top + 1)
        parts = [{**dict(zip(("first", "area", "x", "y", "right", "bottom"), map(int, row), strict=True)), "peak": None if np.isnan(p) else float(p)} for *row, p in zip(*columns, peak, strict=True)]
    edge = lambda line: [names[k] for k in line]
    return {"parts": parts, "left": edge(labels[:, 0]), "top": edge(labels[0]), "last_column": edge(labels[:, -1]), "last_row": edge(labels[-1])}


def components(tiles: DataFrame, key: list[str]) -> DataFrame:
    """(key, first, area, x, y, width, height, peak) of the 4-connected components of
    images in tiles (key, row, column, top, left, height, width, mask, score): row and
    column number the tiles, top and left place them, the mask has a byte a pixel and
    the score, null or four bytes a pixel (little-endian floats), gives each
    component's peak. first: its first pixel, y * 2^32 + x.

    A task holds a tile, borders meet by joins with the tile to the right and below,
    and only components that touch such a border are united. Tiles that aren't there
    are background. Tiles beside each other must be of the same height or width. Null
    keys are an image of their own. Tiles without pixels or with a null mask have no
    components."""

    @F.pandas_udf(TOLD)
    def labelled(mask: pd.Series, score: pd.Series, top: pd.Series, left: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
        out = []
        for m, s, y, x, h, w in zip(mask, score, top, left, height, width, strict=True):
            if m is None or not h or not w:
                out.append({"parts": [], "left": [], "top": [], "last_column": [], "last_row": []})
                continue
            own = None if s is None else np.frombuffer(s, "<f4").reshape(h, w)
            out.append(_told(np.frombuffer(m, np.uint8).reshape(h, w) > 0, own, int(y), int(x)))
        return pd.DataFrame(out)

    named = tiles.select(F.struct(*key).alias("image"), "row", "column", labelled("mask", "score", "top", "left", "height", "width").alias("t"))
    found = stored(named, "tiles")

    def met(edge: str, other: str, row: int, column: int) -> DataFrame:
        after = found.select("image", (F.col("row") - row).alias("row"), (F.col("column") - column).alias("column"), F.col("t").getField(other).alias("there"))
        both = found.select("image", "row", "column", F.col("t").getField(edge).alias("here")).join(after.hint("merge"), ["image", "row", "column"])
        near = both.select("image", F.explode(F.arrays_zip("here", "there")).alias("p")).where("p.here is not null and p.there is not null")
        return near.select(F.struct("image", F.col("p.here").alias("first")).alias("a"), F.struct("image", F.col("p.there").alias("first")).alias("b")).distinct()

    ties = graphs.unions(met("last_column", "left", 0, 1).union(met("last_row", "top", 1, 0)))
    parts = found.select("image", F.explode("t.parts").alias("p")).select(F.struct("image", "p.first").alias("node"), "p.*")
    known = parts.join(ties.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = known.groupBy("root").agg(F.sum("area").alias("area"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.max("peak").alias("peak"))
    image = F.col("root.image")
    return whole.select(*[image.getField(k).alias(k) for k in key], F.col("root.first").alias("first"), "area", "x", "y", (F.col("right") - F.col("x")).alias("width"), (F.col("bottom") - F.col("y")).alias("height"), "peak")
