"""Boxes: structs of integers x, y, width, height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), width.cast("int").alias("width"), height.cast("int").alias("height"))


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def bottom(b: Column) -> Column:
    return b["y"] + b["height"]


def overlap(a: Column, b: Column) -> Column:
    """Area in common, edges included."""
    w = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"]) + 1
    h = F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"]) + 1
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def iou(a: Column, b: Column) -> Column:
    """Overlap (edges included) over union (edges not), at most 1."""
    both = overlap(a, b)
    union = a["width"] * a["height"] + b["width"] * b["height"] - both
    return F.when(union <= 0, F.when(both > 0, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), both / union)))


def contains(a: Column, b: Column) -> Column:
    """Whether b lies in a; edges may touch."""
    return (a["x"] <= b["x"]) & (right(b) <= right(a)) & (a["y"] <= b["y"]) & (bottom(b) <= bottom(a))


def hull(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return box(x, y, F.greatest(right(a), right(b)) - x, F.greatest(bottom(a), bottom(b)) - y)


def crop(b: Column, width: Column, height: Column) -> Column:
    """Into the canvas: the corner moves in first and doesn't narrow the box."""
    x, y = F.greatest(b["x"], F.lit(0)), F.greatest(b["y"], F.lit(0))
    return box(x, y, F.least(b["width"], width - x), F.least(b["height"], height - y))


def scale(b: Column, by: float) -> Column:
    return box(*[(b[k] * by) for k in ("x", "y", "width", "height")])


def inflate(b: Column, area: Column) -> Column:
    """A component's box on the half-size map, grown by its stroke width and doubled."""
    short = F.least(b["width"], b["height"])
    inner = F.floor(area * short / (b["width"] * b["height"]))
    grow = (F.sqrt(inner.cast("double")) * 2).cast("int") + (short.cast("float") * F.lit(0.07).cast("float")).cast("float").cast("int")
    return box((b["x"] - grow) * 2, (b["y"] - grow) * 2, (b["width"] + grow * 2) * 2, (b["height"] + grow * 2) * 2)


def can_merge(a: Column, b: Column) -> Column:
    """Whether two boxes are of one line of text."""
    size = F.least(a["height"], b["height"])
    middles = F.abs(F.floor(a["y"] + F.floor(a["height"] / 2)) - F.floor(b["y"] + F.floor(b["height"] / 2)))
    uneven = (middles * 1.5 > size) & ((F.abs(a["height"] - b["height"]) > size) | (F.abs(a["y"] - b["y"]) * 2 > size))
    gap = F.when(a["x"] < b["x"], F.abs(right(a) - b["x"])).otherwise(F.abs(right(b) - a["x"]))
    return contains(a, b) | contains(b, a) | (~uneven & (gap <= size))


def canvas(width: Column, height: Column, side: int = 640) -> Column:
    """Struct of the scaled size and of the size padded to multiples of 32."""
    r = (F.lit(side).cast("float") / F.greatest(width, height).cast("float")).cast("float")
    w, h = (F.floor((r * x.cast("float")).cast("float").cast("double") + 0.5).cast("int") for x in (width, height))
    pad = lambda x: (F.floor((x + 31) / 32) * 32).cast("int")
    return F.struct(w.alias("w"), h.alias("h"), pad(w).alias("out_w"), pad(h).alias("out_h"))
