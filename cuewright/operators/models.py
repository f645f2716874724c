"""Models as functions: a detector and a recogniser over batches of one shape.

``load`` takes no argument and returns a function of one array. It is called once
in a worker, whose models outlive its tasks as Spark reuses workers; ``shipped()``
makes one of a file of weights that each executor fetches once. A partition's rows
are sorted by shape, so that batches go on over Arrow batches: at most one of each
shape is filled up with zeros to ``size``, and what the model says of the filling is
dropped. Empty tables give no rows; rows with a null array are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Model = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Models that a worker keeps, at most; the one used longest ago goes first.
KEPT = 4
_kept: dict[str, Model] = {}


def kept(key: str, load: Callable[[], Model]) -> Model:
    """This worker's model of a key."""
    model = _kept.pop(key, None) or load()
    _kept[key] = model
    while len(_kept) > KEPT:
        del _kept[next(iter(_kept))]
    return model


def shipped(spark: SparkSession, path: str, make: Callable[[str], Model]) -> Callable[[], Model]:
    """``load`` of a file of weights at any path that the driver can read: executors
    fetch it once, ``make`` gets its local path. Another version of the
    weights needs another file name, else Spark refuses it."""
    spark.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]
    return lambda: make(SparkFiles.get(name))


def _tensors(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of one shape, ``size`` or the last ones, and their (size, 3, height,
    width) pixels; the rows are sorted by shape."""

    def filled(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        h, w = rows["height"].iloc[0], rows["width"].iloc[0]
        x = np.zeros((size, 3, h, w), np.float32)
        for k, px in enumerate(rows["px"]):
            x[k] = np.asarray(px, np.float32).reshape(3, h, w)
        return rows, x

    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        held = None
        shapes = rows[["height", "width"]].to_numpy()
        cuts = [0, *(np.flatnonzero((shapes[1:] != shapes[:-1]).any(1)) + 1).tolist(), len(rows)]
        for lo, hi in zip(cuts, cuts[1:]):
            for i in range(lo, hi, size):
                if hi == len(rows) and i + size > hi:
                    held = rows.iloc[i:]
                else:
                    yield filled(rows.iloc[i : min(hi, i + size)])
    if held is not None:
        yield filled(held)


def _applied(rows: DataFrame, key: list[str], load: Callable[[], Model], size: int, names: list[str], kind: str) -> DataFrame:
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in key] + [f"{n} {kind}" for n in names])
    name = hashlib.sha256(cloudpickle.dumps(load)).hexdigest()

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some, x in _tensors(batches, size):
            found = kept(name, load)(x)
            yield some[key].assign(**{n: [v.tolist() for v in y[: len(some)]] for n, y in zip(names, found, strict=True)})

    return rows.select(*key, *[c for c in ("height", "width", "px") if c not in key]).sortWithinPartitions("height", "width").mapInPandas(of, schema)


def detect(frames: DataFrame, key: list[str], load: Callable[[], Model], size: int = 8) -> DataFrame:
    """(key, height, width, px of 3 planes) to key and the score maps ``text`` and
    ``link``, row by row; the model gives each as (n, height, width)."""
    return _applied(frames, key, lambda: _flat(load()), size, ["text", "link"], "array<float>")


def _flat(model: Model) -> Model:
    return lambda x: tuple(y.reshape(len(y), -1) for y in model(x))


def recognise(regions: DataFrame, key: list[str], load: Callable[[], Model], size: int = 16) -> DataFrame:
    """(key, height, width, px of 3 planes) to key, ``probs`` and ``symbols``: the
    best symbols of each step, best first; the model gives each as (n, steps, k)."""
    return _applied(regions, key, load, size, ["probs", "symbols"], "array<array<float>>").withColumn("symbols", F.col("symbols").cast("array<array<int>>"))
