"""Approximate nearest neighbours by an inverted file of k-means cells.

Centres are fitted on a bounded sample, every vector is stored under the cell of its
nearest centre, and a query is compared with all vectors of its nearest cells. How
many cells that takes for a recall is measured on a sample of queries that are
searched exactly. Cells and their queries are cut into blocks, so that a cell with a
third of all vectors is many tasks.

Vectors are (id long, v: array of numbers), all of one length. Null vectors and those
without a direction are left out. Repeated rows are found as often as they are there.
Empty tables: no centres, an empty index and no neighbours. Ties: by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.operators.neighbors import FOUND, best, ranked, top_cosine
from cuewright.store import stored

#: Vectors that the centres are fitted on, about; the most centres, which all tasks get.
SAMPLE, MAX_CELLS = 50_000, 4096
#: Queries that the number of cells to look into is measured on, about.
TRIED = 200
BLOCK = 2048


def directed(vectors: DataFrame) -> DataFrame:
    """id and v of the rows whose vector has a direction."""
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return vectors.select("id", F.col("v").cast("array<double>").alias("v")).where((size > 0) & (size < float("inf")))


def sampled(rows: DataFrame, wanted: int, n: int, seed: str) -> DataFrame:
    """About ``wanted`` of ``n`` rows, by a hash of their id."""
    return rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < math.ceil((1 << 30) * min(1.0, wanted / max(1, n))))


def centres(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, rounds: int = 20) -> np.ndarray:
    """Unit vectors of at most ``cells`` (the root of the number of vectors, if not
    given) centres, fitted to about ``sample`` vectors."""
    rows = directed(vectors)
    n = rows.count()
    cells = max(2, min(MAX_CELLS, round(math.sqrt(n)) if cells is None else cells))  # KMeans takes no fewer
    points = stored(sampled(rows, sample, n, "fit"), "fit").select(array_to_vector("v").alias("features"))
    if not points.head(1):
        return np.zeros((0, 0))
    # the solver of rows sends distances of all pairs of centres to the driver in each round
    found = np.stack(KMeans(k=cells, distanceMeasure="cosine", maxIter=rounds, seed=7, solver="block").fit(points).clusterCenters())
    size = np.sqrt((found * found).sum(1, keepdims=True))
    return found[size[:, 0] > 0] / size[size > 0][:, None]


def assigned(rows: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """(id, v, cell, place): the ``n`` nearest cells of each row, from place 0 on."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y = shared.value
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                order = np.argsort(-(np.stack(part["v"]) @ y.T), axis=1, kind="stable")[:, :n] if len(y) else np.zeros((len(part), 1), int)
                made = part.loc[part.index.repeat(order.shape[1])].reset_index(drop=True)
                yield made.assign(cell=order.ravel(), place=np.tile(np.arange(order.shape[1]), len(part)))

    return rows.mapInPandas(nearest, "id long, v array<double>, cell int, place int")


def index(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, v, cell) of every vector, stored by cell."""
    rows = assigned(directed(vectors), centres, 1).drop("place")
    return stored(rows.sortWithinPartitions("cell"), "cells")


def probes_for(indexed: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, recall: float, tried: int = TRIED) -> int:
    """The fewest cells that hold ``recall`` of the true ``k`` neighbours of about
    ``tried`` queries. A table of ``tried`` x ``k`` rows is gathered as counts by place."""
    rows = directed(queries)
    some = stored(sampled(rows, tried, rows.count(), "try"), "tried")
    true = top_cosine(indexed.select("id", "v"), some, k).select("query", F.col("neighbour").alias("id"))
    cell = true.join(indexed.select("id", "cell").distinct(), "id")
    order = assigned(some, centres, max(1, len(centres))).select(F.col("id").alias("query"), "cell", "place").distinct()
    counts = dict(cell.join(order, ["query", "cell"]).groupBy("place").count().collect())
    total, seen = sum(counts.values()), 0
    for place in sorted(counts):
        seen += counts[place]
        if seen >= recall * total:
            return place + 1
    return max(1, len(centres))


def search(indexed: DataFrame, centres: np.ndarray, queries: DataFrame, k: int = 5, probes: int = 8, block: int = BLOCK) -> DataFrame:
    """(query, neighbour, similarity, rank) of the ``k`` vectors most alike each query
    among those of its ``probes`` nearest cells. A query isn't its own neighbour."""
    asked = assigned(directed(queries), centres, probes)
    blocks = lambda name: F.ceil(F.count("*") / block).cast("int").alias(name)
    # one row a cell: at most MAX_CELLS
    sizes = F.broadcast(indexed.groupBy("cell").agg(blocks("n_p")).join(asked.groupBy("cell").agg(blocks("n_q")), "cell"))
    own: Column = F.xxhash64("id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, "cell").select("id", "v", "cell", F.pmod(own, "n_q").cast("int").alias("q"), every("n_p").alias("p"))
    right = indexed.join(sizes, "cell").select("id", "v", "cell", F.pmod(own, "n_p").cast("int").alias("p"), every("n_q").alias("q"))
    found = left.groupBy("cell", "p", "q").cogroup(right.groupBy("cell", "p", "q")).applyInPandas(best(k), FOUND)
    return ranked(found, k)


def approximate(vectors: DataFrame, queries: DataFrame, k: int = 5, recall: float = 0.95) -> DataFrame:
    """``search`` over a new index, with as many cells as ``recall`` takes."""
    found = centres(vectors)
    indexed = index(vectors, found)
    return search(indexed, found, queries, k, probes_for(indexed, found, queries, k, recall))
