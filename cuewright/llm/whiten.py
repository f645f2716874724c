"""Embedding whitening by merged singular value decompositions.

A partition's vectors become a node: their number, exact sums, mean, and the full
set of singular values and vectors of what is left of the mean. Two nodes merge by
a decomposition of both their scaled vectors and one row that stands for the
difference of their means, so nothing is lost whatever the order. Nodes merge
FAN at a time, level by level, in groups of tasks; one node of d x d numbers is left,
which gives the components. The whitened vectors are summed up the same way, as the
check of their covariance.

Entries c are taken as the whole numbers floor(64 * c) + 1000000, so sums and
deviations are exact; a deviation that a long can't hold is an error.

Cases: a vector that is null or empty, has a null or an entry that isn't finite, or
another length than most (ties: the longer) is dropped. Null ids and repeated rows:
as any other row, each counted. Components without variance (fewer vectors than
dimensions, equal vectors): whitened to 0, explained 0, and left out of the identity.
Signs: a component's largest entry is positive. Empty table: empty result. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Nodes that a task merges.
FAN = 16
#: Numbers of a block of vectors that is decomposed at a time.
BLOCK = 1 << 21
#: Variances below this share of the largest count as none.
NONE = 1e-12
NODE = "node long, n long, sums array<long>, mean array<double>, s array<double>, v array<double>"


@dataclass
class Node:
    """``n`` vectors: exact sums (of whole numbers, else 0), mean, singular values
    and vectors (a row each) of the centred ones."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    s: np.ndarray
    v: np.ndarray


def decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s, v


def leaf(x: np.ndarray) -> Node:
    """A node of vectors, a row each; whole numbers are centred before they become
    doubles."""
    if x.dtype == np.int64:
        sums = x.sum(0)
        whole = sums // len(x)
        rest = (sums - whole * len(x)) / len(x)
        return Node(len(x), sums, whole + rest, *decomposed((x - whole) - rest))
    mean = x.mean(0)
    return Node(len(x), np.zeros(x.shape[1], np.int64), mean, *decomposed(x - mean))


def united(a: Node, b: Node) -> Node:
    n = a.n + b.n
    apart = b.mean - a.mean
    rows = np.vstack([a.s[:, None] * a.v, b.s[:, None] * b.v, np.sqrt(a.n / n * b.n) * apart])
    return Node(n, a.sums + b.sums, a.mean + apart * (b.n / n), *decomposed(rows))


def summed(vectors: DataFrame, column: str) -> Node | None:
    """The node of all vectors, arrays of one length of whole numbers or doubles."""
    whole = "bigint" in dict(vectors.dtypes)[column]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                x = flat.reshape(batch.num_rows, -1)
                rows = max(1, BLOCK // x.shape[1])
                for i in range(0, len(x), rows):
                    yield x[i : i + rows]

    def told(node: Node, at: int) -> dict:
        return {"node": [at], "n": [node.n], "sums": [node.sums], "mean": [node.mean], "s": [node.s], "v": [node.v.ravel()]}

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = None
        for x in blocks(batches):
            own = leaf(x.astype(np.int64 if whole else np.float64))
            node = own if node is None else united(node, own)
        if node is not None:
            rows = {k: [x.tolist() if isinstance(x, np.ndarray) else x for x in v] for k, v in told(node, TaskContext.get().partitionId()).items()}
            yield pa.RecordBatch.from_pydict(rows)

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes = []
        for r in rows.sort_values("node").itertuples(index=False):
            s = np.asarray(r.s)
            nodes.append(Node(r.n, np.asarray(r.sums), np.asarray(r.mean), s, np.asarray(r.v).reshape(len(s), -1)))
        return pd.DataFrame(told(reduce(united, nodes), key[0]))

    nodes = stored(vectors.select(column).mapInArrow(leaves, NODE), "nodes")
    left = (nodes.agg(F.max("node")).first()[0] or 0) + 1
    while left > 1:
        nodes, left = nodes.groupBy(F.floor(F.col("node") / FAN).alias("up")).applyInPandas(merge, NODE), -(-left // FAN)
    found = nodes.collect()  # one row
    if not found:
        return None
    (_, n, sums, mean, s, v), = found
    return Node(n, np.array(sums, np.int64), np.array(mean), np.array(s), np.array(v).reshape(len(s), -1))


@dataclass
class Whitening:
    """What whitens vectors: a row of ``components`` each, their variances, and the
    share of all variance that each has."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    def white(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole numbers to whitened rows."""
        whole = self.sums // self.n
        centred = (x - whole) - (self.sums - whole * self.n) / self.n
        live = self.variances > 0
        return np.where(live, centred @ self.components.T / np.sqrt(np.where(live, self.variances, 1)), 0.0)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums of the squares of n * x - sums."""
        apart = self.n * x - self.sums
        most = int(np.abs(apart).max(initial=0))
        if most * most * x.shape[1] < 1 << 63:
            return (apart * apart).sum(1).tolist()
        return [sum(v * v for v in row) for row in apart.tolist()]  # Arrow refuses what is no long


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x): the vectors of the commonest length without a null or an entry that
    isn't finite, as whole numbers."""
    c = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).alias("key"), c.alias("c")).where(F.size("c") > 0)
    good = rows.where(F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    sizes = good.groupBy(F.size("c").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return good.where(F.size("c") == (sizes["size"] if sizes else 0)).select("key", F.transform("c", lambda v: F.floor(v * SCALE) + F.lit(SHIFT).cast("long")).alias("x"))


def fitted(rows: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of usable() rows, up to ``most`` components by falling variance."""
    node = summed(rows, "x")
    if node is None:
        return None
    kept = min(most, len(node.mean))
    variances, v = np.zeros(kept), np.zeros((kept, len(node.mean)))
    own = node.s[:kept] ** 2 / node.n
    own[own <= NONE * max(own.max(initial=0), 1e-300)] = 0
    variances[: len(own)], v[: len(own)] = own, node.v[:kept]
    v *= np.where(np.take_along_axis(v, np.abs(v).argmax(1)[:, None], 1) < 0, -1.0, 1.0)
    total = (node.s**2).sum() / node.n
    return Whitening(node.n, node.sums, v, variances, variances / total if total > 0 else variances)


def whitened(rows: DataFrame, by: Whitening) -> DataFrame:
    """(key, deviation, whitened) of usable() rows. What whitens them, a number for
    each dimension and component, is broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)
                made = own.white(x)
                lists = pa.ListArray.from_arrays(pa.array(range(0, made.size + 1, made.shape[1]), pa.int32()), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.deviations(x), pa.int64()), lists], ["key", "deviation", "whitened"])

    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, deviation long, whitened array<double>")


def identity_error(made: DataFrame, by: Whitening) -> float:
    """The largest entry of the covariance of whitened() rows less the identity."""
    node = summed(made, "whitened")
    live = by.variances > 0
    rows = (node.s[:, None] * node.v)[:, live]
    return float(np.abs(rows.T @ rows / node.n - np.eye(live.sum())).max(initial=0))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    by = fitted(rows)
    if by is None:
        empty = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], empty)
    made = whitened(rows, by)
    error = identity_error(made, by)
    each = made.select(F.col("key").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.get(F.array(*[F.lit(float(x)) for x in by.explained]), F.col("at"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(by.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
