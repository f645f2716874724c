"""Exact nearest neighbours of a set of query vectors, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOUND = "query long, neighbour long, similarity double"


def matrix(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """ids and unit vectors of the rows that have a direction."""
    x = np.stack([np.asarray(v, np.float64) for v in rows["v"]])
    size = np.sqrt((x * x).sum(1))
    return rows["id"].to_numpy()[size > 0], x[size > 0] / size[size > 0][:, None]


def best(k: int):
    """A function of a block of queries and one of vectors: the best ``k`` of each query there."""

    def of(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(there):
            (ids, x), (own, y) = matrix(asked), matrix(there)
            for i, row in zip(ids, x @ y.T, strict=True):
                order = [j for j in np.lexsort((own, -row))[: k + 1] if own[j] != i][:k]
                out += [(int(i), int(own[j]), float(row[j])) for j in order]
        return pd.DataFrame(out, columns=["query", "neighbour", "similarity"])

    return of


def top_cosine(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 2048) -> DataFrame:
    """(query, neighbour, similarity, rank) of the ``k`` vectors most alike each
    query by the cosine; ties by id. Both: (id long, v: array of numbers). A task
    gets a block of queries and one of vectors and keeps its best, so neither side
    is gathered; a query isn't its own neighbour. Null or zero vectors are left out."""
    parts = lambda df: max(1, -(-df.count() // block))
    n_q, n_v = parts(queries), parts(vectors)
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda df: df.where("v is not null").select(F.col("id").alias("id"), F.col("v").alias("v"))  # noqa: E731  new columns, should both come from one table
    left = own(queries).select("id", "v", part(n_q).alias("q"), every(n_v).alias("p"))
    right = own(vectors).select("id", "v", part(n_v).alias("p"), every(n_q).alias("q"))

    found = left.groupBy("q", "p").cogroup(right.groupBy("q", "p")).applyInPandas(best(k), FOUND)
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
