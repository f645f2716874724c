"""The query of approximate neighbours. No SQL says which of the true ones are missed:
tests hold its recall against the exact search."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright.operators import cells
from cuewright.plans.registry import query, read


@query()
def approximate_neighbors(spark, sf):
    """The five vectors most alike each whose id is divisible by 100."""
    vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return cells.approximate(vectors, vectors.where("id % 100 = 0"))
