import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.operators import cells, neighbors
from cuewright.plans import nearest

SCHEMA = "id long, v array<double>"


def grouped(n, dims=16, seed=3):
    made = np.random.default_rng(seed)
    middle = made.normal(size=(20, dims))
    kind = np.where(made.random(n) < 1 / 3, 0, made.integers(0, 20, n))  # one group has over a third
    return [(i, (middle[kind[i]] + 0.4 * made.normal(size=dims)).tolist()) for i in range(n)]


def pairs(df):
    return sorted((r["query"], r["rank"], r["neighbour"], round(r["similarity"], 9)) for r in df.collect())


def test_all_cells_are_the_exact_search(spark):
    rows = [*grouped(600), (700, None), (701, [0.0] * 16), (5, grouped(600)[5][1])]
    vectors = spark.createDataFrame(rows, SCHEMA)
    asked = vectors.where("id % 50 = 0 or id = 701")
    centres = cells.centres(vectors, 9)
    index = cells.index(vectors, centres)
    assert index.count() == 601 and len(centres) <= 9
    want = pairs(neighbors.top_cosine(vectors, asked, 4))
    for block in (7, 2048):
        assert pairs(cells.search(index, centres, asked, 4, 9, block)) == want


def test_recall_of_the_probes_asked_for(spark):
    vectors = spark.createDataFrame(grouped(3000), SCHEMA)
    asked = vectors.where("id % 10 = 0")
    want = {(r["query"], r["neighbour"]) for r in neighbors.top_cosine(vectors, asked).collect()}
    centres = cells.centres(vectors)
    index = cells.index(vectors, centres)
    probes = cells.probes_for(index, centres, asked, 5, 0.95)
    got = {(r["query"], r["neighbour"]) for r in cells.search(index, centres, asked, 5, probes).collect()}
    assert len(got & want) >= 0.9 * len(want) and probes < len(centres) / 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], SCHEMA)
    assert cells.approximate(none, none).collect() == cells.approximate(none, one).collect() == cells.approximate(one, none).collect() == cells.approximate(one, one).collect() == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_the_exact_search(spark, sf):
    vectors = nearest.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    want = {(r["query"], r["neighbour"]): r["similarity"] for r in neighbors.top_cosine(vectors, vectors.where("id % 100 = 0")).collect()}
    got = {(r["query"], r["neighbour"]): r["similarity"] for r in nearest.approximate_neighbors(spark, sf).collect()}
    both = got.keys() & want.keys()
    print("recall", len(both) / len(want))
    assert len(got) == len(want) and len(both) >= 0.9 * len(want) and all(got[x] == pytest.approx(want[x]) for x in both)


def test_centres_do_not_send_their_pairs_to_the_driver(spark, monkeypatch):
    """Spark's solver of rows gathers the square of the number of centres in each round."""
    asked, kmeans = [], cells.KMeans
    monkeypatch.setattr(cells, "KMeans", lambda **x: asked.append(x) or kmeans(**x))
    rows = spark.range(300).selectExpr("id", "array(cast(sin(id) as double), cast(cos(id) as double), 1.0D) as v")
    assert len(cells.centres(rows, 9)) == 9 and asked[0]["solver"] == "block"
