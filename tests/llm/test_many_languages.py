"""Language models without a cap on the languages."""

import numpy as np
import pytest

from cuewright.llm import langid


def named(i: int) -> str:
    return f"l{i:04d}"


def text_of(i: int) -> str:
    """Words that only one language has."""
    made = np.random.default_rng(i)
    return " ".join("".join(made.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(12))


def test_over_five_hundred_languages(spark):
    rows = [(i, text_of(i), named(i)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.learn(docs)
    assert len(model.langs) == 600 and model.buckets * 600 > langid.DENSE
    got = {r.doc_id: r for r in langid.predict(docs.where("doc_id % 20 = 0"), model).collect()}
    assert len(got) == 30 and all(r.lang_pred == named(i) and r.score == 1 for i, r in got.items())
    assert langid.learn(docs.limit(0)).langs == []


@pytest.mark.parametrize("buckets", [64, 1 << 12])
def test_cells_equal_the_table(spark, buckets):
    docs = spark.createDataFrame([(i, text_of(i) + (" привет мир" if i % 3 else ""), named(i % 7)) for i in range(40)], "doc_id long, text string, lang string")
    model = langid.learn(docs, buckets=buckets)
    found = np.random.default_rng(1).integers(0, buckets + 1, 500)
    rows = model.of_buckets(found, most=0)
    assert model.dense is None and (rows[found == buckets] == 0).all()
    assert (rows == model.of_buckets(found)).all() and model.dense.shape == (buckets + 1, 7)
    # the sums by themselves
    sums = np.zeros((buckets, 7))
    for i in range(40):
        for grams, _ in langid.grams(langid.words_of(text_of(i) + (" привет мир" if i % 3 else "")), buckets):
            np.add.at(sums[:, i % 7], grams[grams < buckets], 1)
    want = np.log((sums + langid.SMOOTHING) / (sums.sum(0) + langid.SMOOTHING * buckets)).astype(np.float32)
    assert (model.dense[:-1] == want).all()
