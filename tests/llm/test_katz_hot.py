import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cuewright.llm import katz

SF = "/root/testdata/sf0.001"


def split(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").limit(80).cache()


def test_frequent_words_change_nothing(docs):
    held = katz.crc_mod(F.col("doc_id"), 10) == 0
    first, *others = ({r.doc_id: r for r in katz.train_and_score(docs, held, parts, share)[0].collect()} for parts, share in ((1, 2.0), (5, 0.0), (3, 0.001)))
    for other in others:
        assert first.keys() == other.keys()
        for i, r in first.items():
            assert (r.n_tokens, r.n_known, r.train_tokens) == (other[i].n_tokens, other[i].n_known, other[i].train_tokens)
            assert r.score == pytest.approx(other[i].score, abs=1e-5) and r.base_score == pytest.approx(other[i].base_score, abs=1e-5)


def test_tables_are_a_model(spark, docs):
    """Seen probabilities and backoff weights of each context add up to 1."""
    rows = [(r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 10 == 0, split((r.text or "").lower())) for r in docs.collect()]
    kept = docs.where(katz.crc_mod(F.col("doc_id"), 10) != 0)
    scores, model = katz.train_and_score(docs, katz.crc_mod(F.col("doc_id"), 10) == 0, 3, 0.005)
    seen, contexts = model.tables()
    counts = {r.w: r.c for r in model.words.collect()}
    assert sum(counts.values()) == model.d.tokens and sum(c > 0 for c in counts.values()) == model.d.words
    by, weight = defaultdict(dict), {r.v: r.backoff for r in contexts.collect()}
    for r in seen.collect():
        by[r.v][r.w] = r.p
    low = {w: float(model.d.low(katz.np.array([c]))[0]) for w, c in counts.items() if c > 0}
    assert sum(low.values()) + model.d.unknown == pytest.approx(1)
    assert set(weight) == set(by)
    for v, own in by.items():
        rest = 1 - sum(low[w] for w in own)
        assert sum(own.values()) + weight[v] * rest == pytest.approx(1, abs=1e-9)
    # a score from the tables, token by token
    words = {r.x: r.w for r in kept.select(F.explode(F.split(F.lower("text"), "[\\x20\\x09-\\x0D]+")).alias("x")).distinct().select("x", katz.digest(F.col("x")).alias("w")).collect()}
    got = {r.doc_id: r.score for r in scores.collect()}
    for i, _, t in rows[:30]:
        ids, total = [katz.START, *[words.get(x, -1) for x in t], katz.END], 0.0
        for v, w in zip(ids, ids[1:]):
            p = by.get(v, {}).get(w)
            total += math.log10(p if p else weight.get(v, 1.0) * low.get(w, model.d.unknown))
        if all(ord(c) < 128 for x in t for c in x):  # lower() is for ASCII here
            assert got[i] == pytest.approx(total, abs=1e-4)


def test_odd_texts(spark):
    rows = [(1, None), (None, "A b"), (2, ""), (3, "a " * 3000 + "b"), (3, "a " * 3000 + "b"), (4, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "'x' as kind", "2 as h", "3 as held")
    got = sorted(((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in katz.train_and_score(df, F.lit(False), 2, 0.0)[0].collect()))
    n = Counter({"a": 6002, "b": 4, None: 6})
    base = lambda t: round(sum(math.log10((n[w] + 0.1) / (6012 + 0.1 * 4)) for w in [*t, None]), 6)
    long = ["a"] * 3000 + ["b"]
    assert got == sorted([("1", 1, 1, 6012, base([])), ("None", 3, 3, 6012, base("ab")), ("2", 1, 1, 6012, base([])), ("3", 3002, 3002, 6012, base(long)), ("3", 3002, 3002, 6012, base(long)), ("4", 3, 3, 6012, base("ab"))])
