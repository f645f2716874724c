"""What each operator makes of nulls, empty and long texts, ties, repeated rows and
columns of clashing names: values, not only counts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cuewright.llm import decontaminate, langid, mixing, neardup, quality, secrets

LONG = "alpha beta gamma delta " * 30_000
SIX = "one two three four five six"
ROWS = [(1, None, None, None), (None, "some words here", "en", "a"), (2, "", "en", None), (3, " \t\n", None, "a"), (4, LONG, "en", "a"), (5, SIX, "en", "a"), (5, SIX, "en", "a"), (6, SIX, "en", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    clash = ("term", "key", "target", "h", "kept", "hub", "cell", "home", "diag", "place", "salt", "exact", "weight", "topic", "n_tokens", "start", "kind", "bands")
    return df.withColumns({c: F.lit(1) for c in clash})


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_near_duplicates(odd):
    got = rows(neardup.near_duplicates(odd), "doc_id", "class_id", "n_links")
    assert got == sorted([(1, 1, 0), (None, None, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 2), (5, 5, 2), (6, 5, 2)], key=str)
    kept = rows(neardup.deduplicate(odd), *odd.columns)
    assert [r[:4] for r in kept] == sorted({r for r in ROWS if r[0] != 6}, key=str)


def test_decontamination(odd, spark):
    items = spark.createDataFrame([(7, "two three", 1), (None, "four five", 1), (8, "two three", 1), (9, None, 1), (9, " ", 1)], "item_id long, text string, doc_id long")
    got = rows(decontaminate.contaminated(odd, items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    none, both = (hashlib.sha256(x).hexdigest() for x in (b"", b"7,8"))
    assert got == sorted([(1, 0, 0, 0, none, False), (None, 3, 0, 0, none, False), (2, 0, 0, 0, none, False), (3, 0, 0, 0, none, False), (4, 120_000, 0, 0, none, False), (5, 6, 4, 2, both, True), (5, 6, 4, 2, both, True), (6, 6, 4, 2, both, True)], key=str)
    assert [r[0] for r in rows(decontaminate.clean(odd, items), "doc_id")] == [1, 2, 3, 4, None]


def test_quality(odd):
    got = rows(quality.quality(odd, odd.select("doc_id")).select("doc_id", "__m.*"), "doc_id", "n_words", "word_chars", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert got == sorted([(1, 0, 0, 0, 0, True, False), (None, 3, 13, 0, 0, True, False), (2, 0, 0, 0, 0, True, False), (3, 0, 0, 0, 0, True, False), (4, 120_000, 570_000, 0, 120_000, True, False), (5, 6, 22, 0, 0, True, False), (5, 6, 22, 0, 0, True, False), (6, 6, 22, 0, 0, True, False)], key=str)
    untrained = quality.quality(odd, odd.select("doc_id").limit(0)).select("__m.llr_score").collect()
    assert {r.llr_score for r in untrained} == {0.0}


def test_secrets_and_mixing(odd):
    got = rows(secrets.digests(secrets.found(odd)), "doc_id", "n_assign", "n_access", "n_hex", "n_random", "spans")
    assert got == sorted([(r[0], 0, 0, 0, 0, "") for r in ROWS], key=str)
    assert rows(secrets.redact(odd), *odd.columns) == rows(odd, *odd.columns)
    mixed = rows(mixing.mix(odd), "doc_id", "source", "lang", "topic", "n_tokens")
    tokens = {1: 0, None: 3, 2: 0, 3: 0, 4: 120_000, 5: 6, 6: 6}
    assert mixed == sorted([(r[0], r[3], r[2], "prose", tokens[r[0]]) for r in ROWS], key=str)
    twice = [r for r in mixing.mix(odd).collect() if r.doc_id == 5]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_languages(odd):
    got = rows(langid.predict(odd, langid.learn(odd)), "doc_id", "lang_pred", "score")
    und = {1, 2, 3}
    assert got == sorted([(r[0], "und", 0.0) if r[0] in und else (r[0], "en", 1.0) for r in ROWS], key=str)
    assert {r.lang_pred for r in langid.predict(odd, langid.learn(odd.limit(0))).collect()} == {"und"}
