"""Quality rules: n-gram log-likelihood ratio between a trusted target and the
raw corpus, beside plain repetition and length rules. DataFrame functions only.

Features are hashed unigrams and bigrams of the words as they stand; counts of
both multinomials are gathered over every document (only the trusted rows are a
bounded sample). A document's score is the mean over its features of
``log p_target(bucket) - log p_raw(bucket)``, both smoothed by PSEUDO counts a
bucket, in integers of micro-nats, so that the order of addition can't change a
verdict.

Cases: null or empty text: no word, all counts 0, score 0, ``base_failed``.
Null doc_id: kept as a row. Repeated rows: one result row each. Empty table:
empty result; without trusted rows every weight is 0. Columns other than
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import REST, let, literal_array, packed, table, unpacked, words

BUCKETS = 1 << 16
MAX_TARGET = 20_000
#: Mean log ratio; between the labelled rows of good and of bad quality.
MIN_SCORE = -0.12
PSEUDO = 5.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr_score")
MIN_WORDS = 50
MAX_REPEAT_PCT = 50


def ngrams3(h: Column) -> Column:
    """Hash of each window of three words, from the words' hashes; each has a
    window of its own where ``h`` has three or more elements."""
    n = F.size(h) - 2
    pairs = F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda a, b: F.xxhash64(a, b))
    return F.when(n < 1, F.array().cast("array<bigint>")).otherwise(F.zip_with(pairs, F.slice(h, 3, n), lambda a, b: F.xxhash64(a, b)))


def sorted_windows(g: Column) -> Column:
    """Where a window repeats: (upper 44 bits of the hash, position) of all
    windows in one sorted long each; null where none repeats."""
    return F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 20), 20).bitwiseOR(i.cast("long")))))


def covered(p: Column) -> Column:
    """Words in the 3-word windows that start at the sorted positions ``p``."""
    start = F.struct(F.lit(-9).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(p, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n")), lambda a: a["n"])


def repeated(g: Column, s: Column) -> Column:
    """Words inside windows that occur twice or more. ``g``: ngrams3(),
    ``s``: sorted_windows(g). Neighbours in ``s`` are compared by whole hashes;
    a text of over 2**20 words sorts (hash, position) structs instead."""
    at = lambda x: x.bitwiseAND(F.lit((1 << 20) - 1))
    n = F.size(s) - 1
    near = F.zip_with(F.slice(s, 1, n), F.slice(s, 2, n), lambda a, b: F.when((F.shiftrightunsigned(a, 20) == F.shiftrightunsigned(b, 20)) & (F.get(g, at(a).cast("int")) == F.get(g, at(b).cast("int"))), F.array(at(a), at(b))))
    far = let(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i")))), lambda t: F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))
    starts = lambda pairs: F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    return F.when(s.isNull(), F.lit(0).cast("long")).when(F.size(g) < (1 << 20), covered(starts(near))).otherwise(covered(starts(far)))


def bucket(h: Column, buckets: int) -> Column:
    """Its upper bits; ``buckets`` is a power of two."""
    return F.shiftrightunsigned(h, 65 - buckets.bit_length()).cast("int")


def bigrams(h: Column) -> Column:
    return F.when(F.size(h) < 2, F.array().cast("array<bigint>")).otherwise(F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h) - 1), lambda a, b: F.xxhash64(a, b)))


def hashed(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, max_target: int = MAX_TARGET) -> list[int]:
    """Log ratio of each bucket in micro-nats. ``trusted``: doc_id of reliable
    rows, of which the ``max_target`` first by hash order are taken (a bounded
    sample of labelled rows); raw counts are of all ``docs``."""
    ids = trusted.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target)
    marked = docs.select("doc_id", "text").join(F.broadcast(ids.withColumn("target", F.lit(1))), "doc_id", "left")
    each = marked.select(F.coalesce("target", F.lit(0)).alias("target"), hashed(words(F.col("text"))).alias("h"))
    one = each.select("target", F.explode(F.concat("h", bigrams(F.col("h")))).alias("x"))
    counts = one.groupBy(bucket(F.col("x"), buckets).alias("bucket")).agg(F.count("*").alias("raw"), F.sum("target").alias("target"))
    raw, good = [0] * buckets, [0] * buckets
    for at, n, t in counts.collect():  # at most `buckets` rows
        raw[at], good[at] = n, t
    if not sum(good):
        return [0] * buckets
    # raw counts on the target's scale; PSEUDO on either side leaves rare buckets near 0
    scale = sum(good) / sum(raw)
    return [round(1e6 * math.log((g + PSEUDO) / (r * scale + PSEUDO))) for r, g in zip(raw, good, strict=True)]


def measures(text: Column, ratio: Column, buckets: int, min_score: float, min_words: int, max_repeat_pct: int) -> Column:
    """All counts and verdicts of a text in one struct: a filter on one of them
    that Catalyst moves stays one expression, evaluated once a row."""
    zero = F.lit(0).cast("long")

    def judged(w: Column, l: Column, h: Column, g: Column, s: Column) -> Column:
        of = lambda a, x: a + F.coalesce(F.get(ratio, bucket(x, buckets)), zero)
        total = F.aggregate(bigrams(h), F.aggregate(h, zero, of), of)
        counts = F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines"),
            repeated(g, s).alias("n_repeat_words"),
            (total / (F.greatest(F.lit(1), F.size(w) * 2 - 1) * 1e6)).alias("llr_score"),
        )
        return let(counts, verdict)

    def verdict(c: Column) -> Column:
        failed = (c["n_words"] < min_words) | (c["n_repeat_words"] * 100 > c["n_words"] * max_repeat_pct)
        return F.struct(*[c[k].alias(k) for k in COUNTS], failed.alias("base_failed"), (~failed & (c["llr_score"] >= min_score)).alias("kept"))

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    by_window = lambda w, l, h: let(ngrams3(h), lambda g: let(sorted_windows(g), lambda s: judged(w, l, h, g, s)))
    return let(words(text), lambda w: let(lines, lambda l: let(hashed(w), lambda h: by_window(w, l, h))))


def quality(docs: DataFrame, trusted: DataFrame, *, buckets: int = BUCKETS, max_target: int = MAX_TARGET, min_score: float = MIN_SCORE, min_words: int = MIN_WORDS, max_repeat_pct: int = MAX_REPEAT_PCT, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, ``extra`` and the fields of measures() in __m."""
    ratio = literal_array(weights(docs, trusted, buckets, max_target), "bigint")
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", *extra, measures(text, ratio, buckets, min_score, min_words, max_repeat_pct).alias("__m"))


def trusted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows of good quality that aren't toxic."""
    return table(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), trusted_rows(spark, sf_dir)).select("doc_id", "__m.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with the columns of documents."""
    found = quality(packed(docs, "doc_id", "text"), trusted_rows(spark, sf_dir), extra=("text", REST)).where("__m.kept")
    return unpacked(found.drop("__m"), docs)
