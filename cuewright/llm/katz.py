"""LM scoring: a Katz backoff bigram model with Good-Turing discounts.

Tokens are words and one end for each text; the first word's context is a start
mark. With c counts in training tokens and N their number:

    P(w)    = d1(c) c / N                      if c > 0, else what is left over
    P(w|v)  = d2(c) c(v,w) / c(v)              if c(v,w) > 0
            = a(v) P(w)                        else, and P(w) if v is unknown

d(r) is Good-Turing's discount up to MAX_R, from the corpus-wide counts of
counts, and (r - 0.5) / r above, so that each context keeps something; a(v)
makes the probabilities of a context, unknown word included, sum to exactly 1.
Where the counts of counts give no discount between 0 and 1, (r - 0.5) / r holds.

How it runs. A first pass counts words: a table (w, c, n) of counts in training and
in all, from which come N, V and the discounts of words, and the frequent words, at
most HOT of them, which every task knows. Then tasks turn chunks of texts into one
row for each part: the chunk's distinct bigrams, their training counts, and which
documents have them how often, packed. A part has the bigrams that end in its
words; those that end in a frequent word are dealt by both words, so no word fills
a part. A part merges its rows, stores the model's tables and, for each chunk, the
sums that its documents need. Bigrams that training lacks go to the part of their
first word, which knows its counts and, from packed sums of all parts, its backoff
weight; those of frequent first words, whose weights are gathered first, go to any
part. Last, the sums of a chunk's documents meet. No task gets more than a part or
a chunk, and parts grow in number with the text. tables() reads the model as columns.
A word is known by 48 bits of its digest: of 10**9 different words about 2000 pairs
count as one.

Order: bigrams. In a chunk of a million tokens of the check's documents 0.71 million
bigrams differ, and 0.86 million trigrams; at 8 bytes each these would add 1.8 times
the input to the 3.6 times that shuffles and tables take on disk, of 4 allowed.

Cases: null or empty text: only the end token. Null doc_id: kept, its remainder
taken of the empty string. Repeated rows: one result row each, each learned from.
No training rows: score and base_score come from the unknown word alone. Empty
table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table, trim, words
from .langid import crc_mod

MAX_R = 5
#: Tokens for each part, and in a chunk.
PART_TOKENS, CHUNK_TOKENS = 1_300_000, 1_000_000
#: Frequent words that all tasks know, at most.
HOT = 8192
#: Different words that a task of the first pass holds.
HELD_WORDS = 1_000_000
START, END = 0, 1
MASK = (1 << 48) - 1
UNIT = float(1 << 24)
ROW = "part int, kind string, chunk long, data binary"


def packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(3).compress(pickle.dumps(arrays, 5))


def unpacked(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def split48(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48-bit keys as differences modulo 2**48, which pack well where they are
    sorted in runs."""
    x = np.diff(x, prepend=np.int64(0)) & MASK
    return (x & 0xFFFFFFFF).astype(np.uint32), (x >> 32).astype(np.uint16)


def join48(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.cumsum(low.astype(np.int64) | high.astype(np.int64) << 32) & MASK


def fixed(x: np.ndarray) -> np.ndarray:
    """Sums of logarithms in units of 2**-24, which pack better than floats and
    add up the same in any order."""
    return np.rint(x * UNIT).astype(np.int64)


def part_of(w: np.ndarray, parts: int) -> np.ndarray:
    return (w >> 8) % parts


class Hot:
    """Frequent words, sorted, with their training counts; START is one of them."""

    def __init__(self, rows: list[tuple[int, int]], texts: int) -> None:
        known = dict(rows) | {START: texts}
        self.words = np.array(sorted(known), np.int64)
        self.counts = np.array([known[w] for w in sorted(known)], np.int64)

    def places(self, w: np.ndarray) -> np.ndarray:
        """Places among the frequent words, -1 if it isn't one."""
        at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
        return np.where(self.words[at] == w, at, -1)

    def part(self, first: np.ndarray, second: np.ndarray, parts: int) -> np.ndarray:
        """Part of ``second``, by both if it is frequent."""
        return np.where(self.places(second) >= 0, (first * 31 + second >> 7) % parts, part_of(second, parts))


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, held, h) to rows of (w, c, n), ends included."""
    held: list[np.ndarray] = []

    def folded(x: np.ndarray) -> np.ndarray:
        x = x[:, np.argsort(x[0], kind="stable")]
        at = np.flatnonzero(np.r_[True, x[0, 1:] != x[0, :-1]])
        return np.stack([x[0, at], np.add.reduceat(x[1], at), np.add.reduceat(x[2], at)])

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["w", "c", "n"])
        held.clear()
        trim()
        return made

    for batch in batches:
        train, lists = ~np.asarray(batch.column(1)), batch.column(2)
        values, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
        own = values[offsets[0] : offsets[-1]]
        w, n = np.unique(own, return_counts=True)
        c = np.zeros_like(n)
        some, k = np.unique(own[np.repeat(train, np.diff(offsets))], return_counts=True)
        c[np.searchsorted(w, some)] = k
        held.append(np.stack([np.r_[w, END], np.r_[c, train.sum()], np.r_[n, len(train)]]).astype(np.int64))
        if sum(x.shape[1] for x in held) > HELD_WORDS:
            held[:] = [folded(np.concatenate(held, axis=1))]
            if held[0].shape[1] > HELD_WORDS // 2:
                yield out()
    if held:
        held[:] = [folded(np.concatenate(held, axis=1))]
        yield out()


def steps(sorted_keys: np.ndarray) -> np.ndarray:
    """Differences of sorted keys, the first in full: they pack well."""
    return np.diff(sorted_keys, prepend=np.int64(0))


def log10(x: np.ndarray | float) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


def chunker(parts: int, hot: Hot):
    """(doc_id, held, h) to ROW: bigrams of chunks by part, and their documents."""

    def rows(chunk: int, docs: list) -> Iterator[tuple]:
        hs = [h for *_, h in docs]
        lengths = np.array([len(h) + 1 for h in hs])
        ends = np.cumsum(lengths)
        second = np.full(ends[-1], END, np.int64)
        place = np.ones(ends[-1], bool)
        place[ends - 1] = False
        second[place] = np.concatenate(hs)
        first = np.empty_like(second)
        first[1:] = second[:-1]
        first[ends - lengths] = START
        doc = np.repeat(np.arange(len(docs), dtype=np.int32), lengths)
        train = np.repeat(np.array([not held for _, held, _ in docs]), lengths)
        part = hot.part(first, second, parts)
        order = np.lexsort((first, second, part))
        part, second, first, doc, train = part[order], second[order], first[order], doc[order], train[order]
        cuts = np.searchsorted(part, np.arange(parts + 1))
        for p in range(parts):
            lo, hi = cuts[p], cuts[p + 1]
            if lo == hi:
                continue
            b, a = second[lo:hi], first[lo:hi]
            own = doc[lo:hi]  # sorted for each bigram
            starts = np.r_[True, (b[1:] != b[:-1]) | (a[1:] != a[:-1])]
            new, each = np.flatnonzero(starts), np.flatnonzero(starts | np.r_[True, own[1:] != own[:-1]])
            counts = np.add.reduceat(train[lo:hi].astype(np.int64), new)
            listed = np.diff(np.r_[np.searchsorted(each, new), len(each)])
            yield p, "bigrams", chunk, packed(steps(b[new]), *split48(a[new]), counts.astype(np.int32), listed.astype(np.int32), own[each].astype(np.uint16 if len(docs) < 65536 else np.int32), np.diff(np.r_[each, hi - lo]).astype(np.int32))
        ids = np.array([i if i is not None else 0 for i, *_ in docs], np.int64)
        yield int(chunk % parts), "documents", chunk, packed(ids, np.array([i is None for i, *_ in docs]), np.array([held for _, held, _ in docs]), lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, n = TaskContext.get().partitionId() << 32, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            for p, kind, at, data in rows(chunk, held):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([kind]), pa.array([at], pa.int64()), pa.array([data], pa.binary())], ["part", "kind", "chunk", "data"])

        for batch in batches:
            ids, flags, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            values, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
            for i in range(len(ids)):
                h = values[offsets[i] : offsets[i + 1]]
                if held and n + len(h) > CHUNK_TOKENS:
                    yield from out()
                    chunk, held, n = chunk + 1, [], 0
                    trim()
                held.append((ids[i], flags[i], h.copy()))
                n += len(h) + 1
        if held:
            yield from out()
        del held
        trim()

    return run


def merged(p: int, rows: pd.DataFrame, parts: int, hot: Hot) -> list[tuple]:
    """What a part makes of its chunks' bigrams."""
    out = [(p, "documents", r.chunk, r.data) for r in rows[rows["kind"] == "documents"].itertuples()]
    chunks = [(r.chunk, unpacked(r.data)) for r in rows[rows["kind"] == "bigrams"].itertuples()]
    if not chunks:
        return out
    second = np.concatenate([np.cumsum(x[0]) for _, x in chunks])
    first = np.concatenate([join48(x[1], x[2]) for _, x in chunks])
    counts = np.concatenate([x[3] for _, x in chunks]).astype(np.int64)
    order = np.lexsort((first, second))
    b, a = second[order], first[order]
    del second, first
    new_word = np.r_[True, b[1:] != b[:-1]]
    new = new_word | np.r_[True, a[1:] != a[:-1]]
    at = np.flatnonzero(new)
    c = np.add.reduceat(counts[order], at)
    b, a = b[at], a[at]
    word_at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    of_word = np.cumsum(np.r_[True, b[1:] != b[:-1]]) - 1
    frequent = hot.places(b[word_at])
    cw = np.where(frequent >= 0, hot.counts[frequent], np.add.reduceat(c, word_at))
    where = np.empty(len(order), np.int64)
    where[order] = np.cumsum(new) - 1
    del counts, order, new, new_word
    # the model's tables
    seen, known = c > 0, (cw > 0) & (frequent < 0)
    out.append((p, "unigram-table", -1, packed(steps(b[word_at][known]), cw[known])))
    out.append((p, "bigram-table", -1, packed(steps(b[seen]), *split48(a[seen]), c[seen].astype(np.int32))))
    out.append((p, "counts", -1, packed(np.bincount(np.minimum(c[seen], MAX_R + 2), minlength=MAX_R + 3)[1 : MAX_R + 2])))
    # sums of each context over the bigrams that end here
    by = np.argsort(a[seen], kind="stable")
    ctx, r, low = a[seen][by], np.minimum(c[seen][by], MAX_R + 1), cw[of_word[seen]][by]
    if len(ctx):
        starts = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]])
        sums = [np.add.reduceat((r == k).astype(np.int64), starts) for k in range(1, MAX_R + 2)]
        sums += [np.add.reduceat((low == k).astype(np.int64), starts) for k in range(1, MAX_R + 1)]
        sums += [np.add.reduceat((low > MAX_R).astype(np.int64), starts), np.add.reduceat(np.where(low > MAX_R, low, 0), starts)]
        sums = np.stack(sums)
        sums = sums.astype(np.int32) if sums.max() < 1 << 31 else sums
        out += dealt(parts, "contexts", ctx[starts], sums, part_of(ctx[starts], parts))
    del by, ctx, r, low
    # sums of each document
    start, lacking = 0, []
    chunks.reverse()
    while chunks:
        chunk, x = chunks.pop()
        entry = where[start : start + len(x[0])]
        start += len(x[0])
        occurs = np.repeat(entry, x[4])
        doc, n, times = x[5].astype(np.int64), int(x[5].max()) + 1, x[6].astype(np.int64)
        r, w = c[occurs], cw[of_word[occurs]]
        total = lambda v: np.bincount(doc, v * times, n)  # noqa: E731, B023
        own = np.where(r > MAX_R, log10(r - 0.5), log10(np.maximum(r, 1)))
        own -= np.where((w > 0) & (b[occurs] != END), log10(w), 0)
        there = np.flatnonzero(np.bincount(doc, minlength=n))
        made = [total(log10(w + 0.1)), total(own)], [total((w > 0).astype(float)), *[total((r == k).astype(float)) for k in range(1, MAX_R + 1)]]
        out.append((p, "sums", chunk, packed(there.astype(np.int32), fixed(np.stack(made[0])[:, there]), np.stack(made[1])[:, there].astype(np.int32))))
        if (lack := r == 0).any():
            lacking.append((a[occurs][lack], np.full(lack.sum(), chunk), doc[lack], w[lack], times[lack]))
    if lacking:
        v, *rest = (np.concatenate(x) for x in zip(*lacking, strict=True))
        sort = np.lexsort((rest[0], v))
        v, rest = v[sort], np.stack(rest)[:, sort]
        anywhere = (rest[0] ^ rest[0] >> 32) % parts
        out += dealt(parts, "backoffs", v, rest, np.where(hot.places(v) >= 0, anywhere, part_of(v, parts)))
    return out


def dealt(parts: int, kind: str, keys: np.ndarray, values: np.ndarray, part: np.ndarray) -> list[tuple]:
    """Columns of ``values`` by sorted key, sent to parts: a row for each part that
    gets any, whatever the number of chunks."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    out = []
    for p in np.flatnonzero(np.diff(cuts)):
        at = order[cuts[p] : cuts[p + 1]]
        out.append((int(p), kind, -1, packed(steps(keys[at]), values[:, at])))
    return out


class Discounts:
    """d(r) of both orders and the totals, from the counts of counts; d2 is set
    when the bigrams are counted."""

    def __init__(self, tokens: int, words: int, texts: int, n1: np.ndarray) -> None:
        """``n1``: how many words occur 1 to MAX_R + 1 times."""
        self.tokens, self.words, self.texts, self.d1 = tokens, words, texts, self.of(n1)
        self.d2 = np.ones(MAX_R + 1)
        kept = sum(n1[r - 1] * r * self.d1[r] for r in range(1, MAX_R + 1))
        small = sum(n1[r - 1] * r for r in range(1, MAX_R + 1))
        big = words - int(n1[:MAX_R].sum())
        self.unknown = 1 - (kept + tokens - small - 0.5 * big) / max(tokens, 1)

    @staticmethod
    def of(n: np.ndarray) -> np.ndarray:
        """d[r] for r in 1 to MAX_R; n[r-1]: kinds seen r times."""
        out = np.ones(MAX_R + 1)
        share = (MAX_R + 1) * n[MAX_R] / n[0] if n[0] else 1.0
        for r in range(1, MAX_R + 1):
            star = (r + 1) * n[r] / n[r - 1] if n[r - 1] else 0.0
            d = (star / r - share) / (1 - share) if share < 1 else 0.0
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return out

    def high(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts of bigrams that occur ``c`` times."""
        return np.where(c > MAX_R, c - 0.5, self.d2[np.minimum(c, MAX_R)] * c)

    def low(self, c: np.ndarray) -> np.ndarray:
        """P(w) of words with counts ``c``."""
        small = self.d1[np.minimum(c, MAX_R)] * c
        return np.where(c == 0, self.unknown, np.where(c > MAX_R, c - 0.5, small) / max(self.tokens, 1))


def weights(sums: np.ndarray, counts: np.ndarray, d: Discounts) -> np.ndarray:
    """a(v) of contexts, from their sums and counts."""
    r = np.arange(1, MAX_R + 1)
    left = ((r * (1 - d.d2[1:]))[:, None] * sums[:MAX_R]).sum(0) + 0.5 * sums[MAX_R]
    low = ((r * d.d1[1:])[:, None] * sums[MAX_R + 1 : 2 * MAX_R + 1]).sum(0) + sums[2 * MAX_R + 2] - 0.5 * sums[2 * MAX_R + 1]
    return left / counts / np.maximum(1 - low / max(d.tokens, 1), 1e-300)


def context_weights(rows: pd.DataFrame, d: Discounts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a part, sorted, their counts, and their backoff weights. START is
    the first, so that there is always one."""
    of = lambda kind: [unpacked(x) for x in rows[rows["kind"] == kind]["data"]]
    tables = of("unigram-table")
    words = np.r_[START, np.cumsum(tables[0][0]) if tables else np.empty(0, np.int64)]
    counts = np.r_[d.texts, tables[0][1] if tables else np.empty(0, np.int64)]
    sums = np.zeros((2 * MAX_R + 3, len(words)), np.int64)
    for keys, values in of("contexts"):
        keys = np.cumsum(keys)
        at = np.minimum(np.searchsorted(words, keys), len(words) - 1)
        own = words[at] == keys  # frequent words aren't in the part's table
        sums[:, at[own]] += values[:, own]  # a part names a context once
    return words, counts, np.where(counts > 0, weights(sums, np.maximum(counts, 1), d), 1.0)


def backed_off(p: int, rows: pd.DataFrame, d: Discounts, hot: Hot, hot_weights: np.ndarray) -> list[tuple]:
    """Sums of the documents' bigrams that training lacks, by their first words."""
    wanted = [unpacked(x) for x in rows[rows["kind"] == "backoffs"]["data"]]
    if not wanted:
        return []
    words, counts, a = context_weights(rows, d)
    v = np.concatenate([np.cumsum(keys) for keys, _ in wanted])
    chunk, doc, w, times = np.concatenate([values for _, values in wanted], axis=1)
    at, frequent = np.minimum(np.searchsorted(words, v), len(words) - 1), hot.places(v)
    mass = np.where(words[at] == v, counts[at], 0)
    mass, a = np.where(frequent >= 0, hot.counts[frequent], mass), np.where(frequent >= 0, hot_weights[frequent], a[at])
    own = (np.where(mass > 0, log10(a) + log10(mass), 0) + log10(d.low(w))) * times
    order = np.lexsort((doc, chunk))
    chunk, doc, own = chunk[order], doc[order], own[order]
    new = np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (doc[1:] != doc[:-1])])
    total, chunk, doc = np.add.reduceat(own, new), chunk[new], doc[new]
    cuts = np.r_[np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]), len(chunk)]
    out = []
    for lo, hi in zip(cuts, cuts[1:]):
        sums = fixed(np.stack([np.zeros(hi - lo), total[lo:hi]]))
        out.append((p, "sums", int(chunk[lo]), packed(doc[lo:hi].astype(np.int32), sums, np.zeros((MAX_R + 1, hi - lo), np.int32))))
    return out


def hot_contexts(model: DataFrame, hot: Hot, d: Discounts) -> np.ndarray:
    """Backoff weights of the frequent words; at most HOT rows are gathered."""
    names = [f"s{i}" for i in range(2 * MAX_R + 3)]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2 * MAX_R + 3, len(hot.words)), np.int64)
        for batch in batches:
            for data in batch["data"]:
                keys, values = unpacked(data)
                at = hot.places(np.cumsum(keys))
                total[:, at[at >= 0]] += values[:, at >= 0]
        there = np.flatnonzero(total.any(0))
        yield pd.DataFrame({"at": there.astype(np.int32)} | dict(zip(names, total[:, there], strict=True)))

    rows = model.where("kind = 'contexts'").select("data").mapInPandas(sums, "at int, " + ", ".join(f"{n} long" for n in names))
    found = np.zeros((2 * MAX_R + 3, len(hot.words)), np.int64)
    for at, *own in rows.groupBy("at").agg(*[F.sum(n).alias(n) for n in names]).collect():
        found[:, at] = own
    return np.where(hot.counts > 0, weights(found, np.maximum(hot.counts, 1), d), 1.0)


def summed(rows: pd.DataFrame, d: Discounts) -> pd.DataFrame:
    """The result rows of a chunk."""
    ids, null, held, lengths = unpacked(rows[rows["kind"] == "documents"]["data"].iloc[0])
    real, whole = np.zeros((2, len(ids)), np.int64), np.zeros((MAX_R + 1, len(ids)), np.int64)
    for data in rows[rows["kind"] == "sums"]["data"]:
        at, x, y = unpacked(data)
        real[:, at] += x
        whole[:, at] += y
    real = real / UNIT
    score = real[1] + (log10(d.d2[1:])[:, None] * whole[1:]).sum(0)
    score -= log10(d.texts) if d.texts else 0  # the start mark, as every text's first context
    base = real[0] - lengths * np.log10(d.tokens + 0.1 * (d.words + 1))
    made = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": held, "n_tokens": lengths, "n_known": whole[0], "train_tokens": d.tokens, "base_score": base, "score": score})
    made.loc[null, "doc_id"] = pd.NA
    return made


def grouped(made):
    """For applyInPandas; ``made(part, rows)`` returns tuples of ROW."""
    columns = [x.split()[0] for x in ROW.split(", ")]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(made(int(key[0]), rows), columns=columns)
        trim()
        return out

    return run


class Model:
    """A trained model: ``blocks`` (ROW, stored by kind), ``words`` (w, c, n)."""

    def __init__(self, blocks: DataFrame, words: DataFrame, d: Discounts, hot: Hot, hot_weights: np.ndarray) -> None:
        self.blocks, self.words, self.d, self.hot, self.hot_weights = blocks, words, d, hot, hot_weights

    def tables(self) -> tuple[DataFrame, DataFrame]:
        """(v, w, c, p): discounted probabilities of the bigrams seen in training
        times c(v), and (v, backoff): weights of the contexts."""
        d, hot, of_hot = self.d, self.hot, self.hot_weights

        def bigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for data in batch["data"]:
                    second, *first, c = unpacked(data)
                    yield pd.DataFrame({"v": join48(*first), "w": np.cumsum(second), "c": c.astype(np.int64), "mass": d.high(c.astype(np.int64))})

        def contexts(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            words, counts, a = context_weights(rows, d)
            own = (counts > 0) & (hot.places(words) < 0)
            return pd.DataFrame({"v": words[own], "backoff": a[own]})

        spark = self.blocks.sparkSession
        seen = self.blocks.where("kind = 'bigram-table'").select("data").mapInPandas(bigrams, "v long, w long, c long, mass double")
        total = self.words.where("c > 0").select(F.when(F.col("w") == END, START).otherwise(F.col("w")).alias("v"), F.col("c").alias("cv"))
        frequent = spark.createDataFrame([(int(v), float(x)) for v, c, x in zip(hot.words, hot.counts, of_hot, strict=True) if c > 0 and v != END], "v long, backoff double")
        others = self.blocks.where("kind in ('unigram-table', 'contexts')").groupBy("part").applyInPandas(contexts, "v long, backoff double").where(F.col("v") != END)
        return seen.join(total, "v").select("v", "w", "c", (F.col("mass") / F.col("cv")).alias("p")), others.union(frequent)


def digest(word: Column) -> Column:
    """48 bits, and never START or END."""
    return F.greatest(F.shiftrightunsigned(F.xxhash64(word), 16), F.lit(2).cast("long"))


def train_and_score(docs: DataFrame, held_out: Column, parts: int | None = None, hot_share: float | None = None) -> tuple[DataFrame, Model]:
    """(scores of all documents, the model). Rows where ``held_out`` is true aren't
    learned from. Words with more than ``hot_share`` of the tokens (a quarter of a
    part's share by default) are dealt by their bigrams."""
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    hashed = docs.select("doc_id", held_out.alias("held"), F.transform(words(text), digest).alias("h"))
    counted = stored(hashed.mapInArrow(word_counts, "w long, c long, n long").groupBy("w").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "katz-words")
    kinds = [F.sum(F.when(F.col("c") == r, 1).otherwise(0)) for r in range(1, MAX_R + 2)]
    every, tokens, known, texts, *n1 = (int(x or 0) for x in counted.agg(F.sum("n"), F.sum("c"), F.sum(F.when(F.col("c") > 0, 1)), F.sum(F.when(F.col("w") == END, F.col("c"))), *kinds).first())
    d = Discounts(tokens, known, texts, np.array(n1))
    parts = parts or max(1, -(-every // PART_TOKENS))
    share = hot_share if hot_share is not None else 1 / (4 * parts)
    frequent = counted.where(F.col("n") > share * every).orderBy(F.desc("n"), "w").limit(HOT).select("w", "c").collect()
    hot = Hot([tuple(r) for r in frequent], texts)
    chunks = hashed.mapInArrow(chunker(parts, hot), ROW)
    # as many partitions as parts: a task gets few of them, however many there are
    model = chunks.repartition(parts, "part").groupBy("part").applyInPandas(grouped(lambda p, rows: merged(p, rows, parts, hot)), ROW)
    model = stored(model, "katz-model", by=("kind",))
    n2 = sum((unpacked(r["data"])[0] for r in model.where("kind = 'counts'").collect()), np.zeros(MAX_R + 1, np.int64))  # a row of a few numbers for each part
    d.d2 = d.of(n2)
    hot_weights = hot_contexts(model, hot, d)
    asked = model.where("kind in ('unigram-table', 'contexts', 'backoffs')")
    more = asked.repartition(parts, "part").groupBy("part").applyInPandas(grouped(lambda p, rows: backed_off(p, rows, d, hot, hot_weights)), ROW)
    sums = model.where("kind in ('documents', 'sums')").unionByName(more)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scores = sums.groupBy("chunk").applyInPandas(lambda key, rows: summed(rows, d), schema)
    return scores, Model(model, counted, d, hot, hot_weights)


def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return train_and_score(docs, crc_mod(F.col("doc_id"), 10) == 0)[0]
