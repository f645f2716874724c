"""Language identification: script ranges narrow the candidates, then Viterbi
over per-word scores with a switching penalty labels the spans of a text.

Words are runs of letters and combining marks that start with a letter, lower-cased. A word's score in a language is the sum
of smoothed log probabilities of its hashed character n-grams (1 to 4, with word
ends), learned from labelled texts; a language that never used the word's script
is no candidate. A document's language is the one with the most letters under
the best path, ``score`` that share of its letters. A path runs over the whole
text; of a long one only the states at the ends of its runs are kept, and each
run is gone through again on the way back.

Learning takes a bounded sample of labelled rows: the MAX_TRAIN first by a hash
of doc_id; what the driver gathers and tasks get is one row for each language and
bucket that the sample has. There may be any number of languages: where they have
more than DENSE cells, the same scores are put together word by word.

Cases: null text or one without a letter: ``und``, score 0, no span. Null
doc_id: kept, its remainder taken of the empty string. Ties: the least language
name. Repeated rows: one result row each. Without labelled rows all is ``und``.
Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MAX_TRAIN = 20_000
BUCKETS = 1 << 16
#: Buckets times languages that a worker keeps as one table.
DENSE = 500 * BUCKETS
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.5
PENALTY = 12.0
#: Log score of a language that doesn't use a word's script.
OTHER_SCRIPT = -40.0
#: Share of a language's letters from which a script counts as used.
SCRIPT_SHARE = 0.02
#: Words times languages in a run of Viterbi, and of which a worker remembers the scores.
RUN_CELLS, CACHE_CELLS = 4_000_000, 2_000_000
#: Words scored at once, times languages.
SCORED = 1 << 14
#: An odd number of 64 bits that mixes code points.
HASH = np.uint64(0x9E3779B97F4A7C15)
ASCII_LETTERS = re.compile("[A-Za-z]+")
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: First code point of each range, and its script.
RANGES = ((0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "devanagari"), (0x980, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x30000, "other"))
_STARTS = [x for x, _ in RANGES]


def places_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in (ASCII_LETTERS if text.isascii() else LETTERS).finditer(text)]


def words_of(text: str) -> list[str]:
    text = text.lower()
    return (ASCII_LETTERS if text.isascii() else LETTERS).findall(text)


def script_of(word: str) -> str:
    return RANGES[bisect.bisect_right(_STARTS, ord(word[0])) - 1][1]


def grams(words: list[str], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By order, the bucket of the n-gram at each place of the words with their
    ends, ``buckets`` where a word has none, and each word's first place."""
    text = "".join([f"^{w}$" for w in words])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)
    starts = np.r_[0, ends[:-1]]
    left = np.repeat(ends, ends - starts) - np.arange(len(points))
    for n in ORDERS:
        h = np.full(len(points) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * HASH + points[k : len(points) - n + 1 + k]
        found = np.full(len(points), buckets, np.int64)
        found[: len(h)] = (h * HASH >> np.uint64(32)) % np.uint64(buckets)
        found[left < n] = buckets
        yield found, starts


class Cells(NamedTuple):
    """Log scores of languages in buckets: ``logs`` of the languages ``at``, from
    ``starts`` on of each bucket; ``base`` of each language for what it never had."""

    base: np.ndarray
    starts: np.ndarray
    at: np.ndarray
    logs: np.ndarray

    def table(self, each: np.ndarray) -> np.ndarray:
        """Rows of buckets, in rising order; 0 for the one beyond the last."""
        out = np.tile(self.base, (len(each), 1))
        real = each[each < len(self.starts) - 1]
        n = self.starts[real + 1] - self.starts[real]
        cells = np.arange(n.sum()) + np.repeat(self.starts[real] - (n.cumsum() - n), n)
        out[np.repeat(np.arange(len(real)), n), self.at[cells]] = self.logs[cells]
        out[len(real) :] = 0
        return out


class Model:
    def __init__(self, langs: list[str], logs: np.ndarray | Cells, scripts: dict[str, set[str]]) -> None:
        """``logs``: buckets by languages, and a last row of zeros, or its cells."""
        self.langs, self.logs, self.scripts = langs, logs, scripts
        self.fits = np.array([[script in scripts[x] for x in langs] for _, script in RANGES], bool).reshape(len(RANGES), len(langs))
        self.known: dict[str, int] = {}
        self.rows = np.empty((1024, len(langs)), np.float32)
        self.dense = None if isinstance(logs, Cells) else logs
        self.buckets = len(logs.starts if isinstance(logs, Cells) else logs) - 1

    def __getstate__(self):
        return self.langs, self.logs, self.scripts

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def of_buckets(self, found: np.ndarray, most: int = DENSE) -> np.ndarray:
        """Log scores of buckets by languages."""
        if self.dense is None and self.buckets * len(self.langs) <= most:
            self.dense = self.logs.table(np.arange(self.buckets + 1))
        if self.dense is not None:
            return self.dense[found]
        each, places = np.unique(found, return_inverse=True)
        return self.logs.table(each)[places]

    def scores(self, words: list[str]) -> np.ndarray:
        """Words by languages."""
        out = sum(np.add.reduceat(self.of_buckets(found), starts, axis=0) for found, starts in grams(words, self.buckets))
        first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
        fits = self.fits[np.searchsorted(_STARTS, first, side="right") - 1]
        out = np.where(fits, out, out.max(1, keepdims=True) + OTHER_SCRIPT)
        return np.where(fits.any(1, keepdims=True), out, 0)

    def ids(self, words: list[str]) -> np.ndarray:
        """Row of each word in ``rows``; forgets all before a run if it is full."""
        known = self.known
        got = list(map(known.get, words))
        if None in got:
            fresh = list(set(words).difference(known))
            step = max(16, SCORED // len(self.langs))
            for i in range(0, len(fresh), step):
                some, n = fresh[i : i + step], len(known)
                while n + len(some) > len(self.rows):
                    self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
                self.rows[n : n + len(some)] = self.scores(some)
                known.update(zip(some, range(n, n + len(some)), strict=True))
            got = list(map(known.__getitem__, words))
        return np.array(got, np.int32)

    def fresh(self) -> None:
        if len(self.known) * len(self.langs) > CACHE_CELLS:
            self.known = {}
            self.rows = np.empty((1024, len(self.langs)), np.float32)


def labels_of(n: int) -> type:
    """The kind of numbers that ``n`` labels take."""
    return np.int16 if n < 1 << 15 else np.int32


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best label of each word; all texts of a run step together. ``scores``:
    words of the texts one after the other by labels."""
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
    n = scores.shape[1]
    kind = labels_of(n)
    back = np.empty(scores.shape, kind)
    own = np.arange(n, dtype=kind)[None, :]
    best = np.zeros((len(lengths), n))
    for t, live in enumerate(active):
        at, v = starts[:live] + t, best[:live]
        top = v.argmax(1)
        switched = v[np.arange(live), top] - penalty
        stay = v >= switched[:, None]
        back[at] = np.where(stay, own, top[:, None])
        best[:live] = np.where(stay, v, switched[:, None]) + scores[at]
    out = np.empty(len(scores), kind)
    label = best.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        live = active[t]
        at = starts[:live] + t
        out[at] = label[:live]
        label[:live] = back[at, label[:live]]
    return out


def long_path(scores, n: int, run: int, penalty: float = PENALTY) -> np.ndarray:
    """viterbi() of one text of ``n`` words, ``run`` at a time; ``scores(lo, hi)``
    are of a part of its words. The same path as in one run."""

    def forward(best: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        back, own = np.empty(part.shape, kind), np.arange(part.shape[1], dtype=kind)
        for t, row in enumerate(part):
            top = best.argmax()
            stay = best >= best[top] - penalty
            back[t] = np.where(stay, own, top)
            best = np.where(stay, best, best[top] - penalty) + row
        return best, back

    cuts = list(range(0, n, run))
    states = [np.zeros(scores(0, 1).shape[1])]
    kind = labels_of(len(states[0]))
    for lo in cuts:
        states.append(forward(states[-1], scores(lo, min(n, lo + run)))[0])
    out = np.empty(n, kind)
    label = int(states[-1].argmax())
    for lo, best in zip(reversed(cuts), reversed(states[:-1]), strict=True):
        back = forward(best, scores(lo, min(n, lo + run)))[1]
        for t in range(len(back) - 1, -1, -1):
            out[lo + t] = label
            label = int(back[t, label])
    return out


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def learn(docs: DataFrame, max_train: int = MAX_TRAIN, buckets: int = BUCKETS) -> Model:
    """From the first ``max_train`` rows by hash that have a text and a lang."""
    rows = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    ids = rows.select(F.xxhash64("doc_id").alias("h")).distinct().orderBy("h").limit(max_train).agg(F.max("h")).first()[0]
    sample = rows.where(F.xxhash64("doc_id") <= F.lit(ids)) if ids is not None else rows.limit(0)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                words: Counter = Counter()
                for text in texts:
                    words.update(words_of(text))
                sums, scripts = np.zeros(buckets, np.int64), Counter()
                listed = list(words.items())
                for i in range(0, len(listed), SCORED):
                    some, counts = zip(*listed[i : i + SCORED], strict=True)
                    for found, starts in grams(some, buckets):
                        sizes = np.diff(np.r_[starts, len(found)])
                        sums += np.bincount(found, np.repeat(counts, sizes), buckets + 1)[:buckets].astype(np.int64)
                for w, c in listed:
                    scripts[script_of(w)] += c * len(w)
                at = np.flatnonzero(sums)
                made = [(lang, "", int(b), int(sums[b])) for b in at] + [(lang, k, -1, c) for k, c in scripts.items()]
                if made:
                    yield pd.DataFrame(made, columns=["lang", "kind", "bucket", "n"])

    # columns of numbers, at most one for each language and bucket or script
    got = sample.mapInPandas(counted, "lang string, kind string, bucket int, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = got["lang"].combine_chunks().dictionary_encode() if got.num_rows else None
    langs = sorted(names.dictionary.to_pylist()) if got.num_rows else []
    letters: dict[str, Counter] = {x: Counter() for x in langs}
    at, place, n = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if got.num_rows:
        places = {x: i for i, x in enumerate(langs)}
        place = np.array([places[x] for x in names.dictionary.to_pylist()])[names.indices.to_numpy()]
        at, n = got["bucket"].to_numpy(), got["n"].to_numpy()
        for i in np.flatnonzero(at < 0):
            letters[langs[place[i]]][got["kind"][int(i)].as_py()] += int(n[i])
        order = np.lexsort((place, at))[np.count_nonzero(at < 0) :]
        at, place, n = at[order], place[order], n[order].astype(float)
    every = np.bincount(place, n, len(langs)) + SMOOTHING * buckets
    logs = lambda x, of: np.log((x + SMOOTHING) / every[of]).astype(np.float32)
    cells = Cells(logs(0.0, np.arange(len(langs))), np.searchsorted(at, np.arange(buckets + 1)), place.astype(np.int32), logs(n, place))
    return Model(langs, cells, {x: {s for s, c in letters[x].items() if c >= SCRIPT_SHARE * sum(letters[x].values())} for x in langs})


def _runs(texts: list[str | None], most: int) -> Iterator[list[tuple[int, list]]]:
    """Texts with letters as (place, words), ``most`` words in a run at most but
    for a single longer text."""
    held: list = []
    n = 0
    for i, text in enumerate(texts):
        words = words_of(text) if text else []
        if words:
            if held and n + len(words) > most:
                yield held
                held, n = [], 0
            held.append((i, words))
            n += len(words)
    if held:
        yield held


def labelled(model: Model, texts: list[str | None], cells: int = RUN_CELLS) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """(place, words, label of each word) of each text with letters."""
    if not model.langs:
        return
    most = max(1, cells // len(model.langs))

    def scores(words: list[str]) -> np.ndarray:
        model.fresh()
        ids = model.ids(words)  # may grow the rows
        return model.rows[ids]

    for run in _runs(texts, most):
        if len(run) == 1 and len(run[0][1]) > most:
            (i, words), *_ = run
            yield i, words, long_path(lambda lo, hi, ws=words: scores(ws[lo:hi]), len(words), most)
            continue
        lengths = np.array([len(ws) for _, ws in run])
        labels = viterbi(scores([w for _, ws in run for w in ws]), lengths)
        for (i, ws), end, n in zip(run, np.cumsum(lengths), lengths, strict=True):
            yield i, ws, labels[end - n : end]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and n_spans of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double, n_spans: int>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            out = [("und", 0.0, 0)] * len(texts)
            for i, words, labels in labelled(own, texts.tolist()):
                letters = np.bincount(labels, np.fromiter(map(len, words), np.int64, len(words)), len(own.langs))
                best = int(letters.argmax())
                out[i] = (own.langs[best], float(letters[best] / letters.sum()), 1 + int(np.count_nonzero(np.diff(labels))))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "n_spans"], index=texts.index)

    return docs.select("doc_id", found("text").alias("f")).select("doc_id", "f.*")


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, start, end (code points, of the words), lang of each span."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            texts, out = batch["text"].tolist(), []
            for i, words, labels in labelled(own, texts):
                places = places_of(texts[i])
                if len(places) != len(words):  # lower-casing moved letters: places in the lowered text
                    places = places_of(texts[i].lower())
                cuts = np.r_[0, np.flatnonzero(np.diff(labels)) + 1, len(words)]
                out += [(batch["doc_id"].iloc[i], places[a][0], places[b - 1][1], own.langs[labels[a]]) for a, b in zip(cuts, cuts[1:])]
            yield pd.DataFrame(out, columns=["doc_id", "start", "end", "lang"])

    return docs.select("doc_id", "text").mapInPandas(found, "doc_id long, start int, end int, lang string")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(crc_mod(F.col("doc_id"), 3) != 1))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "n_spans")
