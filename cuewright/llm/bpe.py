"""Byte-level BPE: texts to token ids and back, by the ranks of a public vocabulary.

Pieces are found without a regular expression. Each code point becomes a symbol
(its class, and what its neighbours make of it), each symbol is a transition
function over nine states, and since such functions compose associatively, all
states of a batch come from a scan: the functions of blocks of code points are
composed side by side, the blocks' functions are scanned by doubling, and a second
pass over the blocks starts from the states found. A piece's bytes are looked up in
a cache of merged pieces; what isn't there is merged pair by pair from a heap.

The vocabulary file and the classes (up to 2 MB, whatever the tables' size) are read
by the driver and broadcast. The classes are those that the tiktoken library at hand
gives to single code points, as its Unicode version decides them.

Cases: null or empty text: no tokens, decoded to no bytes. Null key and repeated
rows: as any other row. Very long texts and very long pieces: whole, in time
n log n. Text of special tokens: ordinary text. Empty table: empty result. Other
columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, trim

#: Code points that are cut into pieces at a time, but for longer texts.
BATCH_CHARS = 1 << 20
#: Code points of a block of the scan.
BLOCK = 128
#: Merged pieces that a task remembers, of up to so many bytes.
CACHED = 300_000
#: Bytes of the longest pieces that are merged side by side, and remembered.
SHORT_BYTES = 64
#: Ranks of what is no token, and of a pair that must be looked up.
NEVER, AGAIN = 1 << 30, 1 << 29
#: What stands before each text of a batch; never part of one.
MARK = "\ud800"

RESET, LETTER, NUMBER, OTHER, SPACE_LAST, WHITE_LAST, WHITE, QUOTE, SHORT, LONG = range(10)
FRESH, BLANK, PREFIX, WORD, DIGITS, MARKS, QUOTED, PAIR, DONE = STATES = range(9)


def step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a piece starts here). The pieces: an apostrophe with an
    ending, a run of one class with a space before it, white space up to the last
    before something else, white space."""
    if symbol == RESET:
        return FRESH, False
    if symbol in (SPACE_LAST, WHITE_LAST):  # the run before is cut off here
        return (PREFIX if symbol == SPACE_LAST else BLANK), True
    if symbol == WHITE:
        return BLANK, state != BLANK
    if symbol in (OTHER, QUOTE):
        goes_on = state in (PREFIX, MARKS, QUOTED)
        return (QUOTED if symbol == QUOTE and not goes_on else MARKS), not goes_on
    if symbol == NUMBER:
        return DIGITS, state not in (PREFIX, DIGITS)
    if state == PAIR or state == QUOTED and symbol == SHORT:
        return DONE, False
    if state == QUOTED and symbol == LONG:
        return PAIR, False
    return WORD, state not in (PREFIX, WORD)


#: By symbol and state, flat.
NEXT = np.array([[step(s, k)[0] for s in STATES] for k in range(10)], np.intp).ravel()
STARTS = np.array([[step(s, k)[1] for s in STATES] for k in range(10)]).ravel()
#: Endings after an apostrophe, of one and of two letters.
ENDINGS = "s t m d re ve ll"


def classes() -> np.ndarray:
    """LETTER, NUMBER, WHITE or OTHER of each code point, as tiktoken sees them."""
    import tiktoken

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, np.uint8)
    single = {bytes([i]): i for i in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        found = bytes(tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every))
        out[np.frombuffer(found.decode().encode("utf-32-le"), np.uint32)] = kind
    out[ord(MARK)] = RESET
    return out


def symbols(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The symbol of each code point. White space is cut before what isn't, a letter
    is SHORT or LONG where it may end or begin an ending."""
    own = kinds[points]
    after = np.append(own[1:], np.uint8(RESET))
    out = own.copy()
    last = (own == WHITE) & (after != WHITE) & (after != RESET)
    out[last] = WHITE_LAST
    out[last & (points == ord(" "))] = SPACE_LAST
    out[points == ord("'")] = QUOTE
    following = np.append(points[1:], np.uint32(0))
    for ending in ENDINGS.split():
        if len(ending) == 1:
            out[points == ord(ending)] = SHORT
        else:
            out[(points == ord(ending[0])) & (following == ord(ending[1]))] = LONG
    return out


def composed(functions: np.ndarray) -> np.ndarray:
    """Row i: rows 0 to i one after the other. By doubling, in log n steps."""
    out, width = functions, 1
    while width < len(out):
        out = np.concatenate([out[:width], np.take_along_axis(out[width:], out[:-width], 1)])
        width *= 2
    return out


def starts(found: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each symbol."""
    n = len(found)
    width = -(-n // BLOCK)
    padded = np.zeros(width * BLOCK, np.uint8)  # RESET
    padded[:n] = found
    places = np.ascontiguousarray(padded.reshape(width, BLOCK).T).astype(np.intp) * len(STATES)
    functions = np.tile(np.arange(len(STATES)), (width, 1))
    for place in places:
        functions = NEXT.take(place[:, None] + functions)
    state = np.concatenate([[FRESH], composed(functions)[:-1, FRESH]])
    out = np.empty((BLOCK, width), bool)
    for j, place in enumerate(places):
        at = place + state
        out[j], state = STARTS.take(at), NEXT.take(at)
    return out.T.ravel()[:n]


def merged(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of a piece: again and again the pair of the least rank, the leftmost
    of such, becomes one. In time n log n, for long pieces."""
    n = len(piece)
    after, before, live = list(range(1, n + 2)), list(range(-1, n)), [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < n and (rank := ranks.get(piece[i : after[j]])) is not None:
            heapq.heappush(heap, (rank, i, j, after[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, end = heapq.heappop(heap)
        if live[i] and j < n and live[j] and after[i] == j and after[j] == end:
            live[j], after[i] = False, end
            if end < n:
                before[end] = i
            offer(before[i], i)
            offer(i, end)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return tuple(out)


class Pairs:
    """What pairs of tokens become, and the merging of many short pieces at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        made = sorted((ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.keys, self.ranks = (np.array(x, np.int64) for x in zip(*made, strict=True)) if made else (np.zeros(1, np.int64) - 1, np.zeros(1, np.int64))
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ids of pairs of tokens, NEVER where they are none."""
        asked = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where(self.keys[at] == asked, self.ranks[at], NEVER)

    def merged(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids by piece. In each round every piece that has a pair merges its least,
        the leftmost of such; those that have none are done."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        owner, out = np.repeat(np.arange(len(pieces)), sizes), [()] * len(pieces)
        pair = np.append(self.of(ids[:-1], ids[1:]), NEVER)
        pair[np.cumsum(sizes) - 1] = NEVER  # the last of a piece has none after it
        while len(ids):
            places = np.arange(len(ids))
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(pair << 32 | places, first)
            done = least >> 32 >= NEVER
            counts = np.diff(np.append(first, len(ids)))
            if done.any():
                flat, gone = ids.tolist(), zip(owner[first[done]].tolist(), first[done].tolist(), counts[done].tolist())
                for k, i, n in gone:
                    out[k] = tuple(flat[i : i + n])
            at = least[~done] & 0xFFFFFFFF
            ids[at] = pair[at]
            keep = np.repeat(~done, counts)
            keep[at + 1] = False
            following = np.append(owner, [-1, -1])[at + 2]
            pair[at] = np.where(following == owner[at], AGAIN, NEVER)  # with what comes after the two
            last = at[at > 0] - 1
            last = last[owner[last] == owner[last + 1]]
            pair[last] = AGAIN
            ids, owner, pair = ids[keep], owner[keep], pair[keep]
            new = np.flatnonzero(pair == AGAIN)
            pair[new] = self.of(ids[new], ids[new + 1])
        return out


class Pieces(dict):
    """Ids by piece, the merged ones remembered up to a bound."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.pairs = ranks, Pairs(ranks)

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        """Has all of ``pieces`` from now on; gives those too long to keep."""
        every = set(pieces)
        if len(self) + len(every) > CACHED:
            self.clear()
        new = [x for x in every if x not in self]
        self.update((x, (r,)) for x in new if (r := self.ranks.get(x)) is not None)
        short = [x for x in new if x not in self and len(x) <= SHORT_BYTES]
        self.update(zip(short, self.pairs.merged(short), strict=True))
        long = [x for x in new if x not in self]
        self.update((x, merged(x, self.ranks)) for x in long)
        return long


class Tokenizer:
    def __init__(self, vocabulary: bytes, kinds: np.ndarray) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.kinds, self.pieces = kinds, Pieces(self.ranks)
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array([len(x) for x in self.tokens] or [0], np.int64)

    def cut(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The texts' bytes, the places where pieces start and their end at last,
        and the number of the texts' first pieces and of all at last."""
        points = np.frombuffer((MARK + MARK.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = starts(symbols(points, self.kinds))
        marks = points == ord(MARK)
        widths = np.where(marks, 0, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))
        ends = np.cumsum(widths)
        firsts = np.append(np.cumsum(begins)[marks], begins.sum())
        return "".join(texts).encode(), np.append((ends - widths)[begins], ends[-1]), firsts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, end of each token's bytes in its text, number of the texts' first
        tokens and of all at last)."""
        data, cuts, firsts = self.cut(texts)
        places = cuts.tolist()
        pieces = [data[a:b] for a, b in zip(places, places[1:])]
        long = self.pieces.learn(pieces)
        found = [self.pieces[x] for x in pieces]
        for x in long:
            del self.pieces[x]
        counts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        ids = np.fromiter(chain.from_iterable(found), np.int32, counts[-1])
        bounds = counts[firsts]
        ends = np.cumsum(self.sizes[ids])
        before = np.concatenate([[0], ends])[bounds[:-1]]
        return ids, ends - np.repeat(before, np.diff(bounds)), bounds

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


#: The tokenizer of a worker, by what it is made of.
MADE: dict[int, Tokenizer] = {}


def tokenizer(shared: Broadcast) -> Tokenizer:
    vocabulary, kinds = shared.value
    key = zlib.crc32(vocabulary)
    if key not in MADE:
        MADE.clear()
        MADE[key] = Tokenizer(vocabulary, np.frombuffer(zlib.decompress(kinds), np.uint8))
    return MADE[key]


def shared(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary of a file that the driver reads, for encode() and decode()."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((f.read(), zlib.compress(classes().tobytes(), 1)))


def encode(docs: DataFrame, vocabulary: Broadcast, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, ends): each text's token ids, and where the bytes of each token end
    in the text's UTF-8."""

    def groups(texts: list[str]) -> Iterator[tuple[int, int]]:
        first, size = 0, 0
        for i, x in enumerate(texts):
            if size and size + len(x) > BATCH_CHARS:
                yield first, i
                first, size = i, 0
            size += len(x)
        yield first, len(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups(texts):
                ids, ends, bounds = own.encode(texts[a:b])
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32())) for x in (ids, ends)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], ["key", "ids", "ends"])
            del batch, texts
            trim()

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"key {dict(docs.dtypes)[key]}, ids array<int>, ends array<int>").withColumnRenamed("key", key)


def decode(ids: Column, vocabulary: Broadcast) -> Column:
    """The bytes of token ids; null: null."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = tokenizer(vocabulary)
        for batch in batches:
            yield pd.Series([None if x is None else own.decode(x) for x in batch], index=batch.index, dtype=object)
            trim()

    return run(ids)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = shared(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = encode(table(spark, sf_dir, "documents"), vocabulary)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(decode(F.col("ids"), vocabulary), 256).alias("decoded_sha256"))
