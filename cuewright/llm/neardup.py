"""N-gram Jaccard join: MinHash banding, verified on the full n-gram sets.

Words are runs of characters other than white space, lower-cased; a document is
the set of its five-word shingles (its whole text where it has one to four
words). Texts of equal words are one node, found by an aggregate. Nodes that
agree on a band are candidates and are compared on their whole shingle sets. To
that end a node goes to a cell of its home, the largest of its buckets (small ones
share their largest neighbour's), and two cells are compared if some bucket has nodes of both their homes: a task gets two
cells of bounded texts and words, however large a bucket, and a chain of small
buckets costs its links, not the square of its length. A task returns the count
of links and the least connected node of each, never the pairs; classes are the
components of these ties.

Bands and rows: the most rows for which MAX_HASHES hashes reach the target
recall at the threshold (20 bands of 5 rows; 0.9996 at similarity 0.8, over
0.99999 at 0.85). Comparing whole clusters finds links that no band has.

Cases: null or empty text has no shingle and no link, and is a class of its own
by doc_id. Null doc_id: counts as the least id in its class, whose class_id is
null then. Repeated rows are copies of each other: a link each. Ties: the least
(doc_id, text digest) stands for a class. Empty table: empty result. Other
columns are ignored, or handed on by deduplicate().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import REST, packed, shared_dir, stored, table, unpacked, words

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9995
MAX_HASHES = 128
#: Texts and words of a cell, about.
BLOCK, BLOCK_WORDS = 256, 1 << 20
#: Numbers that numpy handles at once.
CHUNK = 1 << 20
LEAST = -(1 << 63)


#: Whether a text has a word; a cheap test that filters before the words are cut.
WORDED_SQL = "coalesce(text, '') rlike '[^\\\\x20\\\\x09-\\\\x0D]'"


def bands_rows(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose bands fit in ``max_hashes``."""
    for rows in range(max_hashes, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - min(threshold**rows, 1 - 1e-12)))
        if bands * rows <= max_hashes:
            return bands, rows
    raise ValueError("max_hashes is too small for this recall")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles in order, from the words' hashes."""
    h = h.astype(np.uint64, copy=False)
    if not len(h):
        return h
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out ^ h[i : len(h) - k + 1 + i])
    return out


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(7)
    return made.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), made.integers(0, 1 << 63, n, dtype=np.uint64)


def signer(bands: int, rows: int, size: int):
    """A mapInArrow function: (did, key, h) to (did, key, n_words, bands)."""
    a, b = _coefficients(bands * rows)

    def sign(sets: list[np.ndarray]) -> np.ndarray:
        """Band hashes of some documents, one row each."""
        x, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
        mins = np.empty((len(sets), bands * rows), np.uint64)
        for j in range(bands * rows):
            mins[:, j] = np.minimum.reduceat(x * a[j] + b[j], starts)
        out = np.repeat(np.arange(bands, dtype=np.uint64)[None, :], len(sets), 0)
        for r in range(rows):
            out = _mix(out ^ mins[:, r::rows])
        return out.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
            out: list[np.ndarray] = []
            held: list[np.ndarray] = []
            n = 0
            for i in range(len(lists)):
                s = shingles(values[offsets[i] : offsets[i + 1]], size)
                if n and n + len(s) > CHUNK:
                    out.append(sign(held))
                    held, n = [], 0
                held.append(s)
                n += len(s)
            if held:
                out.append(sign(held))
            got = np.concatenate(out) if out else np.empty((0, bands), np.int64)
            made = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, bands, dtype=np.int32)), pa.array(got.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int32)), made], ["did", "key", "n_words", "bands"])

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """did (doc_id, the least number if null), key (digest of the words; null
    without words) and __w of each row, beside its columns."""
    w = words(F.lower("text"))
    known = docs.withColumns({"did": F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)), "__w": w})
    return known.withColumn("key", F.when(F.size("__w") > 0, F.unhex(F.md5(F.array_join("__w", " ")))))


def hashed(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def starred(edges: DataFrame) -> DataFrame:
    """Ties (a, b) that connect what ``edges`` (key, hub) connect: one from each
    key to the least of its hubs, and the distinct ones among hubs. A large group
    has about as many as members, however many hubs each is tied to."""
    known = edges.groupBy("key").agg(F.min(F.least("key", "hub")).alias("least"), F.collect_set("hub").alias("hubs"))
    own = known.select(F.col("key").alias("a"), F.col("least").alias("b"))
    hubs = known.select(F.explode("hubs").alias("a"), F.col("least").alias("b")).distinct()
    return own.union(hubs).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node that each node of ``edges`` (a, b) is
    connected with. Labels spread along the edges and jump to their labels'
    labels until none changes; each round is checkpointed in the shared folder."""
    shared_dir(edges.sparkSession)
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).withColumnRenamed("a", "node").checkpoint()
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("l").alias("m"))
        spread = labels.join(near, labels.node == near.a).select("node", F.least("l", "m").alias("l"), F.col("l").alias("old"))
        up = labels.select(F.col("node").alias("l"), F.col("l").alias("ll"))
        new = spread.join(up, "l").select("node", F.col("ll").alias("l"), (F.col("ll") != F.col("old")).alias("moved")).checkpoint()
        moved = new.where("moved").limit(1).count()
        labels = new.select("node", "l")
        if not moved:
            return labels.select("node", F.col("l").alias("comp"))


def _linked(sets: list[np.ndarray], cross: np.ndarray | None, threshold: float) -> np.ndarray:
    """Matrix of links; ``cross``: which block each set is of, if two are given."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.float64)
    x, doc = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(x, kind="stable")
    x, doc = x[order], doc[order]
    first = np.r_[True, x[1:] != x[:-1]]
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    doc, column = doc[shared], column[shared]
    common = np.zeros((n, n))
    if len(column):
        column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
        for start in range(0, int(column[-1]) + 1, 4096):
            lo, hi = np.searchsorted(column, [start, start + 4096])
            m = np.zeros((n, min(4096, int(column[-1]) + 1 - start)), np.float32)
            m[doc[lo:hi], column[lo:hi] - start] = 1
            common += m @ m.T
    linked = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(linked, False)
    if cross is not None:
        linked &= cross[:, None] != cross[None, :]
    return linked


def verifier(threshold: float, size: int):
    """A mapInArrow function over rows sorted by (i, j): (i, j, cell, key, n, h)
    to (key, links, hub): the rows that a text is linked with, and the least key
    of those that it is connected with in this pair of cells."""

    def judged(rows: list) -> list[tuple[bytes, int, bytes]]:
        rows = list({r[3]: r for r in rows}.values())  # a repeated row comes twice
        keys, counts = [r[3] for r in rows], np.array([r[4] for r in rows])
        two = rows[0][0] != rows[0][1]
        linked = _linked([np.unique(shingles(r[5], size)) for r in rows], np.array([r[2] for r in rows]) if two else None, threshold)
        hub = np.empty(len(rows), object)
        order = sorted(range(len(rows)), key=keys.__getitem__)
        for i in order:
            if hub[i] is None:
                todo, hub[i] = [i], keys[i]
                while todo:
                    for j in np.flatnonzero(linked[todo.pop()]):
                        if hub[j] is None:
                            hub[j] = keys[i]
                            todo.append(j)
        return [(keys[i], int(counts[linked[i]].sum()), hub[i]) for i in range(len(rows)) if linked[i].any()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["key", "links", "hub"])
        held: list = []
        out: list = []
        for batch in batches:
            *plain, lists = batch.columns
            values, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
            for i, (first, *rest) in enumerate(zip(*(c.to_pylist() for c in plain), strict=True)):
                row = (first, *rest, values[offsets[i] : offsets[i + 1]].copy())
                if held and held[0][:2] != row[:2]:
                    out += judged(held)
                    held = []
                held.append(row)
            if len(out) > 5000:
                yield made(out)
                out = []
        if held:
            out += judged(held)
        if out:
            yield made(out)

    return run


def signed(docs: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, size: int = SHINGLE) -> DataFrame:
    """(did, key, bands) of each row with a word, stored."""
    bands, rows = bands_rows(threshold, recall)
    known = keyed(docs.select("doc_id", "text").where(WORDED_SQL))
    made = known.select("did", "key", hashed(F.col("__w")).alias("h")).mapInArrow(signer(bands, rows, size), "did long, key binary, n_words int, bands array<long>")
    return stored(made, "signed")


def cells(nodes: DataFrame, block: int, block_words: int) -> tuple[DataFrame, DataFrame]:
    """(key, home, cell, rep, n) of each text that shares a band with another,
    and (home, partners: arrays of other and parts). A text's home is the largest
    of its buckets, by its least key; a home of fewer than ``block`` texts moves
    into its largest neighbour's. A home has cells of about ``block`` texts and
    ``block_words`` words. Homes are partners if some bucket has texts of both."""
    each = nodes.select("key", F.explode("bands").alias("band"))
    buckets = each.groupBy("band").agg(F.min("key").alias("hub"), F.count("*").alias("c")).where("c > 1")
    of = each.join(buckets, "band").groupBy("key").agg(F.collect_set(F.struct("c", "hub")).alias("b"))  # at most one a band
    placed = stored(of.select("key", F.array_max("b")["hub"].alias("first"), F.array_distinct(F.transform("b", lambda x: x["hub"])).alias("hubs")), "placed")

    def neighbours(of: DataFrame) -> DataFrame:
        there = of.select(F.explode("hubs").alias("hub"), "home").distinct()
        return there.join(there.withColumnRenamed("home", "other"), "hub").select("home", "other").distinct()

    texts = placed.groupBy("first").agg(F.count("*").alias("c"))
    near = neighbours(placed.withColumnRenamed("first", "home")).join(texts.select(F.col("first").alias("other"), "c"), "other")
    largest = near.groupBy(F.col("home").alias("first")).agg(F.max(F.struct("c", "other"))["other"].alias("largest"))
    moved = texts.join(largest, "first").select("first", F.when(F.col("c") < block, F.col("largest")).otherwise(F.col("first")).alias("home"))
    settled = stored(placed.join(moved, "first").select("key", "home", "hubs"), "settled")
    member = settled.select("key", "home").join(nodes.select("key", "rep", "n", "n_words"), "key")
    homes = member.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_words") / block_words)).cast("int").alias("parts"))
    homes = stored(homes, "homes")
    partners = neighbours(settled).join(homes.select(F.col("home").alias("other"), "parts"), "other").groupBy("home").agg(F.collect_list(F.struct("other", "parts")).alias("partners"))
    cell = F.xxhash64("home", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    return member.join(homes, "home").select("key", "home", cell.alias("cell"), "rep", "n"), partners


def classes(docs: DataFrame, rows: DataFrame | None = None, *, threshold: float = THRESHOLD, recall: float = RECALL, size: int = SHINGLE, block: int = BLOCK, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each text of equal words: key, links (rows that it's linked
    with, copies included), rep (its least did) and the (rep, key) that stands for
    its class, as head. ``rows``: signed(docs)."""
    rows = signed(docs, threshold=threshold, recall=recall, size=size) if rows is None else rows
    nodes = stored(rows.groupBy("key").agg(F.min("did").alias("rep"), F.count("*").alias("n"), F.first("n_words").alias("n_words"), F.first("bands").alias("bands")), "nodes")
    member, partners = cells(nodes, block, block_words)
    # the texts themselves travel, not their hashes: only those of members are hashed
    texts = keyed(docs.select("doc_id", "text").where(WORDED_SQL)).select(F.col("did").alias("rep"), "key", "text")
    texts = texts.join(member, ["rep", "key"]).join(partners, "home")
    dealt = texts.select("cell", "key", "n", "text", F.explode("partners").alias("p")).select("cell", "key", "n", "text", "p.other", F.explode(F.sequence(F.lit(0), F.col("p.parts") - 1)).alias("at"))
    other = F.xxhash64("other", "at")
    dealt = dealt.select(F.least("cell", other).alias("i"), F.greatest("cell", other).alias("j"), "cell", "key", "n", hashed(words(F.lower("text"))).alias("h"))
    checked = stored(dealt.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(verifier(threshold, size), "key binary, links long, hub binary"), "links")
    comps = components(starred(checked.select("key", "hub")))
    total = checked.groupBy("key").agg(F.sum("links").alias("links")).join(comps.withColumnRenamed("node", "key"), "key").join(nodes.select("key", "rep"), "key")
    heads = total.groupBy("comp").agg(F.min(F.struct("rep", "key")).alias("head"))
    known = stored(total.join(heads, "comp").select("key", "links", "head"), "heads")
    own = F.struct("rep", "key")
    return nodes.select("key", "rep", "n").join(known, "key", "left").select("key", (F.coalesce("links", F.lit(0).cast("long")) + F.col("n") - 1).alias("links"), "rep", F.coalesce("head", own).alias("head"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class) and n_links of each row."""
    of = {k: v for k, v in options.items() if k in ("threshold", "recall", "size")}
    rows = signed(docs, **of)
    found = stored(classes(docs, rows, **options), "classes").select("key", "links", F.col("head.rep").alias("head"))
    named = rows.select("did", "key").join(found, "key").select("did", "links", "head")
    alone = docs.where(f"not ({WORDED_SQL})").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("did"), F.lit(0).cast("long").alias("links"))
    known = lambda c: F.when(F.col(c) != LEAST, F.col(c))
    return named.union(alone.withColumn("head", F.col("did"))).select(known("did").alias("doc_id"), known("head").alias("class_id"), F.col("links").alias("n_links"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, and all without a word; columns as given."""
    found = stored(classes(docs, **options), "classes")
    heads = found.where((F.col("rep") == F.col("head.rep")) & (F.col("key") == F.col("head.key"))).select(F.col("rep").alias("did"), "key")
    rows = keyed(packed(docs, "doc_id", "text")).drop("__w")
    once = rows.where(WORDED_SQL).join(heads, ["did", "key"]).dropDuplicates(["did", "key"]).select("doc_id", "text", REST)
    return unpacked(once.union(rows.where(f"not ({WORDED_SQL})").select("doc_id", "text", REST)), docs)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs)


OP3_SQL = r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), k as (
  select doc_id, array_to_string(w, ' ') as t from d where len(w) > 0
), n as (
  select *, row_number() over (order by t) as i from (select array_to_string(w, ' ') as t, count(*) as c, min(doc_id) as rep, any_value(w) as w from d where len(w) > 0 group by 1)
), s as (
  select distinct i, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda p: array_to_string(w[p:p + 4], ' '))) as g from n
), z as (
  select i, count(*) as m from s group by 1
), p as (
  select a.i, b.i as j, count(*) as c from s a join s b on a.g = b.g and a.i <> b.i group by 1, 2
), e as (
  select p.i, p.j from p join z x on x.i = p.i join z y on y.i = p.j where p.c * 10 >= 8 * (x.m + y.m - p.c)
), r(i, j) as (
  select i, i from n union select r.i, e.j from r join e on r.j = e.i
), h as (
  select r.i, min(n.rep) as head from r join n on r.j = n.i group by 1
), l as (
  select e.i, sum(n.c) as links from e join n on n.i = e.j group by 1
)
select k.doc_id, h.head as class_id, cast(coalesce(l.links, 0) + n.c - 1 as bigint) as n_links from k join n using (t) join h using (i) left join l using (i)
union all select doc_id, doc_id, 0 from d where len(w) = 0
"""
