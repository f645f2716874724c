"""Benchmark decontamination: a positional inverted index of the training
tokens. DataFrame functions only.

The index holds every token's posting (document, term, position) in Parquet
files in the shared folder. Test items are cut into windows of ten words (a
shorter item is one window). Of each window the terms are ordered by their number
of postings. A posting less the term's place in the item is an alignment of
document and item: those of the rarest term (the anchor) are intersected with
those of the second, and the few that are left with the postings of the window's
other terms. An exact phrase has all its terms at the anchor's alignment; in a
proximity match each may stand up to ``slop`` places off. The texts aren't read
again.

Cases: null or empty text: no word, no hit. Null doc_id or item_id: a null
document keeps its row; a null item hits but isn't listed or counted. Repeated
document rows: one result row each. Repeated items: counted once by id. Ties of
terms: the first in the item is the rarer. Empty tables: no rows, or no hits.
Columns other than doc_id, item_id and text are ignored, or handed on by clean().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import REST, ascii_lower, packed, stored, table, unpacked

WINDOW = 10
SLOP = 2
#: Rows that may be broadcast; more are joined by shuffles.
MAX_BROADCAST_TERMS = 1_000_000
#: Parts that the postings of one term are dealt to in such a join.
SALTS = 16
#: Places that meet in one bucket of the join by place.
PLACES = 16
DOC = ("__k1", "__k2")
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def tokens(text: Column) -> Column:
    """Lower-cased (A-Z) words of digits, letters and characters beyond ASCII."""
    text = F.coalesce(text, F.lit(""))
    # lower() is the same and faster, but for capitals beyond ASCII
    low = F.when(text.rlike("[\\p{Lu}\\p{Lt}\\p{Nl}\\p{So}&&[^A-Z]]"), ascii_lower(text)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, SEPARATORS, -1), "")


def keyed(docs: DataFrame) -> DataFrame:
    """Two hashes of the whole row stand for it, null doc_id included."""
    return docs.withColumns({"__k1": F.xxhash64(F.lit(1), "doc_id", "text"), "__k2": F.xxhash64(F.lit(2), "text", "doc_id")})


def build_index(docs: DataFrame) -> DataFrame:
    """Postings (__k1, __k2, term, pos) of all tokens, stored."""
    each = keyed(docs.select("doc_id", "text")).select(*DOC, F.posexplode(tokens(F.col("text"))).alias("pos", "term"))
    return stored(each, "postings", compression="zstd")


def items_of(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct word lists: iid, ids (sorted item ids as strings), w, n, len."""
    each = benchmark.select(F.col("item_id").cast("string").alias("id"), tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    found = each.groupBy("w").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return stored(found.select(F.xxhash64("w").alias("iid"), "ids", "w", F.size("w").alias("n"), F.least(F.lit(window), F.size("w")).alias("len")), "items")


def by_term(small: bool) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A join of postings with rows of terms, ``small`` ones by broadcast; else a
    term's postings are dealt to SALTS parts, each with the term's rows."""
    if small:
        return lambda postings, terms: postings.join(F.broadcast(terms), "term")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return lambda postings, terms: postings.withColumn("salt", F.pmod("pos", F.lit(SALTS)).cast("int")).join(terms.withColumn("salt", every), ["term", "salt"]).drop("salt")


def windows(postings: DataFrame, items: DataFrame, joined) -> DataFrame:
    """(iid, s, len, terms): the terms of each window as (df, p, term), rarest
    first. A window with a term that occurs nowhere can't match and is left out."""
    at = items.select("iid", "n", "len", F.posexplode("w").alias("p", "term"))
    counts = joined(postings.select("term", "pos"), at.select("term").distinct()).groupBy("term").agg(F.count("*").alias("df"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("p") - F.col("len") + 1), F.least(F.col("p"), F.col("n") - F.col("len")))
    known = at.join(counts, "term", "left").select("iid", "len", "p", "term", F.coalesce("df", F.lit(0)).alias("df"), F.explode(starts).alias("s"))
    found = known.groupBy("iid", "s", "len").agg(F.array_sort(F.collect_list(F.struct("df", "p", "term"))).alias("terms"))
    return stored(found.where(F.col("terms")[0]["df"] > 0), "windows")


def alignments(postings: DataFrame, found: DataFrame, slop: int, joined) -> DataFrame:
    """(__k1, __k2, a, diag): where a posting of an anchor has one of its window's
    second term within ``slop`` of its place; a: hash of (iid, anchor, second)."""
    term = lambda i: F.get("terms", F.least(F.lit(i), F.size("terms") - 1))
    pairs = found.select("iid", term(0).alias("x"), term(1).alias("y")).select(anchor_id(F.col("iid"), F.col("x.p"), F.col("y.p")).alias("a"), "x", "y").distinct()
    wanted = pairs.select("a", F.explode(F.array(F.struct(F.lit(1).alias("rank"), "x.p", "x.term"), F.struct(F.lit(2).alias("rank"), "y.p", "y.term"))).alias("t")).select("a", "t.*")
    hits = stored(joined(postings, wanted).select(*DOC, "a", "rank", (F.col("pos") - F.col("p")).alias("diag")), "hits")
    first = hits.where("rank = 1").select(*DOC, "a", "diag", *near_buckets(F.col("diag"), slop))
    second = hits.where("rank = 2").select(*DOC, "a", F.col("diag").alias("other"), bucket(F.col("diag")).alias("place"))
    near = first.join(second, [*DOC, "a", "place"]).where(F.abs(F.col("diag") - F.col("other")) <= slop)
    return near.select(*DOC, "a", "diag").distinct()


def anchor_id(iid: Column, first: Column, second: Column) -> Column:
    return F.xxhash64(iid, first, second)


def bucket(place: Column) -> Column:
    return F.floor(place / PLACES)


def near_buckets(place: Column, slop: int) -> list[Column]:
    """Each bucket within ``slop`` of a place, as place."""
    return [F.explode(F.sequence(bucket(place - slop), bucket(place + slop))).alias("place")]


def intersected(postings: DataFrame, found: DataFrame, seeds: DataFrame, slop: int, joined, max_broadcast: int) -> DataFrame:
    """(__k1, __k2, iid, diag, exact, near): the places in the item, sorted, whose
    terms stand where the alignment has them, or within ``slop`` of it."""
    a = anchor_id(F.col("iid"), F.col("terms")[0]["p"], F.get("terms", F.least(F.lit(1), F.size("terms") - 1))["p"])
    each = found.select("iid", a.alias("a"), F.explode("terms").alias("t"))
    around = each.groupBy("a", "iid").agg(F.collect_set(F.struct("t.p", "t.term")).alias("around"))  # within a window's length of the anchor
    seeds = stored(seeds.join(around.select("a", "iid", "around"), "a"), "alignments")
    want = seeds.select(*DOC, "iid", "diag", F.explode("around").alias("t")).select(*DOC, "iid", "diag", "t.p", "t.term").distinct()
    want = want.withColumn("at", F.col("diag") + F.col("p"))
    docs = seeds.select(*DOC).distinct()
    hint = F.broadcast if docs.count() <= max_broadcast else (lambda df: df)
    there = postings.join(hint(docs), list(DOC), "left_semi")
    there = joined(there, each.select("t.term").distinct()).select(*DOC, "term", "pos", bucket(F.col("pos")).alias("place"))
    met = want.select("*", *near_buckets(F.col("at"), slop)).join(there, [*DOC, "term", "place"]).where(F.abs(F.col("pos") - F.col("at")) <= slop)
    return met.groupBy(*DOC, "iid", "diag").agg(F.array_sort(F.collect_set(F.when(F.col("pos") == F.col("at"), F.col("p")))).alias("exact"), F.array_sort(F.collect_set("p")).alias("near"))


def runs(places: Column, length: Column) -> Column:
    """Starts of the windows whose places are all in the sorted ``places``."""
    at = F.when(F.size(places) >= length, F.sequence(F.lit(0), F.size(places) - length)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(at, lambda i: F.get(places, i + length - 1) - F.get(places, i) == length - 1), lambda i: F.get(places, i))


def matches(postings: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, slop: int = SLOP, max_broadcast: int = MAX_BROADCAST_TERMS) -> DataFrame:
    """(__k1, __k2, ids, near_ids, starts, len), stored: alignments of documents
    with items that match exactly (``ids``, null if not; starts of the windows in
    the document) or within ``slop`` of the anchor (``near_ids``)."""
    items = items_of(benchmark, window)
    joined = by_term(items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= max_broadcast)
    found = windows(postings, items, joined)
    seeds = alignments(postings, found, slop, joined)
    met = intersected(postings, found, seeds, slop, joined, max_broadcast)
    anchors = found.groupBy("iid", "len").agg(F.map_from_entries(F.collect_list(F.struct("s", F.col("terms")[0]["p"].alias("p")))).alias("anchors"))
    known = met.join(anchors, "iid").join(items.select("iid", "ids"), "iid")
    starts = runs(F.col("exact"), F.col("len"))
    near = F.exists(runs(F.col("near"), F.col("len")), lambda s: F.array_contains("exact", F.col("anchors")[s]))
    done = known.select(*DOC, "ids", "len", F.transform(starts, lambda s: s + F.col("diag")).alias("starts"), near.alias("near"))
    return stored(done.where((F.size("starts") > 0) | F.col("near")).select(*DOC, F.when(F.size("starts") > 0, F.col("ids")).alias("ids"), F.when(F.col("near"), F.col("ids")).alias("near_ids"), "starts", "len"), "matches")


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and n_near and
    near_sha256 of the items within ``slop``."""
    postings = build_index(docs)
    found = matches(postings, benchmark, **options)
    n_words = postings.groupBy(*DOC).agg((F.max("pos") + 1).cast("long").alias("n_words"))
    places = found.select(*DOC, "len", F.explode("starts").alias("s")).select(*DOC, F.explode(F.sequence(F.col("s"), F.col("s") + F.col("len") - 1)).alias("place")).distinct()
    n_hit = places.groupBy(*DOC).agg(F.count("*").alias("n_hit"))
    listed = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))  # noqa: E731  of benchmark items, not of documents
    items = found.groupBy(*DOC).agg(listed("ids").alias("ids"), listed("near_ids").alias("near_ids"))
    whole = keyed(docs.select("doc_id", "text")).select("doc_id", *DOC).join(n_words, list(DOC), "left").join(items, list(DOC), "left").join(n_hit, list(DOC), "left")
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    digest = lambda c: F.sha2(F.coalesce(F.array_join(c, ","), F.lit("")), 256)
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    return whole.select("doc_id", F.coalesce("n_words", F.lit(0).cast("long")).alias("n_words"), n.alias("n_hit"), F.when(F.col("ids").isNull(), 0).otherwise(count("ids")).cast("long").alias("n_items"), digest("ids").alias("items_sha256"), (n > 0).alias("contaminated"), F.when(F.col("near_ids").isNull(), 0).otherwise(count("near_ids")).cast("long").alias("n_near"), digest("near_ids").alias("near_sha256"))


def clean(docs: DataFrame, benchmark: DataFrame, *, max_broadcast: int = MAX_BROADCAST_TERMS, **options) -> DataFrame:
    """The documents without an exact match, all columns."""
    hit = stored(matches(build_index(docs), benchmark, max_broadcast=max_broadcast, **options).where(F.size("starts") > 0).select(*DOC).distinct(), "hit")
    hint = F.broadcast if hit.count() <= max_broadcast else (lambda df: df)
    return unpacked(keyed(packed(docs, "doc_id", "text")).join(hint(hit), list(DOC), "left_anti").select("doc_id", "text", REST), docs)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select row_number() over () as iid, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), bw as (
  select distinct item_id, least(10, len(w)) as k, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from b where len(w) > 0)
), dw as (
  select rid, p, k, array_to_string(w[p:p + k - 1], ' ') as win
  from (select rid, w, k, unnest(range(1, len(w) - k + 2)) as p from d, (select distinct k from bw))
), m as (
  select dw.rid, dw.p, dw.k, bw.item_id from dw join bw on dw.k = bw.k and dw.win = bw.win
), h as (
  select rid, count(distinct q) as n_hit from (select rid, unnest(range(p, p + k)) as q from m) group by rid
), i as (
  select rid, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct rid, cast(item_id as varchar) as id from m where item_id is not null) group by rid
), t as (
  select rid, unnest(w) as term, unnest(range(len(w))) as pos from d
), df as (
  select term, count(*) as df from t group by term
), bt as (
  select iid, item_id, least(10, len(w)) as k, len(w) as n, unnest(w) as term, unnest(range(len(w))) as p from b
), wt as (
  select iid, item_id, k, s, p, bt.term, df from (select *, unnest(range(greatest(0, p - k + 1), least(p, n - k) + 1)) as s from bt) bt left join df using (term)
), anchors as (
  select iid, item_id, k, s, arg_min(p, (df, p)) as p, arg_min(term, (df, p)) as term from wt group by all having count(df) = count(*)
), c as (
  select anchors.iid, anchors.item_id, k, s, t.rid, t.pos - anchors.p as diag from anchors join t using (term)
), n as (
  select distinct c.rid, c.item_id, c.iid, c.s, c.diag, c.k, wt.p
  from c join wt on c.iid = wt.iid and c.s = wt.s join t on t.rid = c.rid and t.term = wt.term and t.pos between c.diag + wt.p - 2 and c.diag + wt.p + 2
), near as (
  select rid, count(*) as n_near, string_agg(id, ',' order by id) as near_ids
  from (select distinct rid, cast(item_id as varchar) as id from (select rid, item_id, iid, s, diag, k from n group by all having count(*) = k) where item_id is not null) group by rid
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0) as n_near, sha256(coalesce(near_ids, '')) as near_sha256
from d left join h using (rid) left join i using (rid) left join near using (rid)
"""
