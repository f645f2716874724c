import itertools
import random

import duckdb
import numpy as np
import pytest

from cuewright.llm import langid, warc
from cuewright.llm.common import shared_path


def test_keys_are_searched_as_they_are_sorted(spark):
    signs = [" ", "!", '"', "#", "$", "%", "\t", "\n", "~", "é", "😀", "0"]
    urls = [f"http://x.com/a{s}b" for s in signs] + [f"http://x.com/{s}" for s in signs] + ["http://x.com/a", "", "x.com", "http://X.com:80/a b?c d"]
    pages = spark.createDataFrame([(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    captures, directory = warc.archive(pages, shared_path(spark, "test keys"))
    places = sorted((r.key, r.file, r.offset, r.length) for r in directory.collect())
    for i, u in enumerate(urls):
        same = [j for j, x in enumerate(urls) if warc.url_key(x) == warc.url_key(u)]
        assert sorted(p.decode() for _, p in warc.lookup(places, u)) == sorted(f"<p>{j}</p>" for j in same)
    asked = spark.createDataFrame([(warc.url_key(u),) for u in urls[::3]] + [("none)/",)], "key string")
    wanted = {warc.url_key(u) for u in urls[::3]}
    assert sorted(r.page_id for r in warc.fetch(asked, directory).collect()) == [i for i, u in enumerate(urls) if warc.url_key(u) in wanted]


def test_lookup_through_many_blocks_and_a_frequent_key(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_BLOCKS", 2)
    made = random.Random(3)
    rows = [(i, "http://hot.org/" if i % 3 == 0 else f"http://h{made.randrange(9)}.org/{made.randrange(50)} x", f"<p>{i % 40}</p>") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    captures = warc.write_archives(pages, shared_path(spark, "blocks"), max_broadcast=0)
    directory = warc.write_index(captures, shared_path(spark, "blocks"), block_lines=7)
    assert directory.count() > 40
    first = {i % 40: i % 40 for i in range(400)}
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.fetch(captures.select("key"), directory).collect()}
    assert got == {i: ("response", None) if first[i % 40] == i else ("revisit", i % 40) for i in range(400)}
    places = sorted((r.key, r.file, r.offset, r.length) for r in directory.collect())
    for url in {u for _, u, _ in rows}:
        found = warc.lookup(places, url)
        assert len(found) == sum(u == url for _, u, _ in rows)
        for fields, payload in found:
            if fields["WARC-Type"] == "revisit":
                assert fields["WARC-Refers-To"] == warc.record_id(int(fields["X-Refers-To-Page-ID"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    assert sorted(r.page_id for r in warc.read_back(directory).collect()) == list(range(400))


def test_odd_pages_against_sql(spark):
    rows = [(None, None, None, 1), (1, None, "<p>é</p>", 2), (2, "http://x.org/ \n", "<p>é</p>", 3), (2, "http://x.org/ \n", "<p>é</p>", 3), (3, "", "", 4), (4, "no scheme", "y" * 3_000_000, 5), (5, "http://x.org", "y" * 3_000_000, 6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha long").selectExpr("*", "1 as first", "2 as key", "3 as salt")
    captures, directory = warc.archive(pages, shared_path(spark, "odd"))
    con = duckdb.connect()
    frame = pages.select("page_id", "html").toArrow()
    con.register("pages", frame)
    want = con.sql(f"select page_id, payload_bytes, payload_digest, case when page_id is null then 'revisit' else record_type end, case when page_id is null then 3 else refers_to end from ({warc.OP7_SQL})").fetchall()
    got = [tuple(r) for r in warc.fetch(captures.select("key"), directory).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_letters_are_letters(spark):
    assert langid.words_of("½ ² ① ৳৪ Ⅷ") == [] and langid.words_of("Ab1c_d é हिन्दी") == ["ab", "c", "d", "é", "हिन्दी"]
    model = langid.Model(["en", "es"], np.zeros((3, 2), "f4"), {"en": {"latin"}, "es": {"latin"}})
    df = spark.createDataFrame([(1, "½ ² ①"), (2, "a"), (None, "́ 12"), (4, None), (4, None), (5, "")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.lang_pred, r.score) for r in langid.predict(df.selectExpr("*", "1 as f", "'x' as lang_pred"), model).collect())
    assert got == [("1", "und", 0.0), ("2", "en", 1.0), ("4", "und", 0.0), ("4", "und", 0.0), ("5", "und", 0.0), ("None", "und", 0.0)]


def test_viterbi_against_all_paths():
    made = np.random.default_rng(4)
    cost = lambda path, s, p: sum(s[t, x] for t, x in enumerate(path)) - p * sum(a != b for a, b in zip(path, path[1:]))
    texts = [made.normal(0, 4, (n, 3)) for n in (1, 2, 5, 7, 7, 3)]
    labels = langid.viterbi(np.concatenate(texts), np.array(list(map(len, texts))), 2.5)
    at = 0
    for s in texts:
        best = max(cost(path, s, 2.5) for path in itertools.product(range(3), repeat=len(s)))
        own = labels[at : at + len(s)]
        at += len(s)
        assert cost(own, s, 2.5) == pytest.approx(best)
        for run in (1, 2, 3, 100):
            assert cost(langid.long_path(lambda lo, hi, s=s: s[lo:hi], len(s), run, 2.5), s, 2.5) == pytest.approx(best)


def test_long_texts_run_by_run():
    model = langid.Model(["de", "en"], np.random.default_rng(2).normal(-5, 2, (98, 2)).astype("f4"), {"de": {"latin"}, "en": {"latin"}})
    words = [f"{a}{b}{a}" for a in "abcdefgh" for b in "klmnop"]
    text = " ".join(random.Random(1).choices(words, k=3000))
    (_, _, whole), = langid.labelled(model, [text])
    (_, _, parts), = langid.labelled(model, [text], cells=500)
    assert (whole == parts).all() and len(set(whole.tolist())) == 2
