import base64
import hashlib
import math
import os
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuewright.llm import bpe, compact, whiten

SF = "/root/testdata/sf0.001"
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


# compaction


def first_fit(sizes, most):
    groups = []
    for i, n in enumerate(sizes):
        at = next((g for g in groups if g[0] + n <= most), None)
        if at is None:
            groups.append(at := [0, []])
        at[0] += n
        at[1].append(i)
    return [g[1] for g in groups]


@settings(deadline=None)
@given(st.lists(st.integers(1, 30), max_size=200), st.integers(30, 60))
def test_staircase_is_first_fit(sizes, most):
    packing = compact.Packing(most)
    for i, n in enumerate(sizes):
        packing.put(i, n)
    assert packing.groups == first_fit(sizes, most)
    assert packing.steps == list(np.maximum.accumulate(packing.room)) if sizes else packing.steps == []


def plain_compaction(rows):
    size = lambda parts: 1 + len(rows) // parts
    days = defaultdict(list)
    for r in rows:
        days[None if r[2] is None else (r[2] - datetime(1970, 1, 1)) // timedelta(days=1)].append(r)
    out = []
    for day, own in days.items():
        files = defaultdict(list)
        for r in own:
            h = zlib.crc32(("" if r[0] is None else str(r[0])).encode())
            files[h // 16 % (1 + len(own) // size(150)), min(h % 4, h // 4 % 4)].append(r)
        order = sorted(files, key=lambda k: (-len(files[k]), k))
        small = [k for k in order if len(files[k]) < size(600)]
        groups = [[small[i] for i in g] for g in first_fit([len(files[k]) for k in small], size(500))]
        for keys in groups + [[k] for k in order if k not in small]:
            least = datetime(1, 1, 1)
            held = [r for k in keys for r in sorted(files[k], key=lambda r: (r[2] or least, -1 if r[0] is None else r[0]))]
            ids = [r[0] for r in held]
            real = [x for x in ids if x is not None] or [None]
            cents = sum(math.floor(100 * r[5] + 0.5) for r in held if r[5] is not None and math.isfinite(r[5]))
            text = ",".join("" if x is None else str(x) for x in ids)
            out.append((day, *keys[0], len(ids), min(real), max(real), cents, ",".join(f"{a}-{b}" for a, b in keys), hashlib.sha256(text.encode()).hexdigest(), len(keys) > 1))
    return sorted(out, key=repr)


def held(found):
    return sorted([(r.day, r.lot, r.piece, r.n_rows, r.min_click_id, r.max_click_id, r.cents, r.sources, r.ids_sha256, r.rewritten) for r in found], key=repr)


def under(path):
    return [os.path.join(a, x) for a, _, names in os.walk(path) for x in names if x.endswith(".parquet")]


def test_compaction_of_clicks(spark):
    found = compact.op11_compaction(spark, SF).collect()
    rows = duckdb.sql(f"select * from '{SF}/clicks.parquet'").fetchall()
    assert held(found) == plain_compaction(rows)
    assert {r.columns for r in found} == {"click_id,ts,arrived_at,client_id,kind,value,props"}
    plain = lambda p: "/" + p.removeprefix("file:").lstrip("/")
    assert sorted(under(plain(found[0].path).split("/day=")[0])) == sorted(plain(r.path) for r in found)
    files = [plain(r.path) for r in found]
    assert sorted(map(repr, rows)) == sorted(map(repr, duckdb.sql(f"select click_id, ts, arrived_at, client_id, kind, value, props from read_parquet({files}, hive_partitioning=false)").fetchall()))


def test_files_that_stay_are_untouched(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(i, t, t + timedelta(hours=i % 60), 1, "k", 1.0, "{}") for i in range(3000)]
    files, total = compact.write_lots(spark.createDataFrame(rows, CLICKS).repartition(3), f"file://{tmp_path}/x", "arrived_at", "click_id")
    before = {p: open(p, "rb").read() for p in under(tmp_path)}
    final = compact.compacted(compact.stored(compact.planned(files, total, small=20), "plan")).collect()
    kept = [r.path for r in final if not r.rewritten]
    assert kept and len(kept) < len(final)
    for path in kept:
        assert before[path.removeprefix("file://").removeprefix("file:")] == open(path.removeprefix("file://").removeprefix("file:"), "rb").read()


def test_compaction_of_odd_rows(spark, tmp_path):
    t = datetime(2024, 1, 1, 5)
    rows = [(None, None, None, None, None, None, None), (1, t, None, 1, "", float("nan"), ""), (None, t, t, 1, "x", 2.345, "{}"), (7, t, t, 1, "x", float("inf"), "{}"), (7, t, t, 1, "x", -1.005, "{}"), (7, t, t, 1, "x", -1.005, "{}"), (8, t, datetime(1960, 5, 5, 3), 1, "x" * 100_000, 0.5, "é")]
    df = spark.createDataFrame(rows, CLICKS).withColumns({"day": F.lit("own"), "lot": F.lit(5), "Piece": F.lit(None).cast("int")})
    files, total = compact.write_lots(df, f"file://{tmp_path}/x", "arrived_at", "click_id")
    found = compact.described(compact.compacted(compact.stored(compact.planned(files, total), "plan")), "click_id", "value").collect()
    assert held(found) == plain_compaction(rows)
    assert {r.columns for r in found} == {"click_id,ts,arrived_at,client_id,kind,value,props,day,lot,Piece"}
    files, total = compact.write_lots(spark.createDataFrame([], CLICKS), f"file://{tmp_path}/y", "arrived_at", "click_id")
    assert total == 0 and compact.described(compact.compacted(compact.stored(compact.planned(files, total), "plan")), "click_id", "value").collect() == []


def test_joining_again_gives_the_same_file(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/a")
    spark.range(5, 9).write.parquet(f"{tmp_path}/b")
    paths = [f"file://{p}" for x in "ab" for p in sorted(under(tmp_path / x))]
    first = compact.joined(paths)
    data = open(first.removeprefix("file://"), "rb").read()
    assert compact.joined(paths) == first and open(first.removeprefix("file://"), "rb").read() == data
    assert sorted(pq.read_table(first.removeprefix("file://"))["id"].to_pylist()) == list(range(9))
    open(tmp_path / "a" / ".left.joined-x.parquet", "w").close()
    compact.removed(paths)
    compact.removed(paths)
    assert sorted(under(tmp_path / "a")) == [first.removeprefix("file://")]


# tokens


@pytest.fixture(scope="module")
def own():
    return bpe.Tokenizer(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), bpe.classes())


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


ODD = "aab  \t\n\r'''srtevlmd　é1२!?.-😀\x85\x1c\x00中Ᲊ "


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text(st.one_of(st.sampled_from(ODD), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_tokens_are_the_librarys(own, library, texts):
    ids, ends, bounds = own.encode(texts)
    for i, x in enumerate(texts):
        found = ids[bounds[i] : bounds[i + 1]].tolist()
        assert found == library.encode_ordinary(x)
        assert own.decode(found) == x.encode()
        spans = [0, *ends[bounds[i] : bounds[i + 1]].tolist()]
        assert [x.encode()[a:b] for a, b in zip(spans, spans[1:])] == [own.tokens[k] for k in found]


def test_classes_of_all_code_points(own, library):
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    rng = random.Random(5)
    for text in ("".join(every), "a".join(every[:0x3100]), "'".join(every[:0x3100]), " ".join(rng.sample(every, 20_000))):
        assert own.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_long_pieces(own, library):
    for text in ("a" * 50_000, "ab'" * 20_000, " " * 40_000 + "x", "\n" * 30_001, "qzj" * 40):
        assert own.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_scan_equals_steps(own):
    rng = np.random.default_rng(1)
    for n in (1, 127, 128, 129, 5000):
        found, state, want = rng.integers(1, 10, n).astype(np.uint8), bpe.FRESH, []
        for k in found:
            state, begins = bpe.step(state, int(k))
            want.append(begins)
        assert bpe.starts(found).tolist() == want


def test_bpe_of_documents(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        want[doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in bpe.op12_byte_bpe(spark, SF).collect()} == want


def test_bpe_of_odd_rows(spark, library):
    odd = [(1, None), (None, "some words"), (2, ""), (2, ""), (3, "<|endoftext|> x" + "y " * 200_000), (4, "ends"), (5, "naïve 日本")]
    df = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"key": F.lit("k"), "ids": F.lit(3), "ends": F.lit("e")})
    vocabulary = bpe.shared(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = bpe.encode(df, vocabulary).withColumn("back", bpe.decode(F.col("ids"), vocabulary)).collect()
    assert sorted(((r.doc_id, bytes(r.back).decode()) for r in found), key=repr) == sorted(((k, x or "") for k, x in odd), key=repr)
    assert all(r.ids == library.encode_ordinary(bytes(r.back).decode()) and len(r.ends) == len(r.ids) for r in found)
    assert bpe.encode(df.limit(0), vocabulary).collect() == []


def test_vocabulary_is_the_files(own):
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken")).read().split()
    assert own.ranks == {base64.b64decode(a): int(b) for a, b in zip(lines[::2], lines[1::2])}


# vectors


def plain_whitening(vectors, most=32):
    x = np.floor(np.array(vectors, np.float64) * 64).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x], centred @ u / np.sqrt(e), e / (centred**2).sum() * n


def test_whitening_of_embeddings(spark):
    found = whiten.op13_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet' order by 1").fetchall()
    deviations, want, explained = plain_whitening([v for _, v in rows])
    got = found["whitened"].to_numpy().reshape(len(rows), -1)
    assert np.abs(got - want * np.sign((got * want).sum(0))).max() < 1e-6
    assert found["deviation"].tolist() == np.repeat(deviations, 32).tolist()
    assert np.allclose(found["explained"].to_numpy()[:32], explained, rtol=1e-9)
    assert found["identity_error"].max() < 1e-9 and set(found["n"]) == {len(rows)}


def test_merged_nodes_lose_nothing():
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(300, 7)) * 50 + 10 ** np.arange(7)).astype(np.int64)
    cuts = [0, 1, 3, 100, 250, 300]
    nodes = [whiten.leaf(x[a:b]) for a, b in zip(cuts, cuts[1:])]
    left = whiten.united(whiten.united(nodes[0], nodes[1]), whiten.united(nodes[2], whiten.united(nodes[3], nodes[4])))
    centred = x - x.mean(0)
    rows = left.s[:, None] * left.v
    assert np.allclose(rows.T @ rows, centred.T @ centred, rtol=1e-9, atol=1e-6) and left.sums.tolist() == x.sum(0).tolist() and left.n == 300


def test_whitening_of_odd_vectors(spark):
    good = [[0.1, 0.9, -0.5], [0.3, 0.1, 0.2], [0.3, 0.1, 0.2], [-0.7, 0.4, 0.6], [0.0, 0.0, 1.5]]
    bad = [None, [], [0.1, None, 0.2], [float("nan"), 0.1, 0.2], [float("inf"), 0.1, 0.2], [0.1, 0.2]]
    rows = [(None if i == 1 else i % 3, v) for i, v in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"key": F.lit(1), "x": F.lit("x"), "c": F.lit(None).cast("int")}).repartition(4)
    used = whiten.usable(df, "vec_id", "embedding").cache()
    by = whiten.fitted(used)
    made = whiten.whitened(used, by)
    deviations, want, _ = plain_whitening(good, 3)
    got = made.collect()
    assert sorted(r.deviation for r in got) == sorted(deviations) and len(got) == len(good)
    assert sorted(round(abs(x), 6) for r in got for x in r.whitened) == sorted(round(abs(float(x)), 6) for x in want.ravel())
    assert whiten.identity_error(made, by) < 1e-9
    used.unpersist()


def test_whitening_without_variance(spark):
    for rows in ([(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.25, 0.25])]):
        used = whiten.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
        by = whiten.fitted(used)
        made = whiten.whitened(used, by)
        assert all(math.isfinite(x) for r in made.collect() for x in r.whitened) and whiten.identity_error(made, by) < 1e-9
    none = whiten.usable(spark.createDataFrame([], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert whiten.fitted(none) is None


def test_deviations_beyond_a_long_are_told():
    by = whiten.Whitening(1 << 40, np.array([1 << 60]), np.ones((1, 1)), np.ones(1), np.ones(1))
    assert by.deviations(np.array([[(1 << 20) + 9]])) == [(((1 << 40) * ((1 << 20) + 9)) - (1 << 60)) ** 2]
