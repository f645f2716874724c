import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuewright.llm import mixing, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def trusted(spark):
    return {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1 and not r.toxic}


def test_quality_scores_and_verdicts(spark, rows, trusted):
    got = {r.doc_id: r for r in quality.op9_quality_rules(spark, SF).collect()}
    for r, (score, kept) in zip(rows, brute.quality_verdicts(rows, trusted), strict=True):
        assert got[r["doc_id"]].llr_score == pytest.approx(score, abs=1e-12) and got[r["doc_id"]].kept == kept


def test_words_repeated_beyond_a_million(spark):
    text = " ".join(f"w{i % 700_000}" for i in range(1_050_000)) + " x y z"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = quality.quality(df, df.select("doc_id")).select("__m.*").first()
    assert (got.n_words, got.n_repeat_words) == (1_050_003, 700_000)


def test_mixing_against_brute_force(spark, rows):
    got = {r.doc_id: r for r in mixing.op6_mixing(spark, SF).collect()}
    for r, want in zip(rows, brute.mixed(rows), strict=True):
        own = got[r["doc_id"]]
        assert (own.topic, own.n_tokens) == (want["topic"], want["n_tokens"])
        assert own.keep_prob == pytest.approx(want["keep_prob"], abs=1e-7) and own.weight == pytest.approx(want["weight"], abs=1e-4)
        if abs(own.keep_prob - want["keep_prob"]) < 1e-12 or 0 < want["keep_prob"] < 1:
            assert own.kept == want["kept"]


def test_weighted_tokens_meet_the_targets(spark):
    cells = [("a", "en", 60), ("a", "fr", 20), ("b", "en", 15), ("b", "fr", 5), (None, "en", 10), ("c", None, 4)]
    made = [(1000 * i + j, " ".join(["w"] * 10), lang, source) for i, (source, lang, n) in enumerate(cells) for j in range(n)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    targets = ({"a": 0.5, "b": 0.3, None: 0.1, "c": 0.1}, {"en": 0.6, "fr": 0.3, None: 0.1}, {"prose": 1.0})
    for cap in (mixing.MAX_CELLS, 0):
        got = mixing.mix(df, targets=targets, rate=0.5, max_cells=cap)
        assert got.first().residual < 1e-6
        for axis, name in enumerate(("source", "lang")):
            sums = {r[0]: r[1] for r in got.groupBy(name).agg(F.sum(F.col("n_tokens") * F.col("weight") * F.col("keep_prob"))).collect()}
            total = sum(sums.values())
            assert all(v / total == pytest.approx(targets[axis][x], abs=1e-6) for x, v in sums.items())
        kept = got.agg(F.sum(F.col("n_tokens") * F.col("keep_prob"))).first()[0]
        assert kept == pytest.approx(0.5 * sum(10 * n for *_, n in cells), rel=1e-6)


def test_targets_that_cannot_be_met_are_told(spark):
    df = spark.createDataFrame([(1, "w w", "en", "a"), (2, "w w", "fr", "b")], "doc_id long, text string, lang string, source string")
    got = mixing.mix(df, targets=({"a": 0.9, "b": 0.1}, {"en": 0.5, "fr": 0.5}, {"prose": 1.0})).collect()
    assert all(r.residual == pytest.approx(0.4) for r in got) and len(got) == 2


def test_run_against_brute_force(spark, rows, trusted, tmp_path):
    # documents with secrets beside the others: their words in reverse order
    key = "Vx6zB23pc1umDh2VjXqkzudSa9QwLkE0rTyUiOp7"
    long = [r for r in rows if len(r["text"].split()) > 150][:12]
    more = [r | {"doc_id": 10_000 + i, "text": f"{' '.join(reversed(r['text'].split()))} é token=abcdefgh{i} {key[i:]}{key[:i]} end"} for i, r in enumerate(long)]
    rows = [dict(r) for r in [*rows, *more]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [r for r, (_, good) in zip(rows, brute.quality_verdicts(rows, trusted), strict=True) if good]
    kept = brute.without_benchmark(brute.first_of_classes(kept), items)
    for r, spans in zip(kept, brute.all_secrets([r["text"] or "" for r in kept]), strict=True):
        if spans:
            r |= {"text": brute.masked(r["text"], spans)}
            r["n_chars"] = len(r["text"])
    want = [r | m for r, m in zip(kept, brute.mixed(kept), strict=True)]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sum("[SECRET]" in r["text"] for r in want) > 3 and 0 < len(got) < len(kept) < len(rows)
    assert set(got) == {r["doc_id"] for r in want if r["kept"]}
    for r in want:
        if r["kept"]:
            own = got[r["doc_id"]]
            assert all(own[c] == r[c] for c in ("text", "lang", "source", "n_chars", "topic", "n_tokens"))
            assert own.keep_prob == pytest.approx(r["keep_prob"], abs=1e-7)


def test_run_on_odd_and_empty_documents(spark, tmp_path):
    base = "this is a sentence of plain words that say little but fill the text number"
    long = " ".join(f"{base} {i}" for i in range(20_000))
    text = lambda k: " ".join(f"{base} {k} {i}" for i in range(8))
    made = [(1, None, None, None, None), (None, text("x"), "en", "a", 3), (2, "", "en", None, 0), (4, long, "en", "a", len(long))]
    made += [(5, text("y"), "en", "a", 1), (5, text("y"), "en", "a", 1), (6, text("y"), "fr", "b", 1), (7, text("z"), None, None, None)]
    for name, some in (("odd", made), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(5, 1, None), (None, 1, 0), (4, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "never seen words")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = [r.doc_id for r in corpus_pipeline.run(spark, folder).collect()]
        # short texts and the one that repeats itself go, of the three equal ones one stays
        assert len(got) == len(set(got)) and set(got) <= {None, 4, 5, 7} and (name == "odd" or not got)


#: Names that the stages use themselves.
TAKEN = ["key", "did", "rep", "head", "kept_", "__t", "__base", "__cand", "__all", "__spans", "__k1", "__k2", "__m", "__u", "__a", "__b", "__c", "__w", "__rest", "term", "text_", "a.b", "residual_"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_hand_on_columns_of_any_name(spark, tmp_path, name, stage):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in TAKEN})
    plain, found = (stage(spark, x, "/root/testdata/sf0.001") for x in (docs, more))
    rows = found.collect()
    assert rows and [c for c in found.columns if c not in plain.columns] == TAKEN
    assert all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in TAKEN)
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in plain.collect())
