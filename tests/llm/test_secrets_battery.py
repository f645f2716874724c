import math
import random
import time

import pytest
from brute import all_secrets, battery

from cuewright.llm import secrets

B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def some_texts():
    made = random.Random(5)
    key = lambda letters, n: "".join(made.choice(letters) for _ in range(n))
    texts = [f"see {key(B64[:62], n)} and {key('0123456789ABCDEF', 24)}" for n in (20, 33, 64, 200)]
    texts += [f"at /a/{key(B64, 5000)}/x", "path/To/Some/LongerPlace0/ofFiles", f"{key(B64[:62], 40)}=={key('0123456789abcdef', 40)} token={key(B64, 50)}"]
    texts += ["abcABC" * 10, "A1" * 300, None, ""]
    return texts + [f"word{i} InternationalConferenceOnLearning{i} {key(B64[:62], 24 + i)}" for i in range(30)]


def test_battery_against_its_definition(spark):
    df = spark.createDataFrame(list(enumerate(some_texts())), "doc_id long, text string")
    seen = 0
    for r in secrets.scanned(df).collect():
        for c in r["__cand"] or ():
            p_random, p_text, n, enc = battery(c.token)
            assert c.p.n == n and c.p.enc == enc and c.p.p_random == pytest.approx(p_random, rel=1e-3, abs=1e-6) and c.p.p_text == pytest.approx(p_text, rel=1e-3, abs=1e-6)
            seen += 1
    assert seen > 60


def test_false_discovery_control_against_sorted_p_values(spark):
    df = spark.createDataFrame(list(enumerate(some_texts())), "doc_id long, text string")
    rows = secrets.scanned(df).collect()
    # p-values rounded up to the lower edges of their bins, as the procedure states
    edge = lambda p: math.exp(-math.floor(-math.log(p) * secrets.BINS) / secrets.BINS)
    by: dict = {}
    for r in rows:
        for c in r["__cand"] or ():
            by.setdefault((c.p.enc, min(int(math.log2(c.p.n)), 12)), []).append(edge(c.p.p_text))
    limit = {}
    for cls, ps in by.items():
        ps.sort()
        limit[cls] = max([p for i, p in enumerate(ps) if p <= secrets.FDR * sum(q <= p for q in ps) / len(ps)], default=-1.0)
    got = {r.doc_id: r["__spans"] for r in secrets.found(df).collect()}
    for r in rows:
        cands = [c for c in r["__cand"] or () if c.p.p_random >= secrets.ALPHA and edge(c.p.p_text) <= limit[c.p.enc, min(int(math.log2(c.p.n)), 12)]]
        want = {(c.start, c.end) for c in cands if not any(x.start <= c.start and c.end <= x.end and x.end - x.start > c.end - c.start for x in cands)}
        assert {(s.start, s.end) for s in got[r.doc_id] if s.kind == 3} == want


def test_runs_of_one_case_and_of_digits(spark):
    made = random.Random(11)
    key = lambda letters, n: "".join(made.choice(letters) for _ in range(n))
    # by the normal law and the share of prose in this family, 0.75 of 40 upper-case letters are found, 0.96 of 64, and no 24 digits
    kinds = {"low40": (B64[26:52], 40), "up40": (B64[:26], 40), "low64": (B64[26:52], 64), "up64": (B64[:26], 64), "digits": (B64[52:62], 24)}
    texts = [(f"{name} {i}", f"see {key(*kind)} there") for name, kind in kinds.items() for i in range(20)]
    prose = "internationalisation donaudampfschiffahrtsgesellschaft antidisestablishmentarianism electroencefalografistas thequickbrownfoxjumpsoverthelazydogagain someverylongparametername_of_the_function path/to/some/place/in/the/tree well-known-and-often-used-phrase INTERNATIONALCONFERENCEONMACHINELEARNING MAX_NUMBER_OF_RETRIES_ALLOWED InternationalConferenceOnLearning".split()
    texts += [("prose", f"a {x} b {x.upper()}") for x in prose for _ in range(20)]
    texts += [("number", f"pi {'0' * 20} {'2024' * 6} {'1000000' * 4}")]
    df = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(texts)], "doc_id long, name string, text string")
    got = {r.doc_id: [s for s in r["__spans"] if s.kind == 3] for r in secrets.found(df).collect()}
    want = all_secrets([t for _, t in texts])
    assert all([(s.start, s.kind, s.end) for s in got[i]] == [x for x in w if x[1] == 3] for i, w in enumerate(want))
    hits = {name: sum(bool(got[i]) for i, (x, _) in enumerate(texts) if x.split()[0] == name) for name in [*kinds, "prose", "number"]}
    assert hits["prose"] == hits["number"] == 0 and min(hits["low40"], hits["up40"]) >= 12 and min(hits["low64"], hits["up64"]) >= 18, hits
    # the family counts the prose: 240 runs of upper-case letters, 140 of lower-case ones and more
    counted = sum(c.p is not None for r in secrets.scanned(df).collect() for c in r["__cand"] or ())
    assert counted > 500


def test_long_runs_and_many_spans_take_linear_time(spark):
    made = random.Random(6)
    run = "".join(made.choices(B64, k=1_000_000))
    many = "".join(f"é token=abcdefgh{i % 10} " for i in range(20_000))
    df = spark.createDataFrame([(1, "x " + run, 1), (2, many, 1)], "doc_id long, text string, n_chars long")
    start = time.time()
    got = {r.doc_id: r for r in secrets.digests(secrets.found(df)).collect()}
    assert got[1].n_random == 1 and got[1].spans == "random:2:1000002" and got[2].n_assign == 20_000
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert clean[1] == "x [SECRET]" and clean[2] == "é [SECRET] " * 20_000
    assert time.time() - start < 120


def test_spans_beside_and_within_known_ones(spark):
    key = "Vx6zB23pc1umDh2VjXqkzudSa9QwLkE0rTyUiOp7"
    texts = [f"token={key} {key}", f"{key} secret: {key}-x/{key}", f"AKIA{'A1B2' * 5}/{key}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = {r.doc_id: r for r in secrets.scanned(df).collect()}
    for r in known.values():
        assert all(not (b.start < c.end and c.start < b.end) for b in r["__base"] for c in r["__cand"] or ())
    free = {i: sorted((c.start, c.end) for c in r["__cand"] or ()) for i, r in known.items()}
    assert free[0] == [(47, 87)] and (0, 40) in free[1]
    clean = [r.text for r in secrets.redact(df).orderBy("doc_id").collect()]
    assert not any(key in t for t in clean)
