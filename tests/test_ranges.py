from pyspark.sql import Window
from pyspark.sql import functions as F

from cuewright.operators import ranges
from cuewright.operators import segments as S


def sequence(spark, n=400):
    rows = [(None if i % 5 == 0 else i % 2, i * 7919 % n, None if i % 3 else f"v{i}", i % 11) for i in range(n)]
    return spark.createDataFrame(rows, "k int, at long, v string, x long").repartition(3)


def rows_of(df, *columns):
    return sorted(map(repr, map(tuple, df.select(*columns).collect())))


def test_carries_equal_plain_windows(spark):
    plain = sequence(spark)
    for keys in (["k"], []):
        cut = ranges.cut(plain, keys, ["at"], parts=7)
        assert cut.select(ranges.RANGE).distinct().count() > 3
        w = Window.partitionBy(*keys).orderBy("at")
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        want = plain.withColumns({"b": F.lag("v").over(w), "a": F.lead("x").over(w), "s": F.sum("x").over(upto), "n": F.row_number().over(w) - 1, "c": F.last("v", ignorenulls=True).over(upto)})
        for rows in (cut, plain):
            got = ranges.beside(rows, keys, ["at"], {"b": F.col("v")}, {"a": F.col("x")})
            got = ranges.running(got, keys, ["at"], "s", F.col("x"))
            got = ranges.running(got, keys, ["at"], "n", F.lit(1), so_far=False)
            got = ranges.last_known(got, keys, ["at"], "c", F.col("v"))
            columns = ["k", "at", "b", "a", "s", "n", "c"]
            assert rows_of(got, *columns) == rows_of(want, *columns)


def test_a_long_video_in_many_ranges(spark):
    said = ["one two three", "one two threes", "nothing alike", "nothing alike!", ""]
    rows = [(v, t * 40, [said[t // 37 % 5]] if t % 41 else []) for v in (1, 2) for t in range(600)]
    rows += [(1, 40, ["tie"]), (1, 40, ["tie"]), (1, 40, ["a tie"])]
    events = S.with_end(spark.createDataFrame(rows, "video_id long, time_ms long, texts array<string>").repartition(5))
    wide = S.wide(events, 9)
    assert wide.where("video_id = 1").select(ranges.RANGE).distinct().count() > 3
    for of in (S.segments, lambda e: S.merge(S.segments(e), lines=False), lambda e: S.merge_twice(S.segments(e), lines=False), lambda e: S.cues(S.merge_twice(S.segments(e), lines=False))):
        found, want = of(wide), of(events)
        columns = [c for c in want.columns]
        assert rows_of(found, *columns) == rows_of(want, *columns)
    both = S.merge(S.segments(events), lines=True)
    assert rows_of(both, *both.columns) == rows_of(S.merge(S.segments(wide), lines=False), *both.columns)


def test_an_island_over_all_ranges_and_an_empty_table(spark):
    rows = [(1, t, ["same"]) for t in range(200)]
    events = spark.createDataFrame(rows, "video_id long, time_ms long, texts array<string>")
    found = S.merge(S.segments(S.wide(S.with_end(events, 10), 8)), lines=False).collect()
    assert [(r.start_ms, r.end_ms, r.texts) for r in found if r.texts] == [(0, 209, ["same"])]
    assert S.cues(S.merge_twice(S.segments(S.wide(events.limit(0), 3)), lines=False)).collect() == []


def test_equal_times_of_prefixes(spark):
    rows = [(1, 0, 10, ["abcdefghij"]), (1, 10, 20, ["abcdefghijk"])]
    segs = spark.createDataFrame(rows, S.SEGMENT)
    for lines in (True, False):
        assert [r.texts for r in S.merge(segs, lines=lines).collect()] == [["abcdefghij"]]


def test_lines_that_change_places_along_an_island(spark):
    import itertools
    import random

    rng = random.Random(7)
    words = [f"line number {w} of some length" for w in ("one", "two", "ten")]
    rows = []
    for v in range(6):
        order = list(range(3))
        for t in range(30):
            if t % 4 == 0:
                rng.shuffle(order)
            rows.append((v, t * 10, [words[k] + "!" * rng.randrange(2) for k in order] if t % 13 else ["alone"]))
    events = S.with_end(spark.createDataFrame(rows, "video_id long, time_ms long, texts array<string>"))

    def plain(v):
        own = sorted((t, x) for u, t, x in rows if u == v)
        segs = [(0, own[0][0], [])] + [(t, n, x) for (t, x), (n, _) in zip(own, own[1:] + [(own[-1][0] + 60_000, [])])]
        strip = lambda x: [s.replace(" ", "").replace("!", "") for s in x]
        runs = [[segs[0]]]
        for a, b in itertools.pairwise(segs):
            runs[-1].append(b) if S.alike(strip(a[2]), strip(b[2])) else runs.append([b])
        out = []
        for run in runs:
            said, places = [], list(range(len(run[0][2])))
            for before, (a, b, x) in zip([run[0], *run], run):
                step = S.match_lines(strip(before[2]), strip(x))
                places = [step[p] for p in places]
                said += [(k, x[p], b - a) for k, p in enumerate(places)]
            out.append((v, run[0][0], run[-1][1], S.voted(len(places), said)))
        return out

    want = sorted(r for v in range(6) for r in plain(v))
    for table in (events, S.wide(events, 5)):
        found = S.merge(S.segments(table)).collect()
        assert sorted((r.video_id, r.start_ms, r.end_ms, r.texts) for r in found) == want


def test_equal_matchings_take_the_first(spark):
    assert S.match_lines(["aa", "aa", "aa"], ["aa", "aa", "aa"]) == [0, 1, 2]
    assert S.match_lines(["ab", "cd"], ["xx", "xx"]) == [0, 1]
