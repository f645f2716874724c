"""Secret scans: known shapes of credentials, and a randomness test battery.
DataFrame functions only.

Known shapes are the kinds assign, access and hex. Beside them, each maximal run
of 20 or more characters of an encoding's alphabet is a candidate, so that a key
in a path is judged alone and with what stands before it; its encoding is the
least that has it (digits, hex, letters of one case, base 32, 36, 62, 64, 64 for
urls), and three tests of uniformly random symbols are taken of it: chi-squared
over the alphabet, runs about the alphabet's middle, and lag-1 serial correlation,
combined by Fisher's method (``p_random``). ``p_text`` is the chance that a
text-like string of that length and alphabet looks as uniform: has as few equal
pairs of symbols or, of letters of one case, as few of the COMMON letters. A
candidate is a secret if randomness isn't rejected and its ``p_text`` passes the
Benjamini-Hochberg procedure over all candidates of its encoding and length class
(powers of two) in the whole table, prose among them; the procedure works on counts
of p-values in fixed bins, rounded up. So short runs of a small alphabet, as 20
digits, are judged but hardly ever told from text.

Cases: null or empty text: no spans, counts 0. Null doc_id: kept. Repeated rows:
one result row each. Empty table: empty result. Spans of different kinds may
overlap; spans of kind random that touch a known shape aren't listed again, nor
those within a longer one, while those of two encodings may overlap in part.
Columns other than doc_id and text are ignored, or handed on by redact().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, packed, stored, table, unpacked

ASSIGN = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
#: What holds the candidates: runs of the symbols of all encodings.
HOLDER = "[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
#: encoding's pattern and alphabet, in the order they are tried.
ENCODINGS = (
    ("^[0-9]+$", "0123456789"),
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("^[0-9A-Za-z+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("^[0-9A-Za-z_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Candidates of each encoding.
CANDIDATES = tuple(pattern.removeprefix("^").removesuffix("+$") + "{20,}={0,2}" for pattern, _ in ENCODINGS)
#: Chance that two symbols of a text-like string are equal; of hex digits; of digits.
TEXT_REPEAT, HEX_REPEAT, DIGIT_REPEAT = 0.065, 0.12, 0.16
#: The most common letters of European languages.
COMMON = "aeilnorstu"
#: Their least share of a text in letters, and how much more it varies than by chance, as neighbours depend on each other.
COMMON_SHARE, COMMON_SPREAD = 0.7, 1.3
FDR = 0.01
ALPHA = 0.001
#: Bins of p_text a factor of e.
BINS = 20
MASK = "[SECRET]"
SPAN = "struct<start:long,kind:int,end:long,token:string>"
#: Code points of a text, and items of an array, that are handled at once.
BLOCK, WALK = 4096, 512


def blocks(text: Column) -> Column:
    """The text in pieces of BLOCK code points."""
    return F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))


def walk(items: Column, state: Column, kind: str, step) -> Column:
    """What one pass over an array emits: ``step(state, item)`` is the new state
    and an array of a ``kind`` each. Outputs are gathered by blocks, so that the
    time is in proportion to the items."""
    none = F.array().cast(f"array<{kind}>")

    def one(part: Column, state: Column) -> Column:
        def put(a: Column, x: Column) -> Column:
            new, out = step(a["s"], x)
            return F.struct(new.alias("s"), F.concat(a["out"], out).alias("out"))

        return F.aggregate(part, F.struct(state.alias("s"), none.alias("out")), put)

    def many(items: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / WALK).cast("int")), lambda i: F.slice(items, i * WALK + 1, WALK))
        put = lambda a, part: let(one(part, a["s"]), lambda r: F.struct(r["s"].alias("s"), F.array_append(a["out"], r["out"]).alias("out")))
        return F.aggregate(parts, F.struct(state.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out")), put, lambda a: F.flatten(a["out"]))

    return let(items, lambda items: F.when(F.size(items) <= WALK, one(items, state)["out"]).otherwise(many(items)))


def _spans(text: Column, pattern: str, kind: int, keep, shape) -> Column:
    """Spans of the leftmost non-overlapping matches that ``keep`` holds of.
    What stands between matches gives their places in code points."""
    n = F.size(shape)
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, n), shape, lambda gap, hit: F.struct(F.length(gap).cast("long").alias("gap"), hit.alias("hit")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("token"))
        return end, F.when(keep(x["hit"]), F.array(span)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return walk(pairs, F.lit(0).cast("long"), SPAN, step)


def spans_of(text: Column, pattern: str, kind: int, keep=lambda hit: F.lit(True)) -> Column:
    none = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(pattern), _spans(text, pattern, kind, keep, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).otherwise(none)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal law, by a rational approximation (error < 1e-7)."""
    poly = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    q = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * let(1 / (1 + 0.2316419 * F.abs(z)), poly)
    return let(q, lambda q: F.greatest(F.lit(1e-15), F.when(z < 0, 1 - q).otherwise(q)))


def battery(token: Column) -> Column:
    """Struct of p_random, p_text, n and number of encoding of one candidate, in time linear in its
    length: sums of one pass, and a count for each symbol of the alphabet."""

    def of(base: Column, enc: Column) -> Column:
        alphabet = F.get(F.array(*[F.lit(a) for _, a in ENCODINGS]), enc)
        return let(F.struct(base.alias("t"), enc.alias("enc"), alphabet.alias("a"), F.length(base).cast("double").alias("n"), F.length(alphabet).cast("double").alias("k")), counted)

    def symbols(text: Column) -> Column:
        return F.filter(F.split(text, ""), lambda c: c != "")

    def counted(s: Column) -> Column:
        n, k, zero = s["n"], s["k"], F.lit(0.0)
        each = F.when(n > 4 * k, symbols(s["a"])).otherwise(F.array_distinct(symbols(s["t"])))
        square = F.aggregate(each, zero, lambda a, c: let(n - F.length(F.replace(s["t"], c, F.lit(""))), lambda m: a + m * m))
        # numbers of symbols from 0: last, sum, sum of squares and of products of neighbours, how many in the upper half, runs
        start = F.struct(F.lit(-1.0).alias("last"), *[zero.alias(c) for c in ("x", "xx", "xy", "up", "runs")])

        def step(a: Column, x: Column) -> Column:
            up = F.when(x * 2 >= k, 1.0).otherwise(0.0)
            new = (a["last"] < 0) | ((a["last"] * 2 >= k) != (x * 2 >= k))
            near = F.when(a["last"] < 0, zero).otherwise(a["last"] * x)
            return F.struct(x.alias("last"), (a["x"] + x).alias("x"), (a["xx"] + x * x).alias("xx"), (a["xy"] + near).alias("xy"), (a["up"] + up).alias("up"), (a["runs"] + F.when(new, 1.0).otherwise(0.0)).alias("runs"))

        numbers = lambda block: F.transform(symbols(block), lambda c: (F.instr(s["a"], c) - 1).cast("double"))
        sums = F.aggregate(blocks(s["t"]), start, lambda a, block: F.aggregate(numbers(block), a, step))
        first = (F.instr(s["a"], F.substring(s["t"], 1, 1)) - 1).cast("double")
        common = n - F.length(F.translate(s["t"], COMMON + COMMON.upper(), ""))
        return let(F.struct(n.alias("n"), k.alias("k"), (square * k / n - n).alias("chi"), first.alias("first"), common.alias("common"), s["enc"].alias("enc"), sums.alias("s")), tested)

    def tested(s: Column) -> Column:
        n, k, df, sums = s["n"], s["k"], s["k"] - 1, s["s"]
        mean = sums["x"] / n
        z1 = (F.pow(F.greatest(s["chi"], F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        mu = 2 * sums["up"] * (n - sums["up"]) / n + 1
        z2 = let(mu, lambda m: let((m - 1) * (m - 2) / (n - 1), lambda v: F.when(v > 0, (sums["runs"] - m) / F.sqrt(F.greatest(v, F.lit(1e-9)))).otherwise(9.0)))
        spread = sums["xx"] - n * mean * mean
        along = sums["xy"] - mean * (2 * sums["x"] - s["first"] - sums["last"]) + (n - 1) * mean * mean
        z3 = let(spread, lambda v: F.when(v > 1e-6, (along / F.greatest(v, F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(9.0))
        excess = F.when(k == 10, 10 * DIGIT_REPEAT - 1).when(k == 16, 16 * HEX_REPEAT - 1).otherwise(k * TEXT_REPEAT - 1)
        equal = let(excess, lambda e: (df + (n - 1) * e - s["chi"]) / F.sqrt(2 * df + 4 * n * e))
        z4 = F.when(k == 26, (n * COMMON_SHARE - s["common"] - 0.5) / F.sqrt(n * (COMMON_SHARE * (1 - COMMON_SHARE) * COMMON_SPREAD))).otherwise(equal)
        # upper tails of: chi-squared, both sides of runs, both sides of correlation, text
        tails = F.transform(F.array(z1, F.abs(z2), F.abs(z3), z4), upper_tail)
        logs = lambda q: F.log(F.get(q, F.lit(0))) + F.log(F.least(F.lit(1.0), 2 * F.get(q, F.lit(1)))) + F.log(F.least(F.lit(1.0), 2 * F.get(q, F.lit(2))))
        fisher = lambda half: F.exp(-half) * (1 + half + half * half / 2)
        return let(tails, lambda q: F.struct(let(-logs(q), fisher).alias("p_random"), F.get(q, F.lit(3)).alias("p_text"), n.cast("int").alias("n"), s["enc"].alias("enc")))

    def chosen(base: Column) -> Column:
        enc = F.when(base.rlike(ENCODINGS[0][0]), F.lit(0))
        for i, (pattern, _) in enumerate(ENCODINGS[1:], 1):
            enc = enc.when(base.rlike(pattern), F.lit(i))
        return let(enc, lambda e: F.when(e.isNotNull(), of(base, e)))

    return let(F.regexp_replace(token, "=+$", ""), chosen)


def candidates(text: Column) -> Column:
    """Spans of the maximal runs of each encoding's alphabet, each once."""

    def inner(run: Column) -> Column:
        found = F.array_distinct(F.concat(*[spans_of(run["token"], pattern, 3) for pattern in CANDIDATES]))
        return F.transform(found, lambda c: F.struct((run["start"] + c["start"]).alias("start"), c["kind"].alias("kind"), (run["start"] + c["end"]).alias("end"), c["token"].alias("token")))

    return F.flatten(F.transform(spans_of(text, HOLDER, 3), inner))


def free_of(base: Column, spans: Column) -> Column:
    """``spans`` that overlap none of ``base`` (kinds below 3): a pass from the
    left against the furthest end, one from the right against the nearest start."""
    none = F.array().cast(f"array<{SPAN}>")

    def left(end: Column, x: Column) -> tuple[Column, Column]:
        known = x["kind"] < 3
        return F.when(known, F.greatest(end, x["end"])).otherwise(end), F.when(known | (x["start"] >= end), F.array(x)).otherwise(none)

    def right(start: Column, x: Column) -> tuple[Column, Column]:
        known = x["kind"] < 3
        return F.when(known, x["start"]).otherwise(start), F.when(~known & (x["end"] <= start), F.array(x)).otherwise(none)

    ahead = walk(F.sort_array(F.concat(base, spans)), F.lit(0).cast("long"), SPAN, left)
    return F.when((F.size(base) == 0) | (F.size(spans) == 0), spans).otherwise(walk(F.reverse(ahead), F.lit((1 << 63) - 1), SPAN, right))


def longest(spans: Column) -> Column:
    """``spans`` (of start, end) that don't lie within another."""
    kind = "struct<start:long,kind:int,end:long>"

    def step(end: Column, x: Column) -> tuple[Column, Column]:
        span = F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), (-x["back"]).alias("end"))
        return F.greatest(end, -x["back"]), F.when(-x["back"] > end, F.array(span)).otherwise(F.array().cast(f"array<{kind}>"))

    return walk(F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back")))), F.lit(-1).cast("long"), kind, step)


def scanned(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``extra``, known spans as __base, candidates with p-values as __cand
    (null where there are none)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 8
    known = docs.select("doc_id", *extra, text.alias("__t"))
    known = known.select("*", F.array_sort(F.concat(spans_of(F.col("__t"), ASSIGN, 0, value), spans_of(F.col("__t"), ACCESS, 1), spans_of(F.col("__t"), HEX, 2))).alias("__base"), candidates(F.col("__t")).alias("__all"))
    judged = F.transform(free_of(F.col("__base"), F.col("__all")), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["token"].alias("token"), battery(c["token"]).alias("p")))
    return known.select("doc_id", *extra, plain(F.col("__base")).alias("__base"), F.when(F.size("__all") > 0, judged).alias("__cand"))


def plain(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def length_class(n: Column) -> Column:
    return F.least(F.floor(F.log2(n)), F.lit(12)).cast("int")


def bin_of(p: Column) -> Column:
    return F.floor(-F.log(p) * BINS).cast("int")


def cuts(cands: DataFrame, fdr: float = FDR) -> dict[tuple[int, int], int]:
    """By encoding and length class, the least bin that the procedure accepts. Of
    fixed size: at most 9 classes of each encoding."""
    each = cands.where("__cand is not null").select(F.explode("__cand").alias("c")).where("c.p is not null").select(F.col("c.p.enc").alias("enc"), length_class(F.col("c.p.n")).alias("cls"), bin_of(F.col("c.p.p_text")).alias("bin"))
    counts = each.groupBy("enc", "cls", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("enc", "cls")
    ranked = counts.select("enc", "cls", "bin", F.sum("n").over(w.orderBy(F.desc("bin"))).alias("upto"), F.sum("n").over(w).alias("m"))
    passed = ranked.where(F.exp(-F.col("bin") / F.lit(float(BINS))) <= fdr * F.col("upto") / F.col("m")).groupBy("enc", "cls").agg(F.min("bin").alias("bin"))
    return {(r["enc"], r["cls"]): r["bin"] for r in passed.collect()}


def found(docs: DataFrame, extra: tuple[str, ...] = (), fdr: float = FDR, alpha: float = ALPHA) -> DataFrame:
    """doc_id, ``extra``, and all spans as __spans, sorted by start and kind. The
    scan of the texts is stored, so that the thresholds and what they select are
    of the same p-values."""
    slim = F.transform("__cand", lambda c: c.dropFields("token"))
    cands = stored(scanned(docs, extra).withColumn("__cand", slim), "candidates")
    limits = sorted(cuts(cands, fdr).items())

    def secret(c: Column) -> Column:
        ok = F.lit(False)
        for (enc, cls), least in limits:
            ok = ok | ((c["p"]["enc"] == enc) & (length_class(c["p"]["n"]) == cls) & (bin_of(c["p"]["p_text"]) >= least))
        return c["p"].isNotNull() & (c["p"]["p_random"] >= alpha) & ok

    more = F.when(F.col("__cand").isNull(), F.array().cast("array<struct<start:long,kind:int,end:long>>")).otherwise(longest(F.filter("__cand", secret)))
    return cands.select("doc_id", *extra, F.array_sort(F.concat("__base", more)).alias("__spans"))


def digests(spans: DataFrame) -> DataFrame:
    name = F.array(*map(F.lit, KINDS))
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("__spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("__spans", lambda x: x["kind"] < 3)
    return spans.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("__spans")).alias("spans"))


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """The rows with every span of text replaced by ``mask``; overlapping spans
    are masked once. n_chars, if there, follows the new text; rows without a
    span are unchanged."""
    rows = packed(docs, "doc_id", "text", "n_chars")
    spans = found(rows, tuple(rows.columns[1:]))

    def masked(text: Column) -> Column:
        return let(F.struct(blocks(text).alias("b"), F.length(text).cast("long").alias("n")), lambda t: F.array_join(pieces(t), mask))

    def pieces(t: Column) -> Column:
        """What stands before, between and behind the spans."""

        def cut(at: Column, end: Column) -> Column:
            i, j = (F.floor(x / BLOCK).cast("int") for x in (at, end))
            piece = lambda k, at, n: F.substring(F.coalesce(F.get(t["b"], k), F.lit("")), (at + 1).cast("int"), n.cast("int"))
            far = F.concat(piece(i, at % BLOCK, F.lit(BLOCK)), F.array_join(F.slice(t["b"], i + 2, j - i - 1), ""), piece(j, F.lit(0), end % BLOCK))
            return F.when(i == j, piece(i, at % BLOCK, end - at)).otherwise(far)

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            return F.greatest(at, x["end"]), F.when(x["start"] >= at, F.array(cut(at, x["start"]))).otherwise(F.array().cast("array<string>"))

        last = F.struct(t["n"].alias("start"), F.lit(4).alias("kind"), t["n"].alias("end"))
        return walk(F.array_append("__spans", last), F.lit(0).cast("long"), "string", step)

    clean = masked(F.col("text"))
    done = spans.withColumn("text", F.when(F.size("__spans") > 0, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return unpacked(done.drop("__spans"), docs)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(found(table(spark, sf_dir, "documents")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return redact(docs)
