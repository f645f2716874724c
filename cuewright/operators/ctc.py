"""Sequence decoding: greedy and by a bigram lattice."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING_COST = 1e7


def argmax(scores: Column) -> Column:
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def collapse(steps: Column) -> Column:
    """Symbol numbers without repeats and without the blank 0."""
    start = F.struct(F.lit(-1).alias("last"), F.array().cast("array<int>").alias("out"))
    step = lambda a, x: F.struct(x.alias("last"), F.when((x != a["last"]) & (x != 0), F.array_append(a["out"], x)).otherwise(a["out"]).alias("out"))
    return F.aggregate(steps, start, step, lambda a: a["out"])


def spelled(symbols: Column, alphabet: str) -> Column:
    """Their characters; number 1 is the first of the alphabet."""
    return F.array_join(F.transform(symbols, lambda i: F.substring(F.lit(alphabet), i, 1)), "")


def top_k(rows: DataFrame, key: list[str], score: str, k: int = 5, tie: str = "idx") -> DataFrame:
    """The k best of each key with their rank from 1."""
    w = Window.partitionBy(*key).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def space_width(steps: Column) -> Column:
    """Mean number of blanks between characters, whole; null without a character."""
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("gap"), F.lit(0).alias("sum"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        new = (x != 0) & (x != a["last"])
        counted = F.when(new & (a["n"] > 0), a["sum"] + a["gap"]).otherwise(a["sum"])
        gap = F.when(x == 0, a["gap"] + 1).otherwise(0)
        return F.struct(x.alias("last"), gap.alias("gap"), counted.alias("sum"), F.when(new, a["n"] + 1).otherwise(a["n"]).alias("n"))

    return F.aggregate(steps, start, step, lambda a: F.when(a["n"] > 0, F.floor(a["sum"] / a["n"]).cast("int")))


def bigram_cost(pairs: DataFrame, bigrams: DataFrame) -> DataFrame:
    """(a, b) with cost -ln p of (a, b, p), a large cost if there is none."""
    return pairs.join(bigrams, ["a", "b"], "left").withColumn("cost", F.coalesce(-F.log("p"), F.lit(MISSING_COST)))


def best_path(steps: list[list[tuple[str, float]]], bigrams: dict[tuple[str, str], float], blank: str = "", sure: float = 0.9) -> str:
    """The cheapest reading of the candidates (character, probability) of each
    step by -ln p of the characters and of their bigrams. Certain blanks and
    repeats of a step are passed over."""
    cost = lambda p: -math.log(max(p, 1e-30))
    columns: list[list[tuple[str, float]]] = []
    for step in steps:
        if step[0][0] == blank and step[0][1] >= sure or columns and columns[-1][0][0] == step[0][0]:
            continue
        columns.append(step[:1] if step[0][1] >= sure else step)
    paths: dict[str, tuple[float, str]] = {"": (0.0, "")}
    for column in columns:
        new: dict[str, tuple[float, str]] = {}
        for last, (sum_, text) in sorted(paths.items()):
            for ch, p in column:
                if ch == blank:
                    made = (last, sum_ + 10 * cost(p), text)
                else:
                    pair = bigrams.get((last, ch)) if last else 1.0
                    made = (ch, sum_ + cost(p) + (cost(pair) if pair else MISSING_COST), text + ch)
                if made[0] not in new or made[1:] < new[made[0]]:
                    new[made[0]] = made[1:]
        paths = new
    return min(paths.values())[1]


def lattice_decode(rows: DataFrame, bigrams: DataFrame | dict[tuple[str, str], float], blank: str = "", sure: float = 0.9) -> DataFrame:
    """(region, steps: array of arrays of ch and p) to (region, text): best_path() as a
    fold over the steps. ``bigrams``: (a, b, p); a region gets those of its own
    characters by a join, so the table may be of any size. What is kept while folding
    is one path for each last character. Null regions are a region; a null or empty
    list of steps reads as an empty text."""
    spark = rows.sparkSession
    if isinstance(bigrams, dict):
        bigrams = spark.createDataFrame([(a, b, float(p)) for (a, b), p in bigrams.items()], "a string, b string, p double")
    cost = lambda p: -F.log(F.greatest(p, F.lit(1e-30)))
    chars = F.array_distinct(F.flatten(F.transform("steps", lambda s: F.transform(s, lambda c: c["ch"]))))
    own = rows.select("region", F.coalesce(chars, F.array().cast("array<string>")).alias("chars")).distinct()
    known = own.select("region", "chars", F.explode("chars").alias("a")).join(bigrams.where("p > 0").select("a", "b", "p"), "a").where(F.array_contains("chars", F.col("b")))
    pairs = known.select("region", F.struct(F.struct("a", "b").alias("k"), cost(F.col("p")).alias("c")).alias("e")).distinct()
    costs = pairs.groupBy(F.col("region").alias("r")).agg(F.map_from_entries(F.collect_list("e")).alias("costs"))
    both = rows.select("region", F.coalesce("steps", F.array().cast("array<array<struct<ch: string, p: double>>>")).alias("steps")).join(costs, F.col("region").eqNullSafe(F.col("r")), "left")

    top = lambda s: F.get(s, F.lit(0))
    heard = F.filter("steps", lambda s: ~((top(s)["ch"] == blank) & (top(s)["p"] >= sure)))
    fresh = F.filter("heard", lambda s, i: (i == 0) | (top(s)["ch"] != top(F.get("heard", i - 1))["ch"]))
    columns = F.transform(fresh, lambda s: F.when(top(s)["p"] >= sure, F.slice(s, 1, 1)).otherwise(s))

    def on(path: Column, c: Column) -> Column:
        pair = F.when(path["last"] == "", F.lit(0.0)).otherwise(F.coalesce(F.element_at(F.col("costs"), F.struct(path["last"].alias("a"), c["ch"].alias("b"))), F.lit(MISSING_COST)))
        read = F.struct((path["cost"] + cost(c["p"]) + pair).alias("cost"), F.concat(path["text"], c["ch"]).alias("text"), c["ch"].alias("last"))
        skip = F.struct((path["cost"] + 10 * cost(c["p"])).alias("cost"), path["text"].alias("text"), path["last"].alias("last"))
        return F.when(c["ch"] == blank, skip).otherwise(read)

    def step(paths: Column, column: Column) -> Column:
        made = F.flatten(F.transform(paths, lambda p: F.transform(column, lambda c: on(p, c))))
        # one array, so that its paths are made once for all last characters
        best = lambda m: F.transform(F.array_distinct(F.transform(m, lambda x: x["last"])), lambda last: F.array_min(F.filter(m, lambda x: x["last"] == last)))
        return F.transform(F.array(made), best)[0]

    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit("").alias("text"), F.lit("").alias("last")))
    found = both.withColumn("heard", heard).withColumn("columns", columns)
    return found.select("region", F.aggregate("columns", start, step, lambda paths: F.array_min(paths)["text"]).alias("text"))
