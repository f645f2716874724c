"""Mixing sources to target weights: iterative proportional fitting.

Tokens are summed by cell (source, lang, topic), the cells' weights are raked in
turn to the target shares of source, of language and of topic, and each document
is kept with a probability in proportion to its cell's weight, up to 1. Where
the proportion is over 1 the document's weight is it, else 1, so that kept tokens
times weights meet the targets in expectation. The uniform
number of a document comes from a digest of its id and text, so a rerun and
another partitioning keep the same rows.

The cells are one row for each combination of the three columns. Up to MAX_CELLS
are raked on the driver; more, by the same bounds, as a table, by sums along each axis that are joined
back, each round stored in the shared folder. Raking ends when no category misses
its share by more than TOLERANCE, or after ROUNDS: targets that the cells can't
meet (a category whose only cells are all of another's) never converge. What is
missed at most is told as residual, 0 being a perfect fit.

Cases: null source, lang or topic: a category of its own, named in results by
null. Null or empty text: 0 tokens; such documents weigh nothing in the fitting
and share their cell's probability. Repeated rows: one result row each, kept or
left out together. Empty table: empty result. Columns of other names are ignored
or handed on.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, packed, stored, table, unpacked

#: Bounds of raking, for tables of any size.
ROUNDS = 1_000
TOLERANCE = 1e-9
MAX_CELLS = 200_000
#: Target shares are the tokens' shares to this power, scaled to 1: small categories gain.
TEMPERATURE = 0.5
#: Expected kept share of tokens.
RATE = 0.75
AXES = ("source", "lang", "topic")
#: Pattern of each lexical topic, in the order they are tried.
TOPICS = (("contact", "@[A-Za-z0-9.-]+\\.[a-z]{2}"), ("license", "[Ll]icen[cs]e|[Cc]opyright"), ("table", " \\| "))


def topic_of(text: Column) -> Column:
    """A lexical topic: contact, license, table or else prose."""
    text = F.coalesce(text, F.lit(""))
    out = F
    for name, pattern in TOPICS:
        out = out.when(text.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("prose"))


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WS.replace("[", "[^") + "+")).cast("long")


def rake(cells: dict[tuple, float], targets: tuple[dict, ...], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> dict[tuple, float]:
    """Weights of the cells whose sums along each axis meet the targets as shares
    of 1. Categories without a target or without tokens are left out of the total."""
    live = {k: float(v) for k, v in sorted(cells.items(), key=repr) if v > 0 and all(t.get(x, 0) > 0 for x, t in zip(k, targets, strict=True))}
    if not live:
        return {}
    weights, axes = np.array(list(live.values())), []
    for axis, target in enumerate(targets):
        names = sorted({k[axis] for k in live}, key=repr)
        at = {x: i for i, x in enumerate(names)}
        goal = np.array([float(target[x]) for x in names])
        axes.append((np.array([at[k[axis]] for k in live]), goal / goal.sum()))
    for _ in range(rounds):
        worst = 0.0
        for place, goal in axes:
            sums = np.bincount(place, weights, len(goal))
            worst = max(worst, float(np.abs(goal - sums).max()))
            weights = weights * np.divide(goal, sums, out=np.zeros_like(goal), where=sums > 0)[place]
        if worst < tolerance:
            break
    return dict(zip(live, weights.tolist(), strict=True))


def missed(weights: dict[tuple, float], targets: tuple[dict, ...]) -> float:
    """The most that a category's share of ``weights`` is off its target."""
    worst = 0.0
    for axis, target in enumerate(targets):
        sums: dict = {}
        for k, v in weights.items():
            sums[k[axis]] = sums.get(k[axis], 0.0) + v
        total = math.fsum(target[x] for x in sums)
        worst = max([worst, *(abs(target[x] / total - v) for x, v in sums.items())])
    return worst


def tempered(cells: dict[tuple, float], axis: int, temperature: float = TEMPERATURE) -> dict:
    sums: dict = {}
    for k, v in cells.items():
        sums[k[axis]] = sums.get(k[axis], 0.0) + v
    return {x: v**temperature for x, v in sums.items() if v > 0}


def filled(lift: dict[tuple, float], cells: dict[tuple, float], rate: float) -> float:
    """The factor at which chances of min(1, lift * factor) keep ``rate`` of the
    tokens that have a lift."""
    want = rate * math.fsum(cells[k] for k in lift)
    whole, rest = 0.0, math.fsum(v * cells[k] for k, v in lift.items())
    for k in sorted(lift, key=lambda k: (-lift[k], repr(k))):
        factor = (want - whole) / rest if rest > 0 else 0.0
        if factor * lift[k] <= 1:
            return max(0.0, factor)
        whole += cells[k]
        rest -= lift[k] * cells[k]
    return 1 / min(lift.values()) if lift else 0.0


def raked_cells(cells: dict[tuple, float], targets: tuple[dict, ...] | None, rate: float) -> tuple[list[tuple], float]:
    """(source, lang, topic, weight, keep_prob) of each cell, and the residual."""
    targets = targets or tuple(tempered(cells, axis) for axis in range(3))
    wanted = rake(cells, targets)
    lift = {k: v / cells[k] for k, v in wanted.items()}
    scale = filled(lift, cells, rate)
    return [(*k, max(1.0, v * scale), min(1.0, v * scale)) for k, v in lift.items()], missed(wanted, targets)


def raked_table(rows: DataFrame, targets: tuple[dict, ...] | None, rate: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """The same of a table of cells (source, lang, topic, n) of any size."""
    spark = rows.sparkSession
    live = rows.where("n > 0").select(*AXES, F.col("n").cast("double").alias("n"), F.col("n").cast("double").alias("w"))
    goals = []
    for axis, name in enumerate(AXES):
        if targets:
            kind = "category string, goal double"
            goals.append(spark.createDataFrame([(x, float(v)) for x, v in targets[axis].items() if v > 0], kind))
        else:
            goals.append(live.groupBy(F.col(name).alias("category")).agg(F.pow(F.sum("n"), TEMPERATURE).alias("goal")))
    for name, goal in zip(AXES, goals, strict=True):
        live = live.join(goal.drop("goal"), live[name].eqNullSafe(goal.category), "left_semi")
    live, shares = stored(live, "cells"), []
    for name, goal in zip(AXES, goals, strict=True):
        there = goal.join(live, live[name].eqNullSafe(goal.category), "left_semi")
        total = there.agg(F.sum("goal")).first()[0] or 1.0
        shares.append(stored(there.select("category", (F.col("goal") / total).alias("goal")), "shares"))
    worst = 0.0
    for _ in range(rounds):
        scaled = live.withColumn("worst", F.lit(0.0))
        for name, goal in zip(AXES, shares, strict=True):
            sums = scaled.groupBy(F.col(name).alias("own")).agg(F.sum("w").alias("s"))
            scale = sums.join(goal, sums.own.eqNullSafe(goal.category)).select("own", (F.col("goal") / F.col("s")).alias("f"), F.abs(F.col("goal") - F.col("s")).alias("off"))
            scaled = stored(scaled.join(scale, scaled[name].eqNullSafe(scale.own)).select(*AXES, "n", (F.col("w") * F.col("f")).alias("w"), F.greatest("off", "worst").alias("worst")), "raked")
        live, worst = scaled, scaled.agg(F.max("worst")).first()[0] or 0.0
        if worst < tolerance:
            break
    lift = F.col("w") / F.col("n")
    low, high = 0.0, 1.0
    kept = lambda factor: live.agg(F.sum(F.least(F.lit(1.0), lift * factor) * F.col("n")), F.sum("n")).first()
    while (got := kept(high))[0] is not None and got[0] < rate * got[1] and high < 1e300:
        low, high = high, high * 4
    for _ in range(60 if got[0] is not None else 0):
        middle = (low + high) / 2
        low, high = (middle, high) if kept(middle)[0] < rate * got[1] else (low, middle)
    return live.select(*AXES, F.greatest(F.lit(1.0), lift * high).alias("weight"), F.least(F.lit(1.0), lift * high).alias("keep_prob")), worst


def mix(docs: DataFrame, *, targets: tuple[dict, ...] | None = None, topic: Column | None = None, rate: float = RATE, seed: str = "mix", max_cells: int = MAX_CELLS, columns: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (or its ``columns``) with n_tokens, topic, weight (1, or how often
    a document that is kept for certain should count), keep_prob, kept and
    residual, which take the place of columns of these names. ``targets``: share wanted of each source, lang and topic; by default
    tempered shares. What is learned of the texts is stored, so they are read once."""
    topic = topic_of(F.col("text")) if topic is None else topic
    made = ("topic", "n_tokens", "weight", "keep_prob", "kept", "residual")
    digest = F.md5(F.concat_ws("\x00", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    uniform = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
    wanted = docs.select(*[f"`{c}`" for c in columns or docs.columns if c not in made])
    own = ("doc_id", "text", "source", "lang")
    every = docs.select(*[f"`{c}`" for c in dict.fromkeys((*own, *wanted.columns)) if c in docs.columns])
    known = packed(every, *own).withColumns({"topic": topic, "n_tokens": tokens_of(F.col("text")), "__u": uniform})
    known = stored(known.drop(*[c for c in ("doc_id", "text") if c not in wanted.columns]), "known")
    cells = stored(known.groupBy(*AXES).agg(F.sum("n_tokens").alias("n")), "cells")
    if cells.count() <= max_cells:
        rows, residual = raked_cells({tuple(r[:3]): float(r[3] or 0) for r in cells.collect()}, targets, rate)
        chances = F.broadcast(docs.sparkSession.createDataFrame(rows, "source string, lang string, topic string, weight double, keep_prob double"))
    else:
        chances, residual = raked_table(cells, targets, rate)
    chances = chances.select(F.col("source").alias("__a"), F.col("lang").alias("__b"), F.col("topic").alias("__c"), "weight", "keep_prob")
    joined = known.join(chances, known.source.eqNullSafe(F.col("__a")) & known.lang.eqNullSafe(F.col("__b")) & known.topic.eqNullSafe(F.col("__c")), "left").drop("__a", "__b", "__c")
    chance = F.coalesce("keep_prob", F.lit(0.0))
    done = joined.withColumns({"weight": F.coalesce("weight", F.lit(0.0)), "keep_prob": chance, "kept": F.col("__u") < chance, "residual": F.lit(residual)})
    return unpacked(done, wanted, *made)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with their weight, chance and whether they are sampled."""
    found = mix(table(spark, sf_dir, "documents"), columns=("doc_id", "source", "lang"))
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("keep_prob", 9).alias("keep_prob"), "kept", F.round("residual", 12).alias("residual"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents with their weights."""
    return mix(docs).where("kept").drop("kept", "residual")
