"""Chains and components as joins: nothing of a graph is gathered in a task, and no
side of a join is sent to the driver to be broadcast, however small a round's is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.store import stored


def roots(pointers: DataFrame) -> DataFrame:
    """(node, root) of (node, up): the end of each chain of ups, a node that is its own
    up. Each round every node that isn't there yet takes the up of its up, so a chain
    of n nodes takes log n rounds; nodes of a chain point to different ones until they
    arrive, so no join has a hot key. Nodes are of any type that can be joined, each
    there once, and ups are nodes. Empty: empty."""
    known = stored(pointers.select("node", "up", (F.col("node") == F.col("up")).alias("done")), "pointers")
    while known.where("not done").limit(1).count():
        there = known.select(F.col("node").alias("at"), F.col("up").alias("next"), F.col("done").alias("arrived")).hint("merge")
        moved = known.where("not done").join(there, F.col("up") == F.col("at")).select("node", F.col("next").alias("up"), F.col("arrived").alias("done"))
        known = stored(known.where("done").unionByName(moved), "pointers")
    return known.select("node", F.col("up").alias("root"))


def unions(pairs: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the pairs (a, b): the least node that each is
    connected with. Each round a node and its root take the least root across their
    pairs, then every node takes the root of its root; the number of rounds grows as
    the logarithm of the nodes. Nulls tie nothing. Empty: empty."""
    edges = stored(pairs.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    known = stored(nodes.select("node", F.col("node").alias("root")), "roots")
    while True:
        of = lambda end: known.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")).hint("merge")  # noqa: B023, E731
        across = edges.join(of("a"), "a").join(of("b"), "b").where("root_a <> root_b")
        low, high = F.least("root_a", "root_b"), F.greatest("root_a", "root_b")
        end = F.when(F.col("root_a") > F.col("root_b"), F.col("a")).otherwise(F.col("b"))
        offers = across.select(low.alias("offer"), F.explode(F.array(high, end)).alias("node")).groupBy("node").agg(F.min("offer").alias("offer"))
        offers = stored(offers, "offers")
        if not offers.limit(1).count():
            return known
        taken = stored(known.join(offers.hint("merge"), "node", "left").select("node", F.least("root", F.coalesce("offer", "root")).alias("root")), "roots")
        up = taken.select(F.col("node").alias("root"), F.col("root").alias("top")).hint("merge")
        known = stored(taken.join(up, "root").select("node", F.col("top").alias("root")), "roots")
