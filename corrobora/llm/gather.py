"""Links among the members of shared buckets, without all pairs of a dense group.

Rows (key, node, weight) say which nodes share a bucket.  In each of a few rounds
a node meets the heaviest node of its buckets, the head it shares most of them
with: at most one pair a node, whatever the group.  Heads lie in the middle of
dense groups, so these become one component after a round or two, and buckets that
hold one component are done.  Pairs that are left, of nodes in different
components, are for the caller to make, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free
from .components import components

ROUNDS = 3


def buckets(rows: DataFrame, name: str, facts: dict[str, Column] | None = None, kept: Column | None = None) -> DataFrame:
    """The rows (key, node, ...) whose key several nodes have, with the weight of their node: how often it meets another row.

    Keys are counted by partial sums, so a key of many nodes moves as a row a task,
    and Spark can split the join that follows.  facts: more aggregates of a key's
    rows, besides ``n``; kept: what must hold of these.
    """
    sums = [F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), *[c.alias(k) for k, c in (facts or {}).items()]]
    counted = rows.groupBy("key").agg(*sums).where(F.lit(True) if kept is None else kept)
    met = cut(rows.join(counted.where("low < high").select("key", "n"), "key"), name)
    weights = met.groupBy("node").agg(F.sum("n").alias("weight"))
    return cut(met.drop("n").join(weights, "node").select(*rows.columns, "weight"), name)


def rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The rows with the root of their node: the node itself until it is linked."""
    if roots is None:
        return rows.withColumn("root", F.col("node"))
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def mixed(rows: DataFrame) -> DataFrame:
    """The keys whose rows have several roots."""
    return rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")


def head_pairs(state: DataFrame, least: int) -> DataFrame:
    """(a, b): each node that isn't of its bucket's head's root, with the head it shares most buckets with, ``least`` at least.

    state: (key, node, weight, root).  The head of a bucket is its heaviest node; one of weight -1 is none.
    """
    heads = state.groupBy("key").agg(F.max(F.struct("weight", "node", "root")).alias("h"), F.min("root").alias("low"), F.max("root").alias("high"))
    heads = heads.where("low < high and h.weight >= 0").select("key", F.col("h.node").alias("head"), F.col("h.root").alias("head_root"))
    meets = state.join(heads, "key").where("root != head_root").groupBy("node", "head").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    best = meets.groupBy("node").agg(F.max(F.struct("n", "head")).alias("m"))
    return best.select(F.col("node").alias("a"), F.col("m.head").alias("b"))


def gathered(met: DataFrame, verified: Callable[[DataFrame], DataFrame], name: str, least: int = 1, rounds: int = ROUNDS, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of the rounds and those known before, and the roots (node, root) that they give.

    verified: gives those of pairs (a, b) that are links.
    """
    linked = met.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0) if known is None else known
    roots, used = None if known is None else components(known), None
    for _ in range(rounds):
        state = rooted(met.select("key", "node", "weight"), roots)
        if used is not None:  # heads of former rounds step back
            state = state.join(used, state["node"] == used["head"], "left").withColumn("weight", F.when(F.col("head").isNull(), F.col("weight")).otherwise(-1)).drop("head")
            state = cut(state, name)  # looked at twice
        pairs = cut(head_pairs(state, least), name)
        free(state)
        if pairs.isEmpty():
            break
        found = cut(verified(pairs), name)
        linked = found if roots is None else linked.unionByName(found)
        heads = pairs.select(F.col("b").alias("head")).distinct()
        used = cut(heads if used is None else used.unionByName(heads).distinct(), name)
        roots = components(linked)
    return linked, components(linked) if roots is None else roots
