"""Connected components of a link table, by alternating large and small stars.

Every round is a partial aggregate and an equality join whose hot side Spark's
adaptive execution can split; the links are written to the shared folder between
rounds, so nothing is collected and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, free


def _stars(pairs: DataFrame, larger_only: bool, many: bool) -> DataFrame:
    """Link each neighbour of u (the larger ones, or all) to the least of u and its neighbours; many: too many to broadcast."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = least.hint("merge") if many else least
    near = pairs.where("v > u") if larger_only else pairs
    linked = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger_only:
        linked = linked.unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u != v").distinct()


def _mark(state: DataFrame) -> tuple[int, int | None]:
    """The number of links, and a hash of them in any order."""
    return tuple(state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node that has a link; root is the least node that can be reached.

    Links from a node to itself and null ends count for nothing; repeated links
    count once; no link gives an empty table.
    """
    u, v = F.col(a), F.col(b)
    state = cut(links.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "links")
    mark = _mark(state)
    for _ in range(max_rounds):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        many = mark[0] > BROADCAST_ROWS
        large = _stars(both, True, many)
        small = _stars(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False, many)
        before = state
        state = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        free(before)
        seen = _mark(state)
        if seen == mark:
            roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
