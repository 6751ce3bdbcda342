"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.session import checkpointed


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
    return row["n"], row["sum"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; a root is its component's smallest node.

    Large-star and small-star rounds until nothing changes, which takes about the logarithm of the
    longest path. A node's least neighbour is found by aggregation and joined back, so neighbour
    lists are never put together; each round is checkpointed in the shared folder.
    """
    def pointed(pairs: DataFrame) -> DataFrame:
        """Each (a, b) with the least of a's b and a itself."""
        return pairs.join(pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "a")

    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = pointed(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = pointed(large)
        small = down.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        now = checkpointed(small.where("a <> b").distinct())
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
