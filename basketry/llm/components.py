"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import stored

MOST_ROUNDS = 60


def _with_least(edges: DataFrame) -> DataFrame:
    """(x, y, least) where ``least`` is the least of x and its neighbours y.

    The least ones are written first: in a join of two plain tables Spark can split a node with very many links.
    """
    least = edges.groupBy("x").agg(F.min("y").alias("least")).select("x", F.least("x", "least").alias("least"))
    return edges.join(stored(least, "least"), "x")


def _pairs(left: str, right: str):
    return F.greatest(left, right).alias("x"), F.least(left, right).alias("y")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node with a link, the least node it can reach. Each round is written and counted.

    Nodes are integers. In a large star every node links its larger neighbours to the least one; in a small star it links
    its smaller neighbours and itself to the least one. Both keep the components, and they end in stars around the roots.
    """
    edges = stored(links.select(*_pairs(a, b)).filter("x <> y").distinct(), "edges")
    print_before = None
    for _ in range(MOST_ROUNDS):
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        large = _with_least(both).filter("y > x").select(F.col("y").alias("x"), F.col("least").alias("y")).filter("x <> y").distinct()
        small = _with_least(stored(large, "edges"))
        edges = small.select(F.col("y").alias("x"), F.col("least").alias("y")).union(small.select("x", F.col("least").alias("y")))
        edges = stored(edges.select(*_pairs("x", "y")).filter("x <> y").distinct(), "edges")
        fingerprint = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y"))).first())
        if fingerprint == print_before:
            return edges.select(F.col("x").alias("node"), F.col("y").alias("root")).union(edges.select("y", "y").distinct())
        print_before = fingerprint
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
