"""Connected components of a link table, by alternating star steps.

Each round links every node's larger neighbours to its smallest one, then every
node's smaller neighbours likewise, until nothing changes; what is left is one
star per component around its smallest node. Rounds are logarithmic in the
number of nodes, a round is two aggregations and two equality joins, and a hub
with a third of all links is pre-aggregated on the map side and, in the join,
split by the adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomframe.llm.common import Scratch


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    rest = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")
    ).first()
    return row.n, row.x, row.s


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links(a, b)`` to one row ``(node, root)`` per linked node; root is the smallest node reachable."""
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = scratch.write(links.filter("a <> b").select(u, v).distinct(), "links")
    seen = _print(edges)
    while seen[0]:
        after = scratch.write(_round(edges), "stars")
        now = _print(after)
        scratch.drop(edges)
        edges = after
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
