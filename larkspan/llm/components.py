"""Connected components over an edge table, by alternating large-star and small-star rounds.

Each round is two aggregations and two equality joins on tables that were written to the shared folder, so a hot
star centre only makes a join side that adaptive execution can split.  Work per round is linear in the edges and the
rounds grow with the logarithm of the longest chain.  Nothing but two counters per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s"),
    ).first()
    return (row["n"], row["x"], row["s"])


def _with_minimum(edges: DataFrame, label: str) -> DataFrame:
    """(u, v, m): every edge with the least of u and all of u's neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(materialise(least, label), "u")


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Return (node, component) for every node on an edge between different nodes.

    ``component`` is the least node reachable.  Self edges and nulls are dropped, repeated edges count once, an empty
    table gives an empty result.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    now = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (a.isNotNull() & b.isNotNull()).alias("_ok"))
        .where("_ok AND u <> v")
        .select("u", "v")
        .distinct(),
        "cc-edges",
    )
    before = _signature(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_minimum(both, "cc-large-min").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.distinct(), "cc-large")
        seen = _with_minimum(large, "cc-small-min")
        small = seen.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(seen.select("u", F.col("m").alias("v")))
        now = materialise(small.distinct(), "cc-small")
        after = _signature(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
