"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _with_min(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs(u, v) with the least of each u and its v; the minima are written first, so that both join sides are
    plain exchanges and a hub's rows can be split at run time."""
    least = materialise(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return pairs.join(least, "u"), least


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links(a long, b long) -> (node, root): root is the smallest node reachable. Nodes without links do not appear.

    Links to oneself and repeated links are ignored; null ends link nothing; an empty table gives an empty one.
    Each round is two joins whose outputs stay linear in the links; the number of rounds grows with the logarithm of
    the longest chain. Nothing but two figures a round reaches the driver."""
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, least1 = _with_min(both)
        large = materialise(joined.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        joined, least2 = _with_min(large)
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least2.select("u", F.col("m").alias("v")))
        after = materialise(small.where("u <> v").distinct(), "edges")
        for old in (edges, least1, large, least2):
            discard(old)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
