"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of a link; component is the smallest node reachable.

    Alternates the large-star and small-star steps (Kiveris et al., "Connected Components in
    MapReduce and Beyond"): every round points neighbours at the smallest node seen, and the
    links are stable once each node points at its component's smallest. Each step is a
    min-aggregation, which combines on the map side, and an equality join, so a hub costs no
    more than its links. The links never leave the executors; each round is a table in the
    shared folder. Loops and links with a null end are ignored. No links: no rows.
    """
    x, y = F.col(a), F.col(b)
    links = links.filter(x.isNotNull() & y.isNotNull() & (x != y))
    links = links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    links = materialize(links, "links")
    state = _state(links)
    for _ in range(max_rounds):
        links = materialize(_small_star(_large_star(links)), "links")
        before, state = state, _state(links)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.unionByName(roots)


def _state(links: DataFrame) -> tuple:
    """Row count and an order-free checksum: three numbers to compare rounds by."""
    h = F.xxhash64("a", "b")
    row = links.agg(F.count(F.lit(1)), F.sum(h.bitwiseAND(0x7FFFFFFF)), F.sum(F.shiftrightunsigned(h, 32))).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    larger = both.join(least, "a").filter(F.col("b") > F.col("a"))
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    others = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
