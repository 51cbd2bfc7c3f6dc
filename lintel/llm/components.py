"""Connected components by alternating large and small stars; every step is a group-by and a join on node ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import dropped, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a, b. Each node links its larger (large) or its smaller neighbours and itself (small) to its smallest neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("s")).first()
    return r["n"], r["s"] or 0


def connected(links: DataFrame, most: int = 60) -> DataFrame:
    """links: a, b (longs). Returns node, component (its smallest node) for every node that has a link."""
    edges = staged(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(edges)
    for _ in range(most):
        after = staged(_star(_star(edges, True), False), "edges")
        dropped(edges)
        edges, now = after, _state(after)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return staged(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots), "components")
