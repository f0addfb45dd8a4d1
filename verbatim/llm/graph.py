"""Connected components by alternating large and small stars, as plain joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from verbatim.llm.common import discard, saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the smaller) neighbours of each node on the smallest node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("a", "_m").alias("m"))
    near = both.join(least, F.col("a") == F.col("_a"))
    if large:
        out = near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("_a").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of an edge list (a, b): columns ``node`` and ``component``.

    Each round is two joins and is written out; the number of rounds grows with the
    logarithm of the number of nodes; only the last round stays. Nodes with many neighbours are never gathered.
    """
    now = saved(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.count(F.lit(1))
    before = now.agg(*mark).first()
    while before[1]:
        old, now = now, saved(_star(_star(now, True), False), "edges")
        discard(old)
        after = now.agg(*mark).first()
        if after == before:
            break
        before = after
    out = saved(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
    discard(now)
    return out


def roots(parents: DataFrame) -> DataFrame:
    """Root of each node of a forest (a, b), b being the parent of a: columns ``node`` and ``root``.

    Pointer jumping: every round halves the depth and is one join, written out.
    """
    now = saved(parents.select(F.col("a").alias("node"), F.col("b").alias("root"), F.lit(True).alias("moved")), "roots")
    while True:
        above = now.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        old, now = now, saved(
            now.join(above, "root", "left").select("node", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")), "roots"
        )
        discard(old)
        if now.where("moved").isEmpty():
            out = saved(now.select("node", "root"), "roots")
            discard(now)
            return out
