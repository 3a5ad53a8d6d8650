"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import materialize, small_side


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on the least of them (and of the node itself)."""
    near = edges.union(edges.select("b", "a")).toDF("a", "b") if large else edges
    least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
    # on its own, the join below is either a broadcast or has exchanges in which a hub's edges are split
    joined = near.join(small_side(materialize(least, "cc-least")), F.col("a") == F.col("c"))
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
    return out.filter(F.col("a") != F.col("b"))


def _is_forest_of_stars(pairs: DataFrame, n: int) -> bool:
    """Every node hangs on one other, which hangs on none."""
    if pairs.select("a").distinct().count() < n:
        return False
    return not pairs.join(pairs.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, root: each node of an edge with the least node it reaches.

    Nodes are of any ordered type. A round is written to the shared folder; the driver
    sees only counts. Rounds grow with the logarithm of the size.
    """
    pairs = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = materialize(pairs, "cc")
    n = pairs.count()
    while n and not _is_forest_of_stars(pairs, n):
        pairs = materialize(_stars(_stars(pairs, True), False).distinct(), "cc", rows=2 * n)
        n = pairs.count()
    roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
