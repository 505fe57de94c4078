"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventmill.session import stored


def components(edges: DataFrame) -> DataFrame:
    """Every node that an edge names, as `node`, and the smallest node it reaches, as `root`.

    `edges` has columns a and b of one orderable type; direction, repeated edges and
    loops do not matter, edges with a null are left out. Large-star and small-star
    steps (Kiveris et al., 2014) alternate until the edges no longer change; their
    number grows with the logarithm of the longest path. Only two numbers per round
    reach the driver. A node with very many edges is one key of a join that is split
    when skewed, and of an aggregate that is combined before the shuffle.
    """
    down = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = stored(down.distinct())
    mark = None
    while True:
        now = current.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")
        ).first()
        if now["n"] == 0 or now == mark:
            break
        mark = now
        current = stored(_small_star(_large_star(current)))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b"), F.col("b")).distinct()
    )


def _large_star(down: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to its smallest neighbour."""
    both = down.union(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(down: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and itself, are linked to its smallest one."""
    down = down.distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
