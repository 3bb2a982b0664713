"""Connected components as DataFrame joins, without collecting links anywhere."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from basketry.session import discard, spool


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.filter("v > u").join(least, "u")
        .filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    kept = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node points to one root only, and no root points anywhere."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("root")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    wrong = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("root").alias("root")).filter("out > 1 or (out = 1 and root = 1)")
    return wrong.isEmpty() and edges.filter("v > u").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Root of every node that has an edge to another: columns ``node``, ``root``.

    Alternates large-star and small-star until the edges stand still, which takes a number of
    rounds in the logarithm of the longest path.  Each round is written to the shared folder,
    so lineage stays short and a lost executor costs one re-read.  The root is the smallest
    node of its component; a root has no row for itself.  NULL ends and loops are dropped.
    """
    current = (
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .filter("u is not null and v is not null and u != v").distinct()
    )
    current = spool(current, "edges")
    while not _settled(current):
        before, current = current, spool(_small_star(_large_star(current)), "edges")
        discard(before)
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
