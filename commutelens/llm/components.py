"""Connected components of a table of links, by stars that shrink to their least node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commutelens.session import cut


def _to_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours of each node to the least of them (and of itself).

    The least neighbour is a grouping and joined back, so a node with very many links is
    no single task's: the grouping combines early and the join can be split.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u").withColumn("m", F.least("u", "m"))
    if larger_only:
        return joined.where("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    # the smaller neighbours and the node itself
    return joined.where("v < u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(
        least.where("m < u").select(F.col("u").alias("a"), F.col("m").alias("b"))
    )


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``links (u, v)``: root is the least node reachable.

    Rounds of linking larger neighbours and then smaller neighbours to the least one; the
    number of rounds grows with the logarithm of the longest path.  Each round is written
    to the shared folder.  Links of a node to itself are ignored; nodes are of any type
    with an order, not null.
    """
    edges = cut(
        links.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(),
        "links",
    )
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        stars = _to_least(both, larger_only=True).distinct()
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v"))
        edges = cut(_to_least(both, larger_only=False).distinct(), "links")
        # stars to the least node map onto themselves: nothing changes any more
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b"), F.col("b")).distinct()
            )
        before = now
