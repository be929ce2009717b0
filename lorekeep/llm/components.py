"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _flipped(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: every vertex hands its larger (or smaller) neighbours to its smallest neighbour.

    ``edges`` (a, b) hold each link once with a > b. The minimum is a map-side combined aggregate, and the join that
    follows is one that Spark can split where a vertex has very many links.
    """
    view = _flipped(edges) if large else edges
    least = view.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        least = least.withColumn("m", F.least("m", "a"))
    joined = view.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return out.where("a > b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every component of ``edges`` (a, b), a > b, is a star about its smallest vertex: each a has one link and is no b."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link, component being the smallest node reachable.

    ``edges`` has two columns of one orderable type. Alternating large-star and small-star steps until all components are
    stars, which may be at once; every round is written to the shared folder, so lineage stays short, and rounds grow with the
    logarithm of the longest path.
    """
    a, b = edges.columns
    now = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct(), "edges")
    for _ in range(max_rounds):
        if _are_stars(now):
            break
        nxt = written(_star(_star(now, True), False), "edges")
        dropped(now)
        now = nxt
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
