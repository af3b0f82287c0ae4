"""Connected components of a link table by alternating star contractions, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, store

#: A graph of n nodes contracts in O(log^2 n) rounds; this only guards against an endless loop.
MOST_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node of its neighbourhood."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them; links run from the larger to the smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame) -> Stored:
    """Links (a, b) of long ids, in any order and with repeats, to a stored table (node, component).

    component is the smallest id that can be reached. Ids without a link to another id do not occur. Null ends and
    self-links are ignored; an empty table gives an empty one. No step gathers a neighbourhood: the smallest
    neighbour is a partial aggregate, and a hub's rows are split by the skew join.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = store(ordered, "links")
    mark = _mark(now.df)
    for _ in range(MOST_ROUNDS):
        if not mark[0]:
            break
        after = store(_small_star(_large_star(now.df)), "links")
        seen = _mark(after.df)
        now.drop()
        now = after
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    stars = now.df.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.df.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = store(stars.union(roots), "components")
    now.drop()
    return found
