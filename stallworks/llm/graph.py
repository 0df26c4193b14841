"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stallworks.llm.tables import Scratch


#: a star with more links than this share of all links (and than LEAST_STAR) is busy; so less than 2 / BUSY_SHARE stars are
BUSY_SHARE, LEAST_STAR = 1e-4, 64


def _with_smallest(links: DataFrame, smallest: DataFrame, busy: int) -> DataFrame:
    """Adds m of ``smallest`` (u, m, n) to the links (u, v); the few busy stars are broadcast, so none is gathered in one task."""
    few = F.broadcast(smallest.filter(F.col("n") > busy).select("u", F.col("m").alias("top")))
    marked = links.join(few, "u", "left")
    rest = marked.filter("top is null").select("u", "v").join(smallest.filter(F.col("n") <= busy).select("u", "m"), "u")
    return rest.select("u", "v", "m").union(marked.filter("top is not null").select("u", "v", F.col("top").alias("m")))


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): the smallest node of its component, for every node that is not the smallest itself.

    Each round points every node at the smallest of its neighbours (large star:
    the larger neighbours, small star: the smaller ones) until only stars are
    left; the number of rounds grows with the logarithm of the longest path.
    Links are a table throughout, and stars are aggregates, so neither a large
    component nor a busy node is gathered anywhere.  Nodes with a large share of
    all links get their smallest neighbour by broadcast; as links are counted,
    less than 20,000 nodes can have one.
    """
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = scratch.write(links.filter("a <> b").select(high, low).distinct())
    rows = edges.count()
    while True:
        busy = max(LEAST_STAR, int(rows * BUSY_SHARE))
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        least = least.select("u", F.least("u", "m").alias("m"), "n")
        large = _with_smallest(both.filter("v > u"), least, busy).select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.filter("m < u").select("u", F.col("m").alias("v"))
        large = large.filter("u <> v").union(own).distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _with_smallest(large, nearest, busy).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.write(small.union(nearest.select("u", F.col("m").alias("v"))).distinct())
        rows = new.count()
        tops = new.select("u").distinct().count()
        inner = new.select(F.col("v").alias("u")).distinct().join(new.select("u").distinct(), "u", "left_semi").limit(1).count()
        scratch.drop(edges)
        edges = new
        if rows == tops and not inner:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
