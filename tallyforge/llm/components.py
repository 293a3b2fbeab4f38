"""Connected components by alternating large-star and small-star steps, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import discard, stash


def _settled(e: DataFrame) -> bool:
    """Whether every node with a smaller one has only that, and that has none."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(F.max(F.col("up") + F.least("up", "down"))).first()[0] in (None, 1)


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(a, b) to (node, root): the least node that each node reaches; nodes without edges don't appear. ``rows``: of edges, if known.

    Every step sends a node's larger neighbours to its least one. The number of steps
    grows with the logarithm of the longest chain. Least neighbours are written before
    they are joined, so that a hub's side of the join can be split. A round's tables are
    deleted when the next one's are written.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    e = stash(e, "edges", edges.count() if rows is None else rows)
    while not _settled(e):
        n = e.count()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", 2 * n)
        large = stash(both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "large", n)
        least = stash(large.groupBy("u").agg(F.min("v").alias("m")), "least", n)
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, stash(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges", n)
        discard(last, near, large, least)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The (node, root) of ``components`` after more links (a, b): only the roots that these touch are worked on again."""
    end = lambda x: roots.withColumnsRenamed({"node": x, "root": f"r{x}"})
    e = links.select("a", "b").join(end("a"), "a", "left").join(end("b"), "b", "left")
    tops = components(e.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), links.count())
    over = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return roots.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(tops)
