"""Connected components of an edge table, by contraction to least labels."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.staging import staged

#: Rounds after which something must be wrong: each round leaves about half of the nodes that still have edges.
MOST_ROUNDS = 100


def groups(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every node of an edge and a number that is the same for all nodes it is connected with.

    The nodes get numbers once. A round sends every node to the least of itself and its
    neighbours, by an order of numbers that changes from round to round so that no chain is
    sorted in it, and goes on with the edges between the nodes that are left. Components
    that have become one node take no part any more, so a round is about half of the one
    before. At the end the rounds' maps are joined backwards. No neighbourhood is ever held
    as a whole, and the driver sees only counts.
    """
    e = staged(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct(), "pairs")
    nodes = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct()
    nodes = staged(nodes.withColumn("u", F.monotonically_increasing_id()), "nodes")  # numbers stay as they are written
    number = lambda x, col, name: x.join(nodes.select(F.col("node").alias(col), F.col("u").alias(name)), col).drop(col)
    e = number(number(e.where("a <> b"), "a", "u"), "b", "v")
    maps, order = [], random.Random(42)
    for _ in range(MOST_ROUNDS):
        e = staged(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        if e.isEmpty():
            break
        mixed = lambda x, mask=F.lit(order.getrandbits(62)): F.col(x).bitwiseXOR(mask)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(mixed("v")).alias("m")).withColumn("m", F.least("m", mixed("u")))
        maps.append(staged(least.select("u", mixed("m").alias("m")), "least"))
        at = maps[-1].withColumnsRenamed({"u": "x", "m": "y"})
        e = e.join(at, F.col("u") == F.col("x")).select(F.col("y").alias("u"), "v")
        e = e.join(at, F.col("v") == F.col("x")).select("u", F.col("y").alias("v"))
    else:
        raise RuntimeError("the components did not settle")
    tops = None
    for m in reversed(maps):
        tops = m if tops is None else m.join(tops.withColumnsRenamed({"u": "x", "m": "y"}), F.col("m") == F.col("x"), "left").select("u", F.coalesce("y", "m").alias("m"))
    if tops is None:
        return nodes.select("node", F.col("u").alias("label"))
    return nodes.join(tops, "u", "left").select("node", F.coalesce("m", "u").alias("label"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every node of an edge and the least node it is connected with."""
    g = staged(groups(edges, a, b), "groups")
    least = g.groupBy("label").agg(F.min("node").alias("least"))
    return g.join(least, "label").select("node", F.col("least").alias("label"))
