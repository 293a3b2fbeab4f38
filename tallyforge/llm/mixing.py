"""Operator 1: mix sources to target weights by nested hash thresholds.

Every document gets a 60-bit hash of its id. Words are summed by source and hash
bucket; running sums over the buckets find the one in which a source's budget ends;
only the documents of that boundary bucket are summed again, by the next 12 bits and
then by the hash itself. What is left is one threshold per source, and a document is
taken if its hash does not exceed it: a filter, no sort. A smaller budget's documents
are always part of a larger budget's.

Defined cases: null text has size 0; very long texts are counted whole; a null source is
a source of its own and comes last; a row without an id is hashed by its text, so that
such rows don't stand or fall together; rows with equal hashes (repeated rows) are taken
together; no row is taken more than ``cap`` times, wordless ones included; reruns agree,
as nothing but the rows decides; an empty table gives an empty result; columns beyond
those named are ignored in the report and kept in the mix, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import SPACE, stash, table

WEIGHTS = (5, 2, 1)
CAP = 3
#: Bits of the hash below the first and below the second bucket level.
LEVELS = (48, 36)
#: A source's threshold is kept this many times, so that no join key holds a whole source.
SALTS = 64


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(own), 1, 15), 16, 10).cast("long")


def key_of(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) to (.., target): weighted shares of the total, none above ``cap`` times its source.

    Resharing the excess by weight until none is above ends at one level L with
    target = min(cap * size, L * weight); it is found by walking the sources by
    cap * size / weight. One row per source goes through one task.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = sizes.withColumn("rk", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("rk") - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * cap)
    order = W.orderBy((F.col("cap").cast("double") / F.col("weight")), F.col("rk"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = s.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double").alias("rest"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double").alias("rest_w"),
    )
    s = s.withColumn("capped", F.col("cap").cast("double") * F.col("rest_w") <= F.col("rest") * F.col("weight"))
    free = F.first(F.when(~F.col("capped"), F.struct("rest", "rest_w")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    s = s.withColumn("free", free)
    capped = F.col("free").isNull() | F.col("capped")
    return s.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(F.col("free.rest") * F.col("weight") / F.col("free.rest_w")).alias("target"))


def thresholds(sized: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, size, h) to one row per source: key, source_size, target, epochs, threshold."""
    d = sized.select(key_of(F.col("source")).alias("key"), "source", "size", "h")
    hist = stash(d.groupBy("key", "source", F.shiftright("h", LEVELS[0]).alias("b")).agg(F.sum("size").alias("g")), "op1-hist")
    per = targets(hist.groupBy("source").agg(F.sum("g").alias("source_size")), weights, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    per = per.select(key_of(F.col("source")).alias("key"), "source_size", "target", epochs.alias("epochs"))
    per = stash(per.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "op1-targets")

    def boundary(buckets: DataFrame, budgets: DataFrame) -> DataFrame:
        """The first bucket of each source whose running sum exceeds the budget, and the sum below it."""
        c = F.sum("g").over(W.partitionBy("key").orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow))
        x = buckets.join(budgets.select("key", "budget", "below"), "key").withColumn("c", c + F.col("below"))
        return x.where(F.col("c") > F.col("budget")).groupBy("key").agg(F.min_by(F.struct("b", (F.col("c") - F.col("g")).alias("below"), "budget"), "b").alias("x")).select("key", "x.*")

    one = stash(boundary(hist, per.withColumn("below", F.lit(0))), "op1-level1")
    inside = d.withColumn("b", F.shiftright("h", LEVELS[0])).join(one.select("key", "b"), ["key", "b"], "left_semi")
    hist2 = inside.groupBy("key", F.shiftright("h", LEVELS[1]).alias("b")).agg(F.sum("size").alias("g"))
    two = stash(boundary(hist2, one), "op1-level2")
    last = d.withColumn("b", F.shiftright("h", LEVELS[1])).join(two, ["key", "b"]).groupBy("key", "b", "below", "budget", "h").agg(F.sum("size").alias("g"))
    c = F.col("below") + F.sum("g").over(W.partitionBy("key").orderBy("h").rowsBetween(W.unboundedPreceding, W.currentRow))
    last = last.withColumn("c", c)
    taken = (F.col("c") <= F.col("budget")) | (2 * F.col("c") - F.col("g") < 2 * F.col("budget"))
    cut = last.groupBy("key", "b").agg(F.max(F.when(taken, F.col("h"))).alias("t")).select("key", F.coalesce("t", F.shiftleft("b", LEVELS[1]) - 1).alias("threshold"))
    return stash(per.join(cut, "key", "left").select("key", "source_size", "target", "epochs", F.coalesce("threshold", F.lit(-1)).alias("threshold")), "op1-plan")


def apply_mix(sized: DataFrame, plan: DataFrame, cap: int = CAP) -> DataFrame:
    """Add source_size, target and taken to rows with source, size and h."""
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = sized.withColumn("key", key_of(F.col("source"))).withColumn("salt", (F.col("h") % SALTS).cast("int"))
    times = F.least(F.col("epochs") + (F.col("h") <= F.col("threshold")).cast("long"), F.lit(cap).cast("long"))
    return rows.join(salted, ["key", "salt"]).withColumn("times", times).withColumn("taken", F.col("size") * F.col("times"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per document: id, source, size, source_size, target, times, taken."""
    sized = stash(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), hash_of(F.col(id_col), F.col(text_col)).alias("h")), "op1-sizes")
    return apply_mix(sized, thresholds(sized, weights, cap), cap).select("doc_id", "source", "size", "source_size", "target", "times", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with all its own columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    sized = docs.select(row, F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), hash_of(F.col(id_col), F.col(text_col)).alias("h"))
    plan = thresholds(stash(sized.select("source", "size", "h"), "op1-sizes"), weights, cap)
    times = F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))
    return apply_mix(sized, plan, cap).select("row", times.alias("again")).select("row.*")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substring(md5(coalesce(doc_id::VARCHAR, 'null' || coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((rk - 1) % 3 + 1)::INT]::BIGINT AS weight, source_size * 3 AS cap FROM s),
o AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE AS rest,
         (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS rest_w,
         row_number() OVER (ORDER BY cap::DOUBLE / weight, rk) AS n
  FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap::DOUBLE * rest_w <= rest * weight AS capped FROM o),
f AS (SELECT rest AS fr, rest_w AS fw FROM c WHERE NOT capped ORDER BY n LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN capped OR fr IS NULL THEN cap::DOUBLE ELSE fr * weight / fw END AS target
  FROM c LEFT JOIN f ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
g AS (SELECT source, h, sum(size) AS g FROM d GROUP BY source, h),
r AS (SELECT *, sum(g) OVER (PARTITION BY source ORDER BY h) AS c FROM g),
k AS (
  SELECT r.source, r.h, e.source_size, e.target, e.epochs,
         (r.c <= e.target - e.epochs * e.source_size OR 2 * r.c - r.g < 2 * (e.target - e.epochs * e.source_size)) AS more
  FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source)
SELECT d.doc_id, d.size, k.source_size, k.target, (d.size * (k.epochs + k.more::BIGINT))::BIGINT AS taken
FROM d JOIN k ON d.h = k.h AND d.source IS NOT DISTINCT FROM k.source
"""
