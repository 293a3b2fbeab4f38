"""Exact quantiles of large groups, by refining histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.operators.staging import staged

#: Bins of a bracket; passes after which something must be wrong (each divides a bracket by the bins).
BINS, MOST_PASSES = 1024, 120


def exact_quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], bins: int = BINS) -> DataFrame:
    """by, share, quantile: what ``percentile`` gives (values between two ranks are interpolated), without a group in one task.

    Every wanted rank has a bracket, at first the group's least and greatest value. A pass
    counts the values of each bracket's bins, in partial aggregations, and the bin that
    holds the rank is the next bracket, cut to the values in it, until its ends are equal:
    two or three passes for most data. Nulls and NaN don't count; a group without values has
    no row.
    """
    keys = [*by]
    x = rows.select(*keys, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    x = staged(x, "quantiles")
    g = x.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    g = g.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("at", (F.col("n") - 1) * F.col("share"))
    wanted = staged(g.select(*keys, "share", "at", F.floor("at").alias("low"), F.ceil("at").alias("high"), "lo", "hi"), "wanted")
    ranks = wanted.select(*keys, F.explode(F.array("low", "high")).alias("rank"), "lo", "hi").distinct()
    open_, done = ranks.withColumn("below", F.lit(0).cast("long")), []
    for _ in range(MOST_PASSES):
        open_ = staged(open_, "brackets")
        done.append(open_.where("lo = hi").select(*keys, "rank", F.col("lo").alias("v")))
        open_ = open_.where("lo < hi")
        if open_.isEmpty():
            break
        b = open_.select(*[F.col(k).alias(f"_{k}") for k in keys], "rank", "lo", "hi", "below")
        inside = x.join(b, [*[x[k].eqNullSafe(b[f"_{k}"]) for k in keys], x["v"].between(b["lo"], b["hi"])])
        at = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves, as a difference may overflow
        h = inside.groupBy(*keys, "rank", "below", F.least(F.floor(at * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("n").over(W.partitionBy(*keys, "rank").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        h = h.withColumn("before", F.col("below") + before).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
        open_ = h.select(*keys, "rank", "lo", "hi", F.col("before").alias("below"))
    else:
        raise RuntimeError("the quantiles did not settle")
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    found = staged(found, "ranks")
    one = lambda rank, name: found.select(*[F.col(k).alias(f"_{name}_{k}") for k in keys], F.col("rank").alias(rank + "_"), F.col("v").alias(name))
    out = wanted
    for rank, name in (("low", "vl"), ("high", "vh")):
        f = one(rank, name)
        out = out.join(f, [*[out[k].eqNullSafe(f[f"_{name}_{k}"]) for k in keys], out[rank] == f[rank + "_"]])
    between = (F.col("high") - F.col("at")) * F.col("vl") + (F.col("at") - F.col("low")) * F.col("vh")
    return out.select(*keys, "share", F.when(F.col("low") == F.col("high"), F.col("vl")).otherwise(between).alias("quantile"))
