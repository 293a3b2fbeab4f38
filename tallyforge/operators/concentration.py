"""How far values are concentrated, by several cuts in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Shares that count as the largest ones.
TOP = 5


def concentration(values: DataFrame, by: str, cuts: list[list[str]], value: str = "value") -> DataFrame:
    """by, cut, the cuts' columns (null where a cut lacks them), value, share of by's total.

    ``cut`` is the grouping id: its bits, from the first column on, are 1 where a column is
    not in the cut. All cuts come from one pass over the rows (grouping sets), each summed
    partially before the shuffle. Shares of a total that is not positive are null.
    """
    columns = list(dict.fromkeys(c for cut in cuts for c in cut))
    sets = [[by], *[[by, *cut] for cut in cuts]]
    g = values.groupingSets([[F.col(c) for c in s] for s in sets], by, *columns).agg(F.grouping_id().alias("cut"), F.sum(F.col(value).cast("decimal(28,6)")).cast("decimal(38,6)").alias("value"))
    nothing = (1 << len(columns)) - 1
    total = F.sum(F.when(F.col("cut") == nothing, F.col("value"))).over(W.partitionBy(by))
    return g.withColumn("total", total).select(by, "cut", *columns, "value", F.when(F.col("total") > 0, F.col("value").cast("double") / F.col("total").cast("double")).alias("share"))


def herfindahl(shares: DataFrame, by: str, top: int = TOP) -> DataFrame:
    """by, cut, n, herfindahl (sum of squared shares), top_share (of the greatest few) of each cut of ``concentration``."""
    order = W.partitionBy(by, "cut").orderBy(F.desc_nulls_last("share"))
    x = shares.withColumn("_r", F.row_number().over(order))
    return x.groupBy(by, "cut").agg(F.count("*").alias("n"), F.sum(F.col("share") * F.col("share")).alias("herfindahl"), F.sum(F.when(F.col("_r") <= top, F.col("share"))).alias("top_share"))
