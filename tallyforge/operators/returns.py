"""Daily prices and values of accounts, and their returns: NAV, TWR, XIRR.

Histories are cut into months. What holds at a month's start is carried in from the months
before, of which a key has few; within a month a key's rows are sorted by themselves. So a
key with most of the rows is worked on a month at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.operators.projections import EXTERNAL, moves

MONEY = "decimal(28,6)"
#: Bounds of a yearly return, and days of a year.
LOW, HIGH, YEAR = -0.99, 10.0, 365
#: Cells of the logarithmic grid on which a return's brackets are found, and halvings of a bracket.
GRID, HALVINGS = 256, 60
#: Flows whose worth a task computes at once, about.
FLOWS_AT_ONCE = 20_000


def running(daily: DataFrame, by: list[str], value: str) -> DataFrame:
    """Sums of one row's ``value`` a day from a key's first day on, in two levels."""
    x = daily.withColumn("month", F.trunc("day", "month"))
    before = W.partitionBy(*by).orderBy("month").rowsBetween(W.unboundedPreceding, -1)
    heads = x.groupBy(*by, "month").agg(F.sum(value).alias("s")).select(*by, "month", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("head"))
    inside = W.partitionBy(*by, "month").orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    return x.withColumn(value, F.sum(value).over(inside)).join(heads, [*by, "month"]).select(*by, "day", (F.col(value) + F.col("head")).cast(MONEY).alias(value))


def steps(changes: DataFrame, by: list[str], value: str, until) -> DataFrame:
    """(by, month, first, last, value): the days on which a value holds, cut at months; each value holds until the key's next change or ``until``.

    ``changes`` has one row a key and day, with a value that is not null.
    """
    end = F.lit(until).cast("date")
    x = changes.where(F.col("day") <= end).select(*by, "day", F.col(value).alias("value"), F.trunc("day", "month").alias("month"))
    lasts = x.groupBy(*by, "month").agg(F.max_by("value", "day").alias("value"))
    months = x.groupBy(*by).agg(F.min("month").alias("m")).select(*by, F.explode(F.sequence("m", F.trunc(end, "month"), F.expr("interval 1 month"))).alias("month"))
    before = W.partitionBy(*by).orderBy("month").rowsBetween(W.unboundedPreceding, -1)
    heads = months.join(lasts, [*by, "month"], "left").select(*by, "month", F.last("value", ignorenulls=True).over(before).alias("value"), F.col("month").alias("day"), F.lit(0).alias("own"))
    rows = heads.where("value IS NOT NULL").unionByName(x.withColumn("own", F.lit(1)))
    after = F.lead("day").over(W.partitionBy(*by, "month").orderBy("day", "own"))
    rows = rows.select(*by, "month", F.col("day").alias("first"), F.least(F.date_sub(F.coalesce(after, F.add_months("month", 1)), 1), end).alias("last"), F.col("value").alias(value))
    return rows.where("first <= last")


def days(first: str, last: str) -> Column:
    return F.explode(F.sequence(F.col(first), F.col(last), F.expr("interval 1 day"))).alias("day")


def asof_prices(prices: DataFrame, until, by: tuple[str, ...] = ("instrument_id",)) -> DataFrame:
    """Every day's price from a key's first one to ``until``: the last one known, with the day it is from."""
    x = prices.where("price IS NOT NULL").withColumn("p", F.struct("price", F.col("day").alias("priced_on")))
    return steps(x, [*by], "p", until).select(*by, days("first", "last"), "p.price", "p.priced_on")


def daily_nav(ledger: DataFrame, prices: DataFrame, until, by: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """by, day, cash, securities, nav, external_flow, stale, unpriced for every day from a key's first entry to ``until``.

    ``prices`` has instrument_id, day, price, one row a day. Entries count on their trade
    day. A holding is valued at the last price known; ``stale`` counts holdings whose
    price is from a day before, ``unpriced`` those that never had one (they count as 0).
    """
    keys = [*by]
    m = moves(ledger, until).groupBy(*keys, "instrument_id", F.col("trade_date").alias("day")).agg(F.sum("quantity").cast(MONEY).alias("quantity"))
    held = steps(running(m, [*keys, "instrument_id"], "quantity"), [*keys, "instrument_id"], "quantity", until).where("quantity <> 0")
    known = prices.where("price IS NOT NULL").select("instrument_id", "day", F.struct(F.col("price").cast(MONEY).alias("price"), F.col("day").alias("priced_on")).alias("p"))
    # an instrument that was held before its first price has none until then
    none = F.struct(F.lit(None).cast(MONEY).alias("price"), F.lit(None).cast("date").alias("priced_on"))
    first = known.groupBy("instrument_id").agg(F.min("day").alias("first_price"))
    early = m.groupBy("instrument_id").agg(F.min("day").alias("day")).join(first, "instrument_id", "left").where("first_price IS NULL OR day < first_price")
    price = steps(known.unionByName(early.select("instrument_id", "day", none.alias("p"))), ["instrument_id"], "p", until)
    price = price.withColumnsRenamed({"first": "p_first", "last": "p_last"})
    x = held.join(price, ["instrument_id", "month"]).withColumns({"first": F.greatest("first", "p_first"), "last": F.least("last", "p_last")}).where("first <= last")
    x = x.select(*keys, days("first", "last"), F.coalesce((F.col("quantity") * F.col("p.price")).cast(MONEY), F.lit(0)).cast(MONEY).alias("securities"), "p.priced_on")
    entries = ledger.where(F.col("trade_date") <= F.lit(until).cast("date")).select(*keys, F.col("trade_date").alias("day"), F.col("amount").cast(MONEY).alias("cash"), F.col("event_type").isin(*EXTERNAL).alias("outer"))
    daily = entries.groupBy(*keys, "day").agg(F.sum("cash").cast(MONEY).alias("cash"), F.sum(F.when(F.col("outer"), F.col("cash"))).cast(MONEY).alias("external_flow"))
    cash = steps(running(daily.select(*keys, "day", "cash"), keys, "cash"), keys, "cash", until).select(*keys, days("first", "last"), "cash")
    zero = F.lit(0).cast(MONEY)
    parts = (
        x.select(*keys, "day", zero.alias("cash"), "securities", zero.alias("external_flow"), F.coalesce(F.col("priced_on") < F.col("day"), F.lit(False)).cast("int").alias("stale"), F.col("priced_on").isNull().cast("int").alias("unpriced"))
        .unionByName(cash.select(*keys, "day", "cash", zero.alias("securities"), zero.alias("external_flow"), F.lit(0).alias("stale"), F.lit(0).alias("unpriced")))
        .unionByName(daily.where("external_flow IS NOT NULL").select(*keys, "day", zero.alias("cash"), zero.alias("securities"), "external_flow", F.lit(0).alias("stale"), F.lit(0).alias("unpriced")))
    )
    n = parts.groupBy(*keys, "day").agg(*[F.sum(c).cast(MONEY).alias(c) for c in ("cash", "securities", "external_flow")], *[F.sum(c).alias(c) for c in ("stale", "unpriced")])
    return n.select(*keys, "day", "cash", "securities", (F.col("cash") + F.col("securities")).cast(MONEY).alias("nav"), "external_flow", "stale", "unpriced")


def time_weighted(nav: DataFrame, by: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """by, days, restarts, twr: the chained product of (nav - flow) / (nav of the day before), less 1.

    A flow counts at the end of its day. The first day has no day before: its flow is the
    start. After a day of nav 0 the chain starts anew (``restarts``); a day before with a
    negative nav has no return, and then the key has none (null). Days must have one row.
    """
    keys = [*by]
    x = nav.select(*keys, "day", F.col("nav").cast("double").alias("nav"), F.coalesce(F.col("external_flow").cast("double"), F.lit(0.0)).alias("flow"), F.trunc("day", "month").alias("month"))
    months = x.groupBy(*keys, "month").agg(F.max_by("nav", "day").alias("last"))
    heads = months.select(*keys, "month", F.lag("last").over(W.partitionBy(*keys).orderBy("month")).alias("head"))
    x = x.withColumn("before", F.lag("nav").over(W.partitionBy(*keys, "month").orderBy("day"))).join(heads, [*keys, "month"])
    x = x.withColumn("before", F.coalesce("before", "head"))
    ratio = F.when(F.col("before") > 0, (F.col("nav") - F.col("flow")) / F.col("before"))
    chain = lambda r: F.coalesce(F.product(r), F.lit(1.0)).alias("chain")
    by_month = x.groupBy(*keys, "month").agg(chain(ratio), F.count("*").alias("days"), F.count_if(F.col("before") == 0).alias("restarts"), F.count_if(F.col("before") < 0).alias("none"))
    out = by_month.groupBy(*keys).agg(chain("chain"), *[F.sum(c).alias(c) for c in ("days", "restarts", "none")])
    return out.select(*keys, "days", "restarts", F.when(F.col("none") == 0, F.col("chain") - 1).alias("twr"))


def money_weighted(flows: DataFrame, by: tuple[str, ...] = ("account_id",), low: float = LOW, high: float = HIGH, grid: int = GRID) -> DataFrame:
    """by, flows, roots, xirr: the yearly return at which a key's flows are worth nothing.

    ``flows`` has by, day, amount: paid in below 0, taken out above 0, the value at the end
    as taken out. With flows of both signs in any order the value need not be monotone:
    the brackets are the sign changes on ``grid`` cells of ln(1 + r) between the bounds, and
    a return is given only where there is just one (``roots``), by halving it. Roots closer
    than a cell (3 % of 1 + r) pass as none or as one. A key's days are summed first, so
    its array holds its days.
    """
    keys = [*by]
    daily = flows.where("day IS NOT NULL AND amount IS NOT NULL").groupBy(*keys, "day").agg(F.sum(F.col("amount").cast(MONEY)).alias("amount")).where("amount <> 0")
    k = daily.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", F.col("amount").cast("double").alias("amount")))).alias("f"))
    t = F.transform("f", lambda f: F.date_diff(f["day"], F.element_at("f", 1)["day"]) / F.lit(float(YEAR)))
    k = k.repartition(*keys).select(*keys, t.alias("t"), F.col("f.amount").alias("a"))
    schema = k.drop("t", "a").schema.add("flows", "long").add("roots", "long").add("xirr", "double")
    bottom, top = math.log(1 + low), math.log(1 + high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, FLOWS_AT_ONCE * batch.num_rows // max(1, len(batch.column("t").flatten())))
            for i in range(0, batch.num_rows, step):
                b = batch.slice(i, step)
                flows, turns, root = roots(*(b.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("t", "a")), np.asarray(pc.list_value_length(b.column("a")), np.int64), bottom, top, grid)
                found = pa.array(root, mask=turns != 1)
                yield pa.RecordBatch.from_arrays([*(b.column(x) for x in keys), pa.array(flows), pa.array(turns), found], [*keys, "flows", "roots", "xirr"])

    return k.mapInArrow(run, schema)


def roots(t: np.ndarray, a: np.ndarray, flows: np.ndarray, bottom: float, top: float, grid: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For keys of so many ``flows`` each: how many there are, the turns of their worth on the grid, and the root of those that turn once."""
    # keys with more flows come first, so the n-th flows lie side by side; they are added in a key's order
    starts, by_length = np.cumsum(flows) - flows, np.argsort(-flows, kind="stable")
    more = np.searchsorted(-flows[by_length], -np.arange(flows.max(initial=0)), "left")
    nth = [starts[by_length[:many]] + n for n, many in enumerate(more)]
    layers = [(-t[i], a[i]) for i in nth]

    def above(y, rows: np.ndarray | None = None) -> np.ndarray:
        total = np.zeros(len(flows) if rows is None else len(rows))
        for ti, ai in layers:
            if rows is None:
                total[: len(ti)] += ai * np.exp(ti * y)
            else:
                i = rows[: np.searchsorted(rows, len(ti))]
                total[: len(i)] += ai[i] * np.exp(ti[i] * y[: len(i)])
        return total > 0

    at = np.array([bottom + (top - bottom) * j / float(grid) for j in range(grid + 1)])
    turns, first, up = np.zeros(len(flows), np.int64), np.zeros(len(flows), np.int64), np.zeros(len(flows), bool)
    before = above(at[0])
    for j in range(grid):
        now = above(at[j + 1])
        turned = now != before
        new = turned & (turns == 0)
        first[new], up[new] = j, before[new]
        turns += turned
        before = now
    one = np.flatnonzero(turns == 1)
    lo, hi = at[first[one]], at[first[one] + 1]
    for _ in range(HALVINGS):
        mid = (lo + hi) / 2
        same = above(mid, one) == up[one]
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid)
    root = np.zeros(len(flows))
    root[one] = np.exp((lo + hi) / 2) - 1
    back = np.empty_like(by_length)
    back[by_length] = np.arange(len(flows))
    return flows, turns[back], root[back]
