"""Positions, lots, cash and flows of a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Event types that move a quantity, and those that are external flows.
MOVES = ("OPENING_BALANCE", "BUY", "SELL", "MATURITY", "CONVERSION", "SPIN_OFF", "SPLIT", "PARTIAL_REDEMPTION")
EXTERNAL = ("OPENING_BALANCE", "CASH_IN", "CASH_OUT", "TRANSFER")


def moves(ledger: DataFrame, as_of=None) -> DataFrame:
    m = ledger.where(F.col("event_type").isin(*MOVES) & F.col("instrument_id").isNotNull() & F.col("quantity").isNotNull())
    return m if as_of is None else m.where(F.col("trade_date") <= F.lit(as_of).cast("date"))


def positions(ledger: DataFrame, as_of=None, by=("account_id", "instrument_id"), keep_empty: bool = False) -> DataFrame:
    p = moves(ledger, as_of).groupBy(*by).agg(F.sum("quantity").alias("quantity"))
    return p if keep_empty else p.where("quantity <> 0")


def cash_balances(ledger: DataFrame, as_of=None, by=("account_id", "currency")) -> DataFrame:
    day = F.coalesce("settlement_date", "trade_date")
    rows = ledger if as_of is None else ledger.where(day <= F.lit(as_of).cast("date"))
    return rows.groupBy(*by).agg(F.sum("amount").alias("amount"))


def settled_cash(ledger: DataFrame, accounts: DataFrame, currency: str, as_of=None) -> DataFrame:
    """(account_id, amount) of every account's cash in one currency; 0 where it has no entry in it."""
    b = cash_balances(ledger.where(F.col("currency") == currency), as_of, ("account_id",))
    return accounts.select("account_id").join(b, "account_id", "left").select("account_id", F.coalesce("amount", F.lit(0).cast("decimal(24,6)")).alias("amount"))


def external_flow_by_day(ledger: DataFrame, by_currency: bool = False) -> DataFrame:
    keys = ["day", *(["currency"] if by_currency else [])]
    return ledger.where(F.col("event_type").isin(*EXTERNAL)).withColumn("day", F.coalesce("settlement_date", "trade_date")).groupBy(*keys).agg(F.sum("amount").alias("amount"))


def fifo_lots(ledger: DataFrame, as_of=None, by=("account_id", "instrument_id"), keep_empty: bool = False) -> DataFrame:
    """Open lots in closed form, without a loop.

    With x the signed quantities, E = total sold + min(0, lowest running sum) is what
    purchases really lose; a purchase keeps clip(bought so far - E, 0, x). A sale beyond
    the holding vanishes and is not carried to later purchases.

    Running sums go in two levels, months of a key and rows of a month, so a key with
    most of the ledger is sorted a month at a time.
    """
    q = F.col("quantity").cast("decimal(28,10)")
    x = moves(ledger, as_of).withColumn("x", q).withColumn("month", F.trunc("trade_date", "month"))
    before = W.partitionBy(*by).orderBy("month").rowsBetween(W.unboundedPreceding, -1)
    months = x.groupBy(*by, "month").agg(F.sum("x").alias("mx"), F.sum(F.greatest("x", F.lit(0))).alias("mb"))
    months = months.select(*by, "month", F.coalesce(F.sum("mx").over(before), F.lit(0)).alias("x0"), F.coalesce(F.sum("mb").over(before), F.lit(0)).alias("b0"))
    run = W.partitionBy(*by, "month").orderBy("trade_date", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    x = x.select("*", F.sum("x").over(run).alias("cx"), F.sum(F.greatest("x", F.lit(0))).over(run).alias("cb")).join(months, [*by, "month"])
    x = x.withColumns({"cx": F.col("cx") + F.col("x0"), "cb": F.col("cb") + F.col("b0")})
    key = x.groupBy(*by).agg(F.sum(F.greatest(-F.col("x"), F.lit(0))).alias("sold"), F.min("cx").alias("lowest"), F.sum("x").alias("net"))
    x = x.join(key, list(by)).withColumn("eaten", F.col("sold") + F.least(F.lit(0), F.col("lowest")))
    x = x.withColumn("remaining", F.greatest(F.lit(0), F.least(F.col("x"), F.col("cb") - F.col("eaten"))))
    x = x.where("x > 0 AND remaining > 0") if keep_empty else x.where("x > 0 AND remaining > 0 AND net <> 0")
    return x.select(*by, "id", F.col("trade_date").alias("opened"), "remaining", F.coalesce("price", "cost_basis").alias("price"))


def first_negative(ledger: DataFrame, by=("instrument_id",)) -> DataFrame:
    """First day each instrument's end-of-day quantity is below zero."""
    daily = moves(ledger).groupBy(*by, "trade_date").agg(F.sum("quantity").alias("q"))
    run = daily.withColumn("quantity", F.sum("q").over(W.partitionBy(*by).orderBy("trade_date")))
    return run.where("quantity < 0").groupBy(*by).agg(F.min("trade_date").alias("day"), F.min_by("quantity", "trade_date").alias("quantity"))


def at_dates(ledger: DataFrame, marks: DataFrame, by, day, value) -> DataFrame:
    """Running sums of ``value`` at many (key, as_of) marks: days are summed first, so a key's sort has its days and marks, not its rows."""
    rows = ledger.select(*by, day.alias("d"), value.alias("v")).groupBy(*by, "d").agg(F.sum("v").alias("v"))
    rows = rows.select(*by, "d", "v", F.lit(0).alias("last"), F.lit(None).cast("string").alias("report_id"))
    m = marks.select(*by, F.col("as_of").alias("d"), F.lit(0).cast("decimal(24,6)").alias("v"), F.lit(1).alias("last"), F.col("report_id").cast("string").alias("report_id"))
    run = W.partitionBy(*by).orderBy("d", "last").rangeBetween(W.unboundedPreceding, W.currentRow)
    return rows.unionByName(m).withColumn("total", F.sum("v").over(run)).where("last = 1").select("report_id", *by, F.col("d").alias("as_of"), "total")
