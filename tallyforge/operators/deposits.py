"""Schedules of deposits, made from their terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(24,2)"
#: Days in which a business day must come.
LOOK = 21


def due_day(opened: Column, months: Column) -> Column:
    """The day so many months after; the last day of its month, if ``opened`` is the last of its own."""
    d = F.add_months(opened, months)
    return F.when(opened == F.last_day(opened), F.last_day(d)).otherwise(d)


def business_day(day: Column, holidays: Column) -> Column:
    """The day itself, or the first one after it that is neither on a weekend nor in the array ``holidays``."""
    free = lambda x: (F.weekday(x) < 5) & ~F.array_contains(holidays, x)
    return F.get(F.filter(F.sequence(day, F.date_add(day, LOOK), F.expr("interval 1 day")), free), F.lit(0))


def deposit_schedule(terms: DataFrame, holidays: list[str] = ()) -> DataFrame:
    """deposit_id, n, due, paid_on, days, interest, balance, principal: one row for each payment of interest.

    ``terms`` has deposit_id, amount, rate_pct, opened, months, every (months between
    payments; null: one at the end), capitalised, base (days of a year). A payment falls due
    whole months after the opening, the last one at the end of the term, and is made on the
    next business day, up to which interest runs. Interest is rounded half up to a hundredth
    and, if capitalised, added to the balance from which the next one comes. The last row
    pays back the principal, with what was added to it. Terms with a null in any column but
    ``every``, or without a positive term or step, have no schedule.
    """
    free = F.array(*[F.lit(h).cast("date") for h in holidays]).cast("array<date>")
    step = F.coalesce("every", "months")
    t = terms.where((F.col("months") > 0) & (step > 0) & F.col("amount").isNotNull() & F.col("rate_pct").isNotNull() & F.col("opened").isNotNull() & F.col("capitalised").isNotNull() & (F.col("base") > 0))
    t = t.withColumn("k", F.sequence(F.lit(1), F.ceil(F.col("months") / step).cast("int")))
    t = t.withColumn("due", F.transform("k", lambda k: due_day(F.col("opened"), F.least(k * step, F.col("months")).cast("int"))))
    t = t.withColumn("paid", F.transform("due", lambda d: business_day(d, free)))
    t = t.withColumn("from", F.concat(F.array("opened"), F.slice("paid", F.lit(1), F.size("paid") - 1)))
    t = t.withColumn("p", F.arrays_zip("k", "due", "paid", "from"))
    start = F.struct(F.col("amount").cast(MONEY).alias("balance"), F.array().cast(f"array<struct<n:int,due:date,paid_on:date,days:int,interest:{MONEY},balance:{MONEY},principal:{MONEY}>>").alias("rows"))

    def pay(s: Column, p: Column) -> Column:
        long = F.date_diff(p["paid"], p["from"])
        interest = F.round((s["balance"] * F.col("rate_pct").cast("decimal(9,4)")).cast("decimal(34,6)") * long / (100 * F.col("base")), 2).cast(MONEY)
        # the interest is asked for once
        def row(i: Column) -> Column:
            after = (s["balance"] + F.when(F.col("capitalised"), i).otherwise(F.lit(0))).cast(MONEY)
            last = p["k"] == F.size("k")
            made = F.struct(p["k"].alias("n"), p["due"].alias("due"), p["paid"].alias("paid_on"), long.alias("days"), i.alias("interest"), after.alias("balance"), F.when(last, after).otherwise(F.lit(0)).cast(MONEY).alias("principal"))
            return F.struct(after.alias("balance"), F.concat(s["rows"], F.array(made)).alias("rows"))

        return F.element_at(F.transform(F.array(interest), row), 1)

    rows = F.aggregate("p", start, pay, lambda s: s["rows"])
    return t.select("deposit_id", F.explode(rows).alias("r")).select("deposit_id", "r.*")
