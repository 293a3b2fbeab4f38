"""Bond cash flows, prices and yields for whole boards.

Questions come as a frame ``ask`` (secid, on_date); schedules as coupons
(secid, period_start, pay_date, amount?), amortizations (secid, pay_date, amount) and
offers (secid, offer_date, kind, price_pct?). An unknown payment is null and makes what depends on it null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions.cleaning import let
from tallyforge.operators.quantiles import exact_quantiles
from tallyforge.operators.staging import dealt_out, joined, staged

# Bounds of a yield, days a year, basis points that are still equal.
LOW, HIGH, YEAR, THRESHOLD_BP = -0.99, 10.0, 365, 5
#: First guess and steps of the search for a yield.
GUESS, STEPS = 0.1, 24


def year_fraction(a: Column, b: Column, basis: str = "act365") -> Column:
    if basis == "act365":
        return F.datediff(b, a) / F.lit(365.0)
    if basis == "30/360":
        d1 = F.least(F.dayofmonth(a), F.lit(30))
        d2 = F.when((d1 == 30) & (F.dayofmonth(b) == 31), 30).otherwise(F.dayofmonth(b))
        return (360 * (F.year(b) - F.year(a)) + 30 * (F.month(b) - F.month(a)) + (d2 - d1)) / F.lit(360.0)
    new_year = lambda y: F.make_date(y, F.lit(1), F.lit(1))
    start, end = F.least(a, b), F.greatest(a, b)
    share = lambda y: F.datediff(F.least(end, new_year(y + 1)), F.greatest(start, new_year(y))) / F.datediff(new_year(y + 1), new_year(y))
    whole = F.aggregate(F.sequence(F.year(start), F.year(end)), F.lit(0.0), lambda s, y: s + share(y))
    return F.when(b < a, -whole).otherwise(whole)


def face_values(ask: DataFrame, issues: DataFrame, amortizations: DataFrame) -> DataFrame:
    paid = joined(amortizations, ask.select("secid", "on_date").distinct(), "secid").where("pay_date <= on_date").groupBy("secid", "on_date").agg(F.sum("amount").alias("paid"))
    x = joined(joined(ask, issues.select("secid", "initial_face"), "secid"), paid, ["secid", "on_date"], "left")
    return x.select(*ask.columns, (F.col("initial_face") - F.coalesce("paid", F.lit(0))).cast("decimal(24,6)").alias("face"))


def coupon_periods(ask: DataFrame, coupons: DataFrame) -> DataFrame:
    """The coupon whose [start, pay) holds the date; the first one by pay date."""
    x = joined(ask.select("secid", "on_date").distinct(), coupons, "secid").where("period_start <= on_date AND on_date < pay_date")
    return x.groupBy("secid", "on_date").agg(F.min_by(F.struct("period_start", "pay_date", "amount"), "pay_date").alias("c"))


def accrued_interest(ask: DataFrame, coupons: DataFrame) -> DataFrame:
    x = joined(ask, coupon_periods(ask, coupons), ["secid", "on_date"], "left")
    part = F.round(F.col("c.amount") * F.datediff("on_date", "c.period_start") / F.datediff("c.pay_date", "c.period_start"), 2).cast("decimal(24,6)")
    return x.withColumn("accrued", F.when(F.col("c").isNull(), F.lit(0).cast("decimal(24,6)")).otherwise(part)).drop("c")


def dirty_prices(quotes: DataFrame) -> DataFrame:
    """clean_pct, face and accrued to price."""
    return quotes.withColumn("price", F.col("clean_pct").cast("double") * F.col("face").cast("double") / 100 + F.col("accrued").cast("double"))


def future_flows(ask: DataFrame, coupons: DataFrame, amortizations: DataFrame, until: str | None = None) -> DataFrame:
    """(secid, on_date, pay_date, amount?) strictly after the date and, if named, up to the column ``until``."""
    pays = coupons.select("secid", "pay_date", "amount").unionByName(amortizations.select("secid", "pay_date", "amount"))
    x = joined(ask, pays, "secid").where("pay_date > on_date")
    return x.where(F.col("pay_date") <= F.col(until)) if until else x


def flow_arrays(flows: DataFrame, basis: str = "act365") -> DataFrame:
    """One row per (secid, on_date): flows as array<struct<t, a>> in date order, null if any is unknown."""
    t = year_fraction(F.col("on_date"), F.col("pay_date"), basis)
    g = flows.withColumn("f", F.struct(t.alias("t"), F.col("amount").cast("double").alias("a"))).groupBy("secid", "on_date")
    g = g.agg(F.array_sort(F.collect_list("f")).alias("flows"), F.bool_or(F.col("amount").isNull()).alias("unknown"))
    return g.withColumn("flows", F.when(~F.col("unknown"), F.col("flows")))


def discount(t: Column, y: Column, simple: bool = False) -> Column:
    return 1 + y * t if simple else F.pow(1 + y, t)


def present_value(flows: Column, y: Column, simple: bool = False) -> Column:
    return F.aggregate(flows, F.lit(0.0), lambda s, f: s + f["a"] / discount(f["t"], y, simple))


def solve_yield(flows: Column, price: Column, simple: bool = False) -> Column:
    """Root of PV(y) = price by Newton's steps, kept between bounds that the sign of PV - price moves; a step out of them halves.

    The steps are taken on ln PV over ln(1 + y) (over y for simple compounding), which is
    nearly straight: its slope is the duration, so few steps do for any flows.
    """
    low = F.greatest(F.lit(LOW), -1 / F.array_max(F.transform(flows, lambda f: f["t"])) + 1e-9) if simple else F.lit(LOW)

    def add(y: Column):
        def one(s: Column, f: Column) -> Column:
            v = f["a"] / discount(f["t"], y, simple)
            return let(v, lambda v: F.struct((s["pv"] + v).alias("pv"), (s["tv"] + v * f["t"] / ((1 + y * f["t"]) if simple else F.lit(1.0))).alias("tv")))

        return one

    def step(s: Column, _: Column) -> Column:
        at = F.aggregate(flows, F.struct(F.lit(0.0).alias("pv"), F.lit(0.0).alias("tv")), add(s["y"]))

        def moved(x: Column) -> Column:
            above = x["pv"] > price
            far = F.log(x["pv"] / price) * x["pv"] / F.nullif(x["tv"], F.lit(0.0))
            to = s["y"] + far if simple else (1 + s["y"]) * F.exp(far) - 1
            bounds = F.struct(F.when(above, s["y"]).otherwise(s["lo"]).alias("lo"), F.when(above, s["hi"]).otherwise(s["y"]).alias("hi"), to.alias("y"))
            return let(bounds, lambda n: F.struct(n["lo"].alias("lo"), n["hi"].alias("hi"), F.when((n["y"] >= n["lo"]) & (n["y"] <= n["hi"]), n["y"]).otherwise((n["lo"] + n["hi"]) / 2).alias("y")))

        return let(at, moved)

    start = F.struct(low.cast("double").alias("lo"), F.lit(HIGH).alias("hi"), F.lit(GUESS).alias("y"))
    root = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["y"])
    fine = (F.size(flows) > 0) & (price > 0) & (present_value(flows, low, simple) >= price) & (present_value(flows, F.lit(HIGH), simple) <= price)
    return F.when(fine, F.bround(root, 10))


def macaulay(flows: Column, y: Column) -> Column:
    top = F.aggregate(flows, F.lit(0.0), lambda s, f: s + f["t"] * f["a"] / discount(f["t"], y))
    return F.when(present_value(flows, y) > 0, F.bround(top / present_value(flows, y), 8))


def duration_days(years: Column) -> Column:
    """Whole days, half a day counting as one."""
    return F.round(years.cast("decimal(20,8)") * YEAR, 0).cast("int")


def modified_duration(years: Column, y: Column) -> Column:
    return F.when(1 + y > 0, F.bround(years / (1 + y), 8))


def current_yield(flows: DataFrame, prices: DataFrame) -> DataFrame:
    """Coupons of the next 365 days over the price; null if one is unknown. ``flows`` holds coupons alone."""
    near = flows.where(F.col("pay_date") <= F.date_add("on_date", YEAR)).groupBy("secid", "on_date")
    near = near.agg(F.sum("amount").alias("s"), F.bool_or(F.col("amount").isNull()).alias("unknown"))
    x = joined(prices, near, ["secid", "on_date"], "left")
    return x.withColumn("current_yield", F.when(~F.coalesce("unknown", F.lit(False)) & (F.col("price") > 0), F.bround(F.coalesce(F.col("s").cast("double"), F.lit(0.0)) / F.col("price"), 8))).drop("s", "unknown")


def next_offers(ask: DataFrame, offers: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(secid, on_date, offer_date, offer_kind, offer_pct) of the first offer after the date, of the named kinds; none if there is none."""
    o = offers if kinds is None else offers.where(F.col("kind").isin(*kinds))
    x = joined(ask.select("secid", "on_date").distinct(), o.select("secid", "offer_date", "kind", "price_pct"), "secid").where("offer_date > on_date")
    x = x.groupBy("secid", "on_date").agg(F.min(F.struct("offer_date", "kind", "price_pct")).alias("o"))
    return x.select("secid", "on_date", "o.offer_date", F.col("o.kind").alias("offer_kind"), F.col("o.price_pct").alias("offer_pct"))


def offer_flows(at: DataFrame, issues: DataFrame, coupons: DataFrame, amortizations: DataFrame) -> DataFrame:
    """Flows up to each offer of ``next_offers``, where the face value left is repaid at the offer's price (at par if it has none)."""
    flows = future_flows(at, coupons, amortizations, "offer_date").select("secid", "on_date", "pay_date", "amount")
    left = face_values(at.select("secid", F.col("on_date").alias("asked"), F.col("offer_date").alias("on_date"), "offer_pct"), issues, amortizations).where("face > 0")
    paid = (F.col("face") * F.coalesce(F.col("offer_pct"), F.lit(100)) / 100).cast("decimal(24,6)")
    return flows.unionByName(left.select("secid", F.col("asked").alias("on_date"), F.col("on_date").alias("pay_date"), paid.alias("amount")))


def curve_segments(curve: DataFrame) -> DataFrame:
    """(years, rate) points to adjacent segments; a curve is one small dimension, sorted as a whole."""
    w = W.partitionBy("curve").orderBy("years")
    return curve.select("curve", F.col("years").alias("x0"), F.col("rate").alias("y0"), F.lead("years").over(w).alias("x1"), F.lead("rate").over(w).alias("y1"), F.count("*").over(W.partitionBy("curve")).alias("points"))


def g_spread(bonds: DataFrame, curve: DataFrame) -> DataFrame:
    """Yield less the curve at the tenor: linear between points, none outside; at a knot the left segment."""
    s = curve_segments(curve)
    one = (F.col("points") == 1) | (F.col("x1").isNotNull() & (F.col("tenor") >= F.col("x0")) & (F.col("tenor") <= F.col("x1")))
    x = bonds.join(s, "curve").where(one)
    at = F.when(F.col("points") == 1, F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("tenor") - F.col("x0")) / (F.col("x1") - F.col("x0")))
    x = x.withColumn("spread", F.bround(F.col("yield") - at, 8)).groupBy("secid").agg(F.min_by("spread", "x0").alias("spread"))
    return joined(bonds, x, "secid", "left")


def settlement_candidates(quotes: DataFrame, coupons: DataFrame, tolerance=0.01, most: int = 4) -> DataFrame:
    """Days from the trade date on whose accrued interest is the published one."""
    ask = quotes.select("secid", "trade_date", "published_accrued", F.explode(F.sequence("trade_date", F.date_add("trade_date", most))).alias("on_date"))
    a = accrued_interest(ask, coupons).where(F.abs(F.col("accrued") - F.col("published_accrued")) <= F.lit(tolerance).cast("decimal(24,6)"))
    return a.groupBy("secid", "trade_date").agg(F.sort_array(F.collect_set("on_date")).alias("candidates"))


def compare_board(quotes: DataFrame) -> DataFrame:
    """own_yield against published_yield in basis points, the outlier flag and the note."""
    bp = F.bround((F.col("own_yield") - F.col("published_yield")) * 10000, 2)
    x = quotes.withColumn("diff_bp", bp)
    x = x.withColumn("outlier", F.coalesce(F.abs("diff_bp") > THRESHOLD_BP, F.lit(True)))
    note = F.concat_ws(", ", F.when(F.col("unknown"), "unknown coupons"), F.when(F.col("offer_date").isNotNull(), "offer before maturity"), F.when(F.col("published_yield").isNull(), "no published yield").when(F.col("own_yield").isNull(), "no root"))
    return x.withColumn("note", F.when(note == "", "ok").otherwise(note))


def distribution(compared: DataFrame) -> DataFrame:
    d = F.abs("diff_bp")
    x = staged(compared.select("price_source", "diff_bp", d.alias("far")), "compared")
    q = exact_quantiles(x, ["price_source"], "far", [0.5, 0.9])
    q = q.groupBy("price_source").agg(*[F.max(F.when(F.col("share") == p, F.col("quantile"))).alias(name) for p, name in ((0.5, "median"), (0.9, "p90"))])
    n = x.groupBy("price_source").agg(
        F.count("diff_bp").alias("compared"), F.count_if(F.col("diff_bp").isNull()).alias("skipped"), F.max(d).alias("largest"), F.count_if(d <= THRESHOLD_BP).alias("within"), F.bround(F.avg("diff_bp"), 2).alias("mean_bp"),
    )
    return n.join(q, "price_source", "left").select("price_source", "compared", "skipped", "median", "p90", "largest", "within", "mean_bp")
