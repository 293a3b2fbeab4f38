"""Whole boards of bonds against what the exchange published.

``quotes`` has one row per issue, day and price source: secid, trade_date, price_source,
clean_pct, published_yield, published_accrued, published_duration. Issues without a
schedule are left out; prices that are null or not positive are not compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import bonds as B
from tallyforge.operators import store
from tallyforge.operators.staging import joined
from tallyforge.sources.snapshots import save_run

# A difference of accrued interest that still counts as none, and the currency of a plain issue.
ACCRUED_TOLERANCE, HOME_CURRENCY = 0.01, "RUB"


def settlements(quotes: DataFrame, coupons: DataFrame, fallback_days: int = 1) -> DataFrame:
    """(secid, trade_date, candidates, settled, on_date): the one day whose accrued interest is the published one, else some days after the trade."""
    days = quotes.select("secid", "trade_date", "published_accrued").distinct()
    found = B.settlement_candidates(days.where("published_accrued IS NOT NULL"), coupons, ACCRUED_TOLERANCE)
    x = joined(days, found, ["secid", "trade_date"], "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<date>")))
    x = x.withColumn("settled", F.when(F.size("candidates") == 1, F.col("candidates")[0]))
    return x.select("secid", "trade_date", F.size("candidates").alias("candidates"), "settled", F.coalesce("settled", F.date_add("trade_date", fallback_days)).alias("on_date"))


def verify_board(quotes: DataFrame, issues: DataFrame, coupons: DataFrame, amortizations: DataFrame, offers: DataFrame) -> DataFrame:
    """One row per quote: own and published yield, yield to the next offer, accrued interest and duration, differences and a note."""
    days = settlements(quotes, coupons)
    ask = joined(days, issues.select("secid", "currency"), "secid").select("secid", "currency", "on_date").distinct()
    state = B.accrued_interest(B.face_values(ask, issues, amortizations), coupons)
    flows = B.flow_arrays(B.future_flows(ask.select("secid", "on_date"), coupons, amortizations))
    at = B.next_offers(ask, offers)
    to_offer = B.flow_arrays(B.offer_flows(at, issues, coupons, amortizations)).select("secid", "on_date", F.col("flows").alias("offer_flows"))
    parts = amortizations.groupBy("secid").agg(F.count("*").alias("parts"))

    key = ["secid", "on_date"]
    x = joined(joined(quotes.where("clean_pct > 0"), days, ["secid", "trade_date"]), state, key)
    for side in (flows, at, to_offer):
        x = joined(x, side, key, "left")
    x = joined(x, parts, "secid", "left")
    x = B.dealt_out(B.dirty_prices(x), "secid", "price_source").withColumn("unknown", F.coalesce("unknown", F.lit(False)))
    x = x.withColumns({"own_yield": B.solve_yield(F.col("flows"), F.col("price")), "own_yield_to_offer": B.solve_yield(F.col("offer_flows"), F.col("price"))})
    x = x.withColumn("own_duration", B.duration_days(B.macaulay(F.col("flows"), F.col("own_yield"))))
    bp = lambda c: F.bround((F.col(c) - F.col("published_yield")) * 10000, 2)
    x = x.withColumns({"diff_bp": bp("own_yield"), "diff_to_offer_bp": bp("own_yield_to_offer")})
    x = x.withColumn("outlier", F.coalesce(F.abs("diff_bp") > B.THRESHOLD_BP, F.lit(True)))
    note = F.concat_ws(
        ", ",
        F.when(F.col("candidates") == 0, "accrued interest differs: wrong schedule").when(F.col("candidates") > 1, "no accrued interest: settlement day unclear"),
        F.when(F.col("unknown"), "unknown coupons"),
        F.when(F.col("offer_date").isNotNull(), "offer before maturity"),
        F.when(F.col("parts") > 1, "amortization"),
        F.when(F.col("currency") != HOME_CURRENCY, F.concat(F.lit("face value in "), "currency")),
        F.when(F.col("published_yield").isNull(), "no published yield").when(F.col("own_yield").isNull() & F.col("own_yield_to_offer").isNull(), "no root"),
        F.when(F.col("outlier") & (F.abs("diff_to_offer_bp") <= B.THRESHOLD_BP), "agrees with the offer"),
    )
    return x.withColumn("note", F.when(note == "", "ok").otherwise(note)).select(
        "secid", "trade_date", "price_source", "clean_pct", "own_yield", "published_yield", "diff_bp", "own_yield_to_offer", "diff_to_offer_bp",
        F.col("accrued").alias("own_accrued"), "published_accrued", "settled", "own_duration", "published_duration", "outlier", "note",
    )


def outliers(compared: DataFrame, most: int | None = None) -> DataFrame:
    """Rows beyond the threshold or without a difference, these first; the ``most`` worst if named."""
    x = compared.where("outlier").orderBy(F.abs("diff_bp").desc_nulls_first(), "secid", "price_source")
    return x if most is None else x.limit(most)


def run_board(quotes: DataFrame, schedule: dict[str, DataFrame], path: str, run_id: str, **header: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compare a whole board, save the run under ``path``, and return its header, its distribution by price source and its outliers.

    ``schedule`` holds the frames issues, coupons, amortizations and offers.
    """
    compared = verify_board(quotes, schedule["issues"], schedule["coupons"], schedule["amortizations"], schedule["offers"])
    top = save_run(compared, path, run_id, **header)
    saved = store.read(compared.sparkSession, path).where(F.col("run_id") == run_id)
    return top, B.distribution(saved), outliers(saved)
