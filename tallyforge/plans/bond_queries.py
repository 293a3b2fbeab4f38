"""Bond queries on schedules derived from ``part``, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import bonds as B
from tallyforge.operators.staging import joined
from tallyforge.plans import demo

ON = "2025-03-02"
D = lambda x: F.col(x).cast("double").alias(x)


def _all(spark, d):
    issues = demo.demo_issues(spark, d)
    ask = issues.select("secid", F.lit(ON).cast("date").alias("on_date"))
    return issues, demo.demo_coupons(issues), demo.demo_amortizations(issues), demo.demo_offers(issues), demo.demo_quotes(issues), ask


def face_value(spark, d):
    i, _, a, _, _, ask = _all(spark, d)
    return B.face_values(ask, i, a).select("secid", D("face"))


def accrued_interest(spark, d):
    _, c, _, _, _, ask = _all(spark, d)
    return B.accrued_interest(ask, c).select("secid", D("accrued"))


def _priced(spark, d):
    i, c, a, _, q, ask = _all(spark, d)
    state = B.accrued_interest(B.face_values(ask, i, a), c)
    return B.dirty_prices(joined(q, state, "secid"))


def dirty_price(spark, d):
    return _priced(spark, d).select("secid", "price_source", F.round("price", 6).alias("price"))


def future_flows(spark, d):
    _, c, a, _, _, ask = _all(spark, d)
    return B.future_flows(ask, c, a).groupBy("secid").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"), F.max("pay_date").alias("last"), F.bool_or(F.col("amount").isNull()).alias("unknown"))


def _solved(spark, d):
    _, c, a, _, _, ask = _all(spark, d)
    f = B.flow_arrays(B.future_flows(ask, c, a))
    x = B.dealt_out(joined(_priced(spark, d), f, ["secid", "on_date"], "left"), "secid", "price_source")
    return x.withColumn("own_yield", B.solve_yield(F.col("flows"), F.col("price")))


def ytm(spark, d):
    return _solved(spark, d).select("secid", "price_source", (F.round("own_yield", 8) + 0.0).alias("ytm"))


def ytm_simple(spark, d):
    """Yields by simple compounding, in which a payment t years off is divided by 1 + y t."""
    _, c, a, _, _, ask = _all(spark, d)
    x = B.dealt_out(joined(_priced(spark, d), B.flow_arrays(B.future_flows(ask, c, a)), ["secid", "on_date"], "left"), "secid", "price_source")
    return x.select("secid", "price_source", (F.round(B.solve_yield(F.col("flows"), F.col("price"), simple=True), 7) + 0.0).alias("ytm"))


def duration(spark, d):
    x = _solved(spark, d).withColumn("years", B.macaulay(F.col("flows"), F.col("own_yield")))
    return x.select("secid", "price_source", "years", B.modified_duration(F.col("years"), F.col("own_yield")).alias("modified"))


def _to_offer(spark, d, kinds=None):
    i, c, a, o, _, ask = _all(spark, d)
    f = B.flow_arrays(B.offer_flows(B.next_offers(ask, o, kinds), i, c, a))
    x = B.dealt_out(joined(_priced(spark, d), f, ["secid", "on_date"]), "secid", "price_source")
    return x.select("secid", "price_source", F.round(B.solve_yield(F.col("flows"), F.col("price")), 8).alias("ytp"))


def ytp(spark, d):
    return _to_offer(spark, d)


def ytp_put(spark, d):
    return _to_offer(spark, d, ("put",))


def current_yield(spark, d):
    _, c, _, _, _, ask = _all(spark, d)
    coupons = joined(ask, c.select("secid", "pay_date", "amount"), "secid").where("pay_date > on_date")
    return B.current_yield(coupons, _priced(spark, d)).select("secid", "price_source", F.round("current_yield", 6).alias("current_yield"))


def g_spread(spark, d):
    i = demo.demo_issues(spark, d)
    curve = spark.createDataFrame([("z", 0.25, 0.05), ("z", 1.0, 0.07), ("z", 2.0, 0.08), ("z", 3.0, 0.085)], "curve string, years double, rate double")
    bonds = i.select("secid", F.lit("z").alias("curve"), (F.datediff("maturity_date", F.lit(ON).cast("date")) / 365.0).alias("tenor"), (F.col("rate") / 100.0).alias("yield"))
    return B.g_spread(bonds, curve).select("secid", "spread")


def settlement_match(spark, d):
    i, c, _, _, _, _ = _all(spark, d)
    q = i.select("secid", F.lit("2025-03-01").cast("date").alias("trade_date"))
    published = B.accrued_interest(q.select("secid", F.date_add("trade_date", 1).alias("on_date"), "trade_date"), c).select("secid", "trade_date", F.col("accrued").alias("published_accrued"))
    x = B.settlement_candidates(published, c)
    return x.select("secid", F.size("candidates").cast("long").alias("n"), F.element_at("candidates", 1).alias("first"))


def _compared(spark, d):
    _, _, _, o, _, ask = _all(spark, d)
    x = joined(_solved(spark, d), B.next_offers(ask, o), ["secid", "on_date"], "left").withColumn("unknown", F.coalesce("unknown", F.lit(False)))
    return B.compare_board(x)


def yield_compare(spark, d):
    return _compared(spark, d).select("secid", "price_source", F.round("diff_bp", 1).alias("diff_bp"), "outlier", "note")


def yield_distribution(spark, d):
    return B.distribution(_compared(spark, d)).select("price_source", "compared", "skipped", F.round("median", 1).alias("median"), F.round("largest", 1).alias("largest"), "within", F.round("p90", 1).alias("p90"), F.round("mean_bp", 1).alias("mean_bp"))


def yield_outliers(spark, d):
    return _compared(spark, d).where("outlier").select("secid", "price_source", F.round("diff_bp", 1).alias("diff_bp")).orderBy(F.abs("diff_bp").desc_nulls_first(), "secid", "price_source").limit(20)


def year_fractions(spark, d):
    back = F.col("pk") % 3 == 0  # end before start
    i = demo.demo_issues(spark, d).withColumns({"a": F.when(back, F.col("maturity_date")).otherwise(F.col("issue_date")), "b": F.when(back, F.col("issue_date")).otherwise(F.col("maturity_date"))})
    return i.select("secid", *[F.round(B.year_fraction(F.col("a"), F.col("b"), b), 8).alias(n) for n, b in (("act365", "act365"), ("thirty", "30/360"), ("actact", "actact"))])


_B = f"WITH RECURSIVE {demo.BONDS_SQL}"
_STATE = r""", fac AS (SELECT iss.secid, 1000 - coalesce(sum(amount) FILTER (pay_date <= DATE '2025-03-02'), 0) AS face FROM iss LEFT JOIN amo USING (secid) GROUP BY ALL),
acc AS (SELECT iss.secid, CASE WHEN c.secid IS NULL THEN 0 ELSE ((2 * c.cents * (DATE '2025-03-02' - c.period_start) + 182) // 364) / 100.0::DOUBLE END AS accrued
  FROM iss LEFT JOIN cup c ON c.secid = iss.secid AND c.period_start <= DATE '2025-03-02' AND DATE '2025-03-02' < c.pay_date),
pri AS (SELECT secid, price_source, published_yield, clean_pct * face / 100.0::DOUBLE + accrued AS price FROM quo JOIN fac USING (secid) JOIN acc USING (secid)),
flo AS (SELECT secid, pay_date, cents / 100.0::DOUBLE AS amount FROM cup WHERE pay_date > DATE '2025-03-02' UNION ALL SELECT secid, pay_date, amount FROM amo WHERE pay_date > DATE '2025-03-02')"""


def _bisect(flows: str, name: str) -> str:
    """Arrays of flows from ``flows`` (secid, pay_date, amount), solved for each price."""
    return f""", arr AS (SELECT secid, list((pay_date - DATE '2025-03-02') / 365.0::DOUBLE ORDER BY pay_date, amount) AS ts, list(amount::DOUBLE ORDER BY pay_date, amount) AS xs FROM {flows} GROUP BY ALL HAVING bool_and(amount IS NOT NULL)),
sol AS (SELECT secid, price_source, price, ts, xs, -0.99::DOUBLE AS lo, 10.0::DOUBLE AS hi, 0 AS i FROM pri JOIN arr USING (secid) WHERE price IS NOT NULL
  UNION ALL SELECT secid, price_source, price, ts, xs, CASE WHEN pv > price THEN (lo + hi) / 2 ELSE lo END, CASE WHEN pv > price THEN hi ELSE (lo + hi) / 2 END, i + 1
  FROM (SELECT *, list_sum(list_transform(range(1, len(ts) + 1), lambda j: xs[j] / pow(1 + (lo + hi) / 2, ts[j]))) AS pv FROM sol WHERE i < 60)),
{name} AS (SELECT secid, price_source, pri.published_yield, round((lo + hi) / 2, 10) AS y, ts, xs FROM pri LEFT JOIN (SELECT * FROM sol WHERE i = 60 AND price <= list_sum(list_transform(range(1, len(ts) + 1), lambda j: xs[j] / pow(0.01, ts[j])))
  AND price >= list_sum(list_transform(range(1, len(ts) + 1), lambda j: xs[j] / pow(11, ts[j])))) s USING (secid, price_source))"""


_YTM = _bisect("flo", "own")
_SIMPLE = _YTM.replace("pow(1 + (lo + hi) / 2, ts[j])", "(1 + (lo + hi) / 2 * ts[j])").replace("pow(0.01, ts[j])", "(1 + greatest(-0.99, -1 / list_max(ts) + 1e-9) * ts[j])").replace("pow(11, ts[j])", "(1 + 10 * ts[j])").replace("-0.99::DOUBLE AS lo", "greatest(-0.99::DOUBLE, -1 / list_max(ts) + 1e-9) AS lo")
_YTP = r""", nof AS (SELECT secid, min(offer_date) AS od, arg_min(coalesce(price_pct, 100), offer_date) AS pct FROM off WHERE offer_date > DATE '2025-03-02' AND {} GROUP BY ALL),
fof AS (SELECT secid, pay_date, amount FROM flo JOIN nof USING (secid) WHERE pay_date <= od
  UNION ALL SELECT secid, od, paid FROM (SELECT nof.secid, od, (1000 - coalesce(sum(amount) FILTER (pay_date <= od), 0)) * pct / 100.0::DOUBLE AS paid FROM nof LEFT JOIN amo USING (secid) GROUP BY nof.secid, od, pct) WHERE paid > 0)""" + _bisect("fof", "own")
_CMP = r""", cmp AS (SELECT secid, price_source, round((y - published_yield) * 10000, 2) AS diff_bp, y, published_yield, secid IN (SELECT secid FROM flo WHERE amount IS NULL) AS unknown,
  secid IN (SELECT secid FROM off WHERE offer_date > DATE '2025-03-02') AS offer FROM own)"""
QUERIES = {f.__name__: f for f in (face_value, accrued_interest, dirty_price, future_flows, ytm, ytm_simple, duration, ytp, ytp_put, current_yield, g_spread, settlement_match, yield_compare, yield_distribution, yield_outliers, year_fractions)}
SQL = {
    "face_value": _B + _STATE + " SELECT secid, face::DOUBLE AS face FROM fac",
    "accrued_interest": _B + _STATE + " SELECT * FROM acc",
    "dirty_price": _B + _STATE + " SELECT secid, price_source, round(price, 6) AS price FROM pri",
    "future_flows": _B + _STATE + " SELECT secid, count(*) AS n, sum(amount::DECIMAL(24,6))::DOUBLE AS total, max(pay_date) AS last, bool_or(amount IS NULL) AS unknown FROM flo GROUP BY ALL",
    "ytm": _B + _STATE + _YTM + " SELECT secid, price_source, round(y, 8) + 0.0::DOUBLE AS ytm FROM own",
    "ytm_simple": _B + _STATE + _SIMPLE + " SELECT secid, price_source, round(y, 7) + 0.0::DOUBLE AS ytm FROM own",
    "duration": _B + _STATE + _YTM + r""", du AS (SELECT *, round(list_sum(list_transform(range(1, len(ts) + 1), lambda j: ts[j] * xs[j] / pow(1 + y, ts[j]))) / list_sum(list_transform(range(1, len(ts) + 1), lambda j: xs[j] / pow(1 + y, ts[j]))), 8) AS years FROM own)
    SELECT secid, price_source, years, round(years / (1 + y), 8) AS modified FROM du""",
    "ytp": _B + _STATE + _YTP.format("true") + " SELECT secid, price_source, round(y, 8) AS ytp FROM own WHERE secid IN (SELECT secid FROM nof)",
    "ytp_put": _B + _STATE + _YTP.format("kind = 'put'") + " SELECT secid, price_source, round(y, 8) AS ytp FROM own WHERE secid IN (SELECT secid FROM nof)",
    "current_yield": _B + _STATE + r""" SELECT secid, price_source, round(round(CASE WHEN bool_or(c.secid IS NOT NULL AND c.cents IS NULL) OR any_value(price) IS NULL THEN NULL ELSE coalesce(sum(c.cents), 0) / 100.0::DOUBLE / any_value(price) END, 8), 6) AS current_yield
    FROM pri LEFT JOIN cup c USING (secid) WHERE c.pay_date IS NULL OR true GROUP BY ALL""".replace("LEFT JOIN cup c USING (secid) WHERE c.pay_date IS NULL OR true", "LEFT JOIN (SELECT * FROM cup WHERE pay_date > DATE '2025-03-02' AND pay_date <= DATE '2025-03-02' + 365) c USING (secid)"),
    "g_spread": _B + r""", cv(x0, y0, x1, y1) AS (VALUES (0.25::DOUBLE, 0.05::DOUBLE, 1.0::DOUBLE, 0.07::DOUBLE), (1.0, 0.07, 2.0, 0.08), (2.0, 0.08, 3.0, 0.085)),
    te AS (SELECT secid, (issue_date + 182 * n - DATE '2025-03-02') / 365.0::DOUBLE AS tenor, rate / 100.0::DOUBLE AS y FROM iss),
    sp AS (SELECT secid, arg_min(round(y - (y0 + (y1 - y0) * (tenor - x0) / (x1 - x0)), 8), x0) AS spread FROM te JOIN cv ON tenor >= x0 AND tenor <= x1 GROUP BY secid)
    SELECT te.secid, spread FROM te LEFT JOIN sp USING (secid)""",
    "settlement_match": _B + r""", day AS (SELECT secid, d, CASE WHEN c.secid IS NULL THEN 0 ELSE (2 * c.cents * (d - c.period_start) + 182) // 364 END AS a
      FROM (SELECT secid, DATE '2025-03-01' + i::INT AS d FROM iss, range(0, 5) t(i)) q LEFT JOIN cup c USING (secid) WHERE c.secid IS NULL OR c.period_start <= d AND d < c.pay_date
      UNION ALL SELECT secid, d, 0 FROM (SELECT secid, DATE '2025-03-01' + i::INT AS d FROM iss, range(0, 5) t(i)) q ANTI JOIN cup c ON c.secid = q.secid AND c.period_start <= d AND d < c.pay_date),
    pub AS (SELECT secid, a AS p FROM day WHERE d = DATE '2025-03-02')
    SELECT secid, count(*) AS n, min(d) AS first FROM day JOIN pub USING (secid) WHERE abs(a - p) <= 1 GROUP BY ALL""",
    "yield_compare": _B + _STATE + _YTM + _CMP + r""" SELECT secid, price_source, round(diff_bp, 1) AS diff_bp, coalesce(abs(diff_bp) > 5, true) AS outlier,
    coalesce(nullif(concat_ws(', ', CASE WHEN unknown THEN 'unknown coupons' END, CASE WHEN offer THEN 'offer before maturity' END, CASE WHEN published_yield IS NULL THEN 'no published yield' WHEN y IS NULL THEN 'no root' END), ''), 'ok') AS note FROM cmp""",
    "yield_distribution": _B + _STATE + _YTM + _CMP + " SELECT price_source, count(diff_bp) AS compared, count(*) - count(diff_bp) AS skipped, round(quantile_cont(abs(diff_bp), 0.5), 1) AS median, round(max(abs(diff_bp)), 1) AS largest, count(*) FILTER (abs(diff_bp) <= 5) AS within, round(quantile_cont(abs(diff_bp), 0.9), 1) AS p90, round(avg(diff_bp), 1) AS mean_bp FROM cmp GROUP BY ALL",
    "year_fractions": _B + r""", yf AS (SELECT secid, CASE WHEN pk % 3 = 0 THEN issue_date + 182 * n ELSE issue_date END AS a, CASE WHEN pk % 3 = 0 THEN issue_date ELSE issue_date + 182 * n END AS b FROM iss),
    sp AS (SELECT *, least(a, b) AS s, greatest(a, b) AS e, least(day(a), 30) AS d1 FROM yf),
    yr AS (SELECT secid, sum(date_diff('day', greatest(s, make_date(y, 1, 1)), least(e, make_date(y + 1, 1, 1))) / date_diff('day', make_date(y, 1, 1), make_date(y + 1, 1, 1))::DOUBLE) AS w FROM sp, LATERAL (SELECT unnest(range(year(s), year(e) + 1)) AS y) GROUP BY secid)
    SELECT secid, round((b - a) / 365.0::DOUBLE, 8) AS act365, round((360 * (year(b) - year(a)) + 30 * (month(b) - month(a)) + (CASE WHEN d1 = 30 AND day(b) = 31 THEN 30 ELSE day(b) END - d1)) / 360.0::DOUBLE, 8) AS thirty,
      round(CASE WHEN b < a THEN -w ELSE w END, 8) AS actact FROM sp JOIN yr USING (secid)""",
    "yield_outliers": _B + _STATE + _YTM + _CMP + " SELECT secid, price_source, round(diff_bp, 1) AS diff_bp FROM cmp WHERE coalesce(abs(diff_bp) > 5, true) ORDER BY abs(diff_bp) DESC NULLS FIRST, secid, price_source LIMIT 20",
}
