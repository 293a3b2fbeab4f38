"""Ledger, bond and report frames derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AMOUNT, QUANTITY = "decimal(24,6)", "decimal(28,10)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def demo_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("int"))
    t, v = F.col("event_type"), F.col("value").cast(AMOUNT)
    kind = F.when(t == "signup", "CASH_IN").when(t == "purchase", "BUY").when(t == "click", "SELL").when(t == "view", "COUPON").otherwise("FEE")
    qty = F.when(t == "purchase", 1 + F.col("k") % 10).when(t == "click", -(1 + F.col("k") % 7)).cast("int")
    amount = F.when(qty.isNotNull(), (-qty * v)).when(t == "error", -F.round(v / 100, 2)).otherwise(v)
    day = F.to_date("ts")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("ev"), "event_id").alias("natural_key"), kind.alias("event_type"), day.alias("trade_date"),
        F.date_add(day, 1).alias("settlement_date"), (F.col("user_id") % 10).cast("int").alias("account_id"),
        F.when(qty.isNotNull(), F.col("k") % 20).cast("int").alias("instrument_id"), qty.cast(QUANTITY).alias("quantity"), F.when(qty.isNotNull(), v.cast(QUANTITY)).alias("price"),
        F.when(t == "error", "BROKER").alias("fee_kind"), amount.cast(AMOUNT).alias("amount"), F.lit("RUB").alias("currency"), F.lit(None).cast(QUANTITY).alias("cost_basis"),
        F.lit(None).cast("long").alias("reverses_id"),
    )


LEDGER_SQL = r"""
e AS (SELECT *, regexp_extract(props, '(\d+)', 1)::INT AS k, value::DECIMAL(24,6) AS v,
  CASE event_type WHEN 'purchase' THEN 1 + regexp_extract(props, '(\d+)', 1)::INT % 10 WHEN 'click' THEN -(1 + regexp_extract(props, '(\d+)', 1)::INT % 7) END AS q FROM events),
ledger AS (SELECT event_id AS id, 'ev' || event_id AS natural_key,
  CASE event_type WHEN 'signup' THEN 'CASH_IN' WHEN 'purchase' THEN 'BUY' WHEN 'click' THEN 'SELL' WHEN 'view' THEN 'COUPON' ELSE 'FEE' END AS event_type,
  ts::DATE AS trade_date, ts::DATE + 1 AS settlement_date, (user_id % 10)::INT AS account_id, CASE WHEN q IS NOT NULL THEN (k % 20)::INT END AS instrument_id,
  q AS quantity, CASE WHEN q IS NOT NULL THEN v END AS price, CASE WHEN event_type = 'error' THEN 'BROKER' END AS fee_kind,
  CASE WHEN q IS NOT NULL THEN (-q * v)::DECIMAL(24,6) WHEN event_type = 'error' THEN (-round((v / 100)::DECIMAL(24,8), 2))::DECIMAL(24,6) ELSE v END AS amount, 'RUB' AS currency FROM e)
"""


def demo_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, pk = table(spark, sf_dir, "part"), F.col("p_partkey")
    start = F.date_sub(F.lit("2025-01-01").cast("date"), (pk % 182).cast("int"))
    n = (2 + pk % 9).cast("int")
    return p.select(F.concat(F.lit("B"), pk).alias("secid"), pk.alias("pk"), F.lit("RUB").alias("currency"), F.lit(1000).cast(AMOUNT).alias("initial_face"), start.alias("issue_date"), n.alias("periods"), F.date_add(start, 182 * n).alias("maturity_date"), (5 + F.col("p_size") % 15).alias("rate"))


def demo_coupons(issues: DataFrame) -> DataFrame:
    x = issues.select("*", F.explode(F.sequence(F.lit(1), F.col("periods"))).alias("i"))
    value = F.round(F.lit(1000).cast(AMOUNT) * F.col("rate") * 182 / 36500, 2).cast(AMOUNT)
    return x.select("secid", F.date_add("issue_date", 182 * (F.col("i") - 1)).alias("period_start"), F.date_add("issue_date", 182 * F.col("i")).alias("pay_date"), F.when((F.col("pk") % 7 == 0) & (2 * F.col("i") > F.col("periods")), None).otherwise(value).alias("amount"), F.col("rate").cast(AMOUNT).alias("rate_pct"))


def demo_amortizations(issues: DataFrame) -> DataFrame:
    part = lambda i, a: F.struct(F.date_add("issue_date", 182 * i).alias("pay_date"), F.lit(a).cast(AMOUNT).alias("amount"))
    n = F.col("periods")
    parts = F.when(F.col("pk") % 5 == 0, F.array(part(F.lit(1), 300), part(n - 1, 300), part(n, 400))).otherwise(F.array(part(n, 1000)))
    return issues.select("secid", "maturity_date", F.explode(parts).alias("p")).select("secid", "p.pay_date", "p.amount", (F.col("p.pay_date") == F.col("maturity_date")).alias("is_maturity"))


def demo_offers(issues: DataFrame) -> DataFrame:
    return issues.where("pk % 4 = 0").select("secid", F.date_add("issue_date", 364).alias("offer_date"), F.when(F.col("pk") % 8 == 0, "put").otherwise("call").alias("kind"), F.when(F.col("pk") % 3 == 0, 100).when(F.col("pk") % 3 == 1, 102.5).cast(AMOUNT).alias("price_pct"))


def demo_quotes(issues: DataFrame) -> DataFrame:
    clean = (90 + F.col("pk") % 20).cast(AMOUNT)
    return issues.select("secid", F.lit("2025-03-01").cast("date").alias("trade_date"), F.explode(F.array(F.struct(F.lit("LAST").alias("s"), clean.alias("c")), F.struct(F.lit("WAPRICE").alias("s"), (clean + 1).alias("c")))).alias("q"), "pk", "rate").select("secid", "trade_date", F.col("q.s").alias("price_source"), F.col("q.c").alias("clean_pct"), F.when(F.col("pk") % 11 != 0, F.col("rate") / 100.0).alias("published_yield"))


BONDS_SQL = r"""
iss AS (SELECT 'B' || p_partkey AS secid, p_partkey AS pk, DATE '2025-01-01' - (p_partkey % 182)::INT AS issue_date, (2 + p_partkey % 9)::INT AS n, 5 + p_size % 15 AS rate FROM part),
cup AS (SELECT secid, issue_date + 182 * (i - 1)::INT AS period_start, issue_date + 182 * i::INT AS pay_date,
  CASE WHEN pk % 7 = 0 AND 2 * i > n THEN NULL ELSE (2 * 100000 * rate * 182 + 36500) // 73000 END AS cents FROM iss, LATERAL (SELECT unnest(range(1, n + 1)) AS i)),
amo AS (SELECT secid, issue_date + 182 * n AS pay_date, CASE WHEN pk % 5 = 0 THEN 400 ELSE 1000 END AS amount FROM iss
  UNION ALL SELECT secid, issue_date + 182, 300 FROM iss WHERE pk % 5 = 0 UNION ALL SELECT secid, issue_date + 182 * (n - 1), 300 FROM iss WHERE pk % 5 = 0),
off AS (SELECT secid, issue_date + 364 AS offer_date, CASE WHEN pk % 8 = 0 THEN 'put' ELSE 'call' END AS kind, CASE pk % 3 WHEN 0 THEN 100 WHEN 1 THEN 102.5 END AS price_pct FROM iss WHERE pk % 4 = 0),
quo AS (SELECT secid, 'LAST' AS price_source, 90 + pk % 20 AS clean_pct, CASE WHEN pk % 11 <> 0 THEN rate / 100.0::DOUBLE END AS published_yield FROM iss
  UNION ALL SELECT secid, 'WAPRICE', 91 + pk % 20, CASE WHEN pk % 11 <> 0 THEN rate / 100.0::DOUBLE END FROM iss),
ask AS (SELECT secid, DATE '2025-03-02' AS on_date FROM iss)
"""
