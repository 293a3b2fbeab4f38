"""Queries over CSV and JSON files that are rendered from the tables: rows, entries, diffs, schedules, boards, instruments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import schedules as S
from tallyforge.operators.identities import resolve_instruments
from tallyforge.operators.imports import as_ledger, import_declared
from tallyforge.operators.staging import joined, staged
from tallyforge.plans.demo import BONDS_SQL, demo_amortizations, demo_coupons, demo_issues, demo_offers, table
from tallyforge.sources.declarative_csv import csv_records, declared_entries, declared_rows, sound_rows
from tallyforge.sources.snapshots import board_quotes, cell

HEADER = "id,account,date,kind,amount,currency,note"
NO_ACCOUNTS, NO_INSTRUMENTS = "account_id long, code string, name string, kind string, currency string", "instrument_id long, ticker string, isin string, name string, kind string, currency string"


def demo_csv(spark: SparkSession, sf_dir: str, newer: bool = False) -> DataFrame:
    """(file, content): cash flows of 500 customers a file; files divisible by 3 have rows of an unknown kind.

    The newer state lacks customers divisible by 11 and pays one more to those divisible
    by 5; it has no unknown kinds.
    """
    k, part = F.col("c_custkey"), F.floor(F.col("c_custkey") / 500)
    kind = F.when(k % 2 == 0, "CASH_IN").otherwise("cash_out")
    if not newer:
        kind = F.when((part % 3 == 0) & (k % 50 == 0), "GIFT").otherwise(kind)
    amount = F.col("c_acctbal").cast("decimal(18,2)") + (F.when(k % 5 == 0, 1).otherwise(0) if newer else F.lit(0))
    line = F.concat(k.cast("string"), F.lit(",A-"), F.col("c_nationkey").cast("string"), F.lit(","), F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), (k % 28).cast("int")), "dd.MM.yyyy"), F.lit(","), kind, F.lit(',"'), F.replace(amount.cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")), F.lit('",,'))
    c = table(spark, sf_dir, "customer")
    if newer:
        c = c.where(k % 11 != 0)
    g = c.groupBy(part.alias("part")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), line.alias("line")))).alias("x"))
    return g.select(F.concat(F.lit("cash_flows_"), F.col("part").cast("string"), F.lit(".csv")).alias("file"), F.concat_ws("\n", F.lit(HEADER), F.transform("x", lambda r: r["line"])).alias("content"))


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = declared_rows(csv_records(demo_csv(spark, sf_dir)))
    return r.select("file", "line", "row_id", "account", "date", "kind", F.col("amount").cast("double").alias("amount"), "currency", F.array_join("problems", "; ").alias("problem"))


def csv_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = declared_entries(sound_rows(declared_rows(csv_records(demo_csv(spark, sf_dir)))))
    return e.select("natural_key", "event_type", "trade_date", "account", F.col("amount").cast("double").alias("amount"), "source_row_id")


def csv_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an import of the newer state appends to a ledger of the older, with their order."""
    old = declared_entries(declared_rows(csv_records(demo_csv(spark, sf_dir))).where("size(problems) = 0 AND CAST(row_id AS long) % 7 <> 0").drop("problems"))
    old = old.withColumns({"id": F.substring_index("source_row_id", ":", -1).cast("long")})
    rows = declared_rows(csv_records(demo_csv(spark, sf_dir, newer=True)))
    done = import_declared(rows, staged(as_ledger(old), "old"), spark.createDataFrame([], NO_ACCOUNTS), spark.createDataFrame([], NO_INSTRUMENTS))
    return done.rows.select("place", "natural_key", "event_type", "source_row_id", F.col("amount").cast("double").alias("amount"), "reverses_id")


def _block(names: tuple[str, ...], rows: Column) -> Column:
    return F.struct(F.array(*[F.lit(n) for n in names]).alias("columns"), rows.alias("data"))


def _text(*cells) -> Column:
    return F.array(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in cells])


def demo_answers(spark: SparkSession, sf_dir: str, units: bool = False) -> tuple[DataFrame, DataFrame]:
    """With ``units``, payments tell their currency, a wrong one in the coupons of issues divisible by 17 and in amortizations of those by 25. (secid, content) of descriptions and of payments. Issues divisible by 13 have no face value; only those divisible by 5 list amortizations."""
    i = demo_issues(spark, sf_dir)
    face = F.when(F.col("pk") % 13 != 0, F.col("initial_face").cast("decimal(18,2)"))
    d = F.array(_text("SECID", F.col("secid")), _text("FACEUNIT", "SUR"), _text("INITIALFACEVALUE", face), _text("MATDATE", F.col("maturity_date")))
    securities = i.select("secid", F.to_json(F.struct(_block(("name", "value"), d).alias("description")), {"ignoreNullFields": "false"}).alias("content"))
    rows = lambda df, row: df.groupBy("secid").agg(F.collect_list(row).alias("data"))
    c = rows(demo_coupons(i), _text(F.col("period_start"), F.col("pay_date"), F.coalesce(F.col("amount"), F.lit(0)), F.col("rate_pct"))).withColumnRenamed("data", "c")
    a = rows(demo_amortizations(i.where("pk % 5 = 0")), _text(F.col("pay_date"), F.col("amount"))).withColumnRenamed("data", "a")
    o = rows(demo_offers(i), _text(F.col("offer_date"), "Оферта", F.col("price_pct"))).withColumnRenamed("data", "o")
    if units:
        told = lambda name, n, unit: F.transform(name, lambda r: F.concat(r, F.array(F.when(F.substring("secid", 2, 20).cast("long") % n == 0, unit).otherwise("SUR"))))
        c, a = c.withColumn("c", told("c", 17, "USD")), a.withColumn("a", told("a", 25, "CNY"))
    more = ("faceunit",) if units else ()
    x = joined(joined(joined(i.select("secid"), c, "secid", "left"), a, "secid", "left"), o, "secid", "left")
    none = F.array().cast("array<array<string>>")
    blocks = F.struct(_block(("startdate", "coupondate", "value", "valueprc", *more), F.coalesce("c", none)).alias("coupons"), _block(("amortdate", "value", *more), F.coalesce("a", none)).alias("amortizations"), _block(("offerdate", "offertype", "price"), F.coalesce("o", none)).alias("offers"))
    return staged(securities, "securities"), staged(x.select("secid", F.to_json(blocks, {"ignoreNullFields": "false"}).alias("content")), "bondization")


def schedule_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.schedules(*demo_answers(spark, sf_dir))
    x = s["issues"].select("secid", "currency", F.col("initial_face").cast("double").alias("initial_face"), "maturity_date", F.lit(None).cast("string").alias("reason"))
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    return x.unionByName(s["rejects"].select("secid", none("string", "currency"), none("double", "initial_face"), none("date", "maturity_date"), "reason"))


def schedule_currencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.schedules(*demo_answers(spark, sf_dir, units=True))
    return s["rejects"].select("secid", "reason")


def schedule_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.schedules(*demo_answers(spark, sf_dir))
    c = s["coupons"].select("secid", F.lit("coupon").alias("kind"), "pay_date", F.col("amount").cast("double").alias("amount"))
    a = s["amortizations"].select("secid", F.when(F.col("is_maturity"), "maturity").otherwise("amortization").alias("kind"), "pay_date", F.col("amount").cast("double").alias("amount"))
    return c.unionByName(a).unionByName(s["offers"].select("secid", "kind", F.col("offer_date").alias("pay_date"), F.col("price_pct").cast("double").alias("amount")))


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards of 500 parts each, market prices for parts not divisible by 3."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    static, live = _text(k, F.col("p_size"), "N"), _text(k, F.col("p_size") + 1, F.col("p_brand"))
    g = p.groupBy(F.floor(k / 500).cast("string").alias("board")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), static.alias("s"), F.when(k % 3 != 0, live).alias("m")))).alias("x"))
    blocks = F.struct(_block(("SECID", "PRICE", "STATUS"), F.transform("x", lambda r: r["s"])).alias("securities"), _block(("SECID", "PRICE", "LAST"), F.filter(F.transform("x", lambda r: r["m"]), lambda m: m.isNotNull())).alias("marketdata"))
    q = board_quotes(g.select("board", F.to_json(blocks).alias("content")))
    return q.select("board", "secid", "pos", cell("PRICE").alias("price"), cell("STATUS").alias("status"), cell("LAST").alias("last_price"))


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments that order lines mention, some by ticker, some by ISIN, some by both."""
    n, k = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    isin = F.concat(F.lit("RU"), F.lpad(k, 9, "0"), (F.col("l_partkey") % 10).cast("string"))
    m = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("seq"), F.when(n % 3 != 0, F.concat(F.lit("t"), k)).alias("ticker"), F.when(n % 2 != 0, isin).alias("isin"), F.lit(None).cast("string").alias("name"), F.lit("RUB").alias("currency"))
    return resolve_instruments(m, spark.createDataFrame([], NO_INSTRUMENTS))[1].select("instrument_id", "ticker", "isin", "kind")


_CSV = """c AS (SELECT *, c_custkey AS k, c_custkey // 500 AS part, 'cash_flows_' || (c_custkey // 500) || '.csv' AS file, DATE '2025-01-01' + (c_custkey % 28)::INT AS day, c_acctbal::DECIMAL(18,2)::DOUBLE AS amt,
  (c_custkey // 500) % 3 = 0 AND c_custkey % 50 = 0 AS gift, CASE WHEN c_custkey % 2 = 0 THEN 'CASH_IN' ELSE 'CASH_OUT' END AS usual, row_number() OVER (PARTITION BY c_custkey // 500 ORDER BY c_custkey) + 1 AS line FROM customer)"""
_KEY = "substr(sha256('k1|csv|A-' || c_nationkey || '|' || day || '|' || usual || '||cash_flows:' || k), 1, 40)"
_SIGNED = "CASE WHEN usual = 'CASH_OUT' THEN -abs({0}) ELSE {0} END"
_NEW = "(c_acctbal::DECIMAL(18,2) + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END)::DOUBLE"

QUERIES = {"csv_rows": csv_rows, "csv_entries": csv_entries, "csv_import": csv_import, "schedule_issues": schedule_issues, "schedule_currencies": schedule_currencies, "schedule_payments": schedule_payments, "board_quotes": board, "resolve_instruments": instruments}
SQL = {
    "csv_rows": f"""WITH {_CSV} SELECT file, line, k::VARCHAR AS row_id, 'A-' || c_nationkey AS account, day AS date, CASE WHEN gift THEN 'GIFT' ELSE usual END AS kind, amt AS amount, 'RUB' AS currency,
  CASE WHEN gift THEN 'line ' || line || ', field kind: GIFT' ELSE '' END AS problem FROM c""",
    "csv_entries": f"""WITH {_CSV} SELECT {_KEY} AS natural_key, usual AS event_type, day AS trade_date, 'A-' || c_nationkey AS account, {_SIGNED.format("amt")} AS amount, 'cash_flows:' || k AS source_row_id
FROM c WHERE file NOT IN (SELECT file FROM c WHERE gift)""",
    "csv_import": f"""WITH {_CSV},
x AS (SELECT *, NOT gift AND k % 7 <> 0 AS old, k % 11 <> 0 AS new, {_SIGNED.format("amt")} AS a, {_SIGNED.format(_NEW)} AS b, {_KEY} AS key FROM c)
SELECT 0 AS place, 'reversal:' || key AS natural_key, usual AS event_type, 'cash_flows:' || k AS source_row_id, -a AS amount, k AS reverses_id FROM x WHERE old AND (NOT new OR a <> b)
UNION ALL SELECT CASE WHEN old THEN 1 ELSE 2 END, CASE WHEN old THEN key || ':r1' ELSE key END, usual, 'cash_flows:' || k, b, NULL FROM x WHERE new AND (NOT old OR a <> b)""",
    "schedule_issues": f"""WITH {BONDS_SQL} SELECT secid, CASE WHEN pk % 13 <> 0 THEN 'RUB' END AS currency, CASE WHEN pk % 13 <> 0 THEN 1000::DOUBLE END AS initial_face, CASE WHEN pk % 13 <> 0 THEN issue_date + 182 * n END AS maturity_date,
  CASE WHEN pk % 13 = 0 THEN 'no face value' END AS reason FROM iss""",
    "schedule_currencies": f"""WITH {BONDS_SQL} SELECT secid, CASE WHEN pk % 13 = 0 THEN 'no face value' ELSE 'a payment is in another currency' END AS reason FROM iss WHERE pk % 13 = 0 OR pk % 17 = 0 OR pk % 25 = 0""",
    "schedule_payments": f"""WITH {BONDS_SQL}, good AS (SELECT secid, issue_date + 182 * n AS ends FROM iss WHERE pk % 13 <> 0)
SELECT secid, 'coupon' AS kind, pay_date, cents / 100.0::DOUBLE AS amount FROM cup JOIN good USING (secid)
UNION ALL SELECT secid, CASE WHEN pay_date = ends THEN 'maturity' ELSE 'amortization' END, pay_date, amount::DOUBLE FROM amo JOIN good USING (secid)
UNION ALL SELECT secid, 'put', offer_date, price_pct::DOUBLE FROM off JOIN good USING (secid)""",
    "board_quotes": """SELECT (p_partkey // 500)::VARCHAR AS board, p_partkey::VARCHAR AS secid, row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) - 1 AS pos, (p_size + CASE WHEN p_partkey % 3 <> 0 THEN 1 ELSE 0 END)::VARCHAR AS price,
  'N' AS status, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS last_price FROM part""",
    "resolve_instruments": """WITH m AS (SELECT l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_linenumber % 3 <> 0 THEN 'T' || l_partkey END AS ticker, CASE WHEN l_linenumber % 2 <> 0 THEN 'RU' || lpad(l_partkey::VARCHAR, 9, '0') || (l_partkey % 10) END AS isin, l_partkey AS k FROM lineitem),
l AS (SELECT k, min(isin) AS its FROM m WHERE ticker IS NOT NULL AND isin IS NOT NULL GROUP BY k),
r AS (SELECT seq, ticker, isin, CASE WHEN coalesce(isin, its) IS NOT NULL THEN 'I' || coalesce(isin, its) ELSE 'T' || ticker END AS ref FROM m LEFT JOIN l USING (k) WHERE ticker IS NOT NULL OR isin IS NOT NULL),
g AS (SELECT ref, min(ticker) AS ticker, min(isin) AS isin, min(seq) AS seq FROM r GROUP BY ref)
SELECT row_number() OVER (ORDER BY seq, ref) AS instrument_id, ticker, isin, CASE WHEN ticker IS NOT NULL THEN 'share' ELSE 'other' END AS kind FROM g""",
}
