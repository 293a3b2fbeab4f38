"""Statement queries: events rendered as HTML statements by user and day, read back and mapped, with SQL on the events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions import cleaning as c
from tallyforge.operators import imports as I
from tallyforge.operators import statement_rows as R
from tallyforge.operators.staging import staged
from tallyforge.plans.demo import table
from tallyforge.sources.statements import statements


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *[F.coalesce(x, F.lit("")) for x in cells]), F.lit("</td></tr>"))


def _table(title: str, headers: tuple[str, ...], rows: Column) -> Column:
    head = "".join(f"<th>{h}</th>" for h in headers)
    return F.when(F.size(rows) > 0, F.concat(F.lit(f"<div><h2>{title}</h2><table><tr>{head}</tr>"), F.array_join(rows, ""), F.lit("<tr><td>Итого</td></tr></table></div>"))).otherwise("")


def demo_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report, content): one HTML statement per user and day."""
    e = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("int"))
    cents = F.floor(F.col("value") * 100).cast("long")
    e = e.withColumns({"day": F.to_date("ts"), "cents": cents}).where(F.col("event_type").isNotNull())
    money = lambda x: c.format_decimal((x.cast("decimal(20,0)") / 100).cast("decimal(18,2)"), 2)
    day, trade = F.date_format("day", "dd.MM.yyyy"), F.col("event_type").isin("purchase", "click")
    side = F.when(F.col("event_type") == "purchase", "Покупка").otherwise("Продажа")
    fee = F.when(F.col("k") % 3 == 0, money(F.col("cents") % 300))
    deal = _row(F.col("event_id").cast("string"), day, F.concat(F.lit("T"), F.col("k") % 20), side, (1 + F.col("k") % 10).cast("string"), money(F.col("cents")), fee)
    said = F.when(F.col("event_type") == "view", "Выплата купона").when(F.col("event_type") == "signup", "Пополнение счета").otherwise("Комиссия брокера")
    income = F.col("event_type").isin("view", "signup")
    tax = F.when((F.col("event_type") == "view") & (F.col("k") % 4 == 0), money(F.col("cents") % 500))
    move = _row(day, said, F.when(income, money(F.col("cents"))), F.when(~income, money(F.col("cents"))), tax)
    e = e.select("user_id", "day", "event_id", trade.alias("trade"), F.when(trade, deal).otherwise(move).alias("line"))
    g = e.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("event_id", "trade", "line"))).alias("x"))
    lines = lambda flag: F.transform(F.filter("x", lambda r: r["trade"] == flag), lambda r: r["line"])
    body = F.concat(
        F.lit("<html><body><p>Отчет брокера с "), F.date_format("day", "dd.MM.yyyy"), F.lit(" по "), F.date_format("day", "dd.MM.yyyy"), F.lit(", договор № U-"), F.col("user_id").cast("string"), F.lit("</p>"),
        _table("Сделки с ценными бумагами", ("Номер сделки", "Дата заключения", "Тикер", "Вид сделки", "Количество", "Цена", "Комиссия брокера"), lines(True)),
        _table("Движение денежных средств", ("Дата", "Описание операции", "Зачислено", "Списано", "Налог"), lines(False)), F.lit("</body></html>"),
    )
    return g.select(F.concat_ws("-", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("report"), body.alias("content"))


def controlled_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements with control totals of cash and securities at the day's end. Users divisible by 7 are told one too much cash, those divisible by 11 no securities."""
    e = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("int")).where(F.col("event_type").isNotNull())
    cents, n = F.floor(F.col("value") * 100).cast("long"), (1 + F.col("k") % 10).cast("long")
    t, fee = F.col("event_type"), F.when(F.col("k") % 3 == 0, F.floor(F.col("value") * 100).cast("long") % 300).otherwise(0)
    moved = F.when(t == "purchase", -n * cents - fee).when(t == "click", n * cents - fee).when(t.isin("view", "signup"), cents).otherwise(-cents)
    held = F.when(t == "purchase", n).when(t == "click", -n)
    e = e.select("user_id", F.to_date("ts").alias("day"), moved.alias("moved"), held.alias("held"), F.when(held.isNotNull(), F.col("k") % 20).cast("int").alias("ticker"))
    run = lambda c, *by: F.sum(c).over(W.partitionBy(*by).orderBy("day"))
    cash = e.groupBy("user_id", "day").agg(F.sum("moved").alias("moved")).select("user_id", "day", run("moved", "user_id").alias("cash"))
    sums = e.where("ticker IS NOT NULL").groupBy("user_id", "day", "ticker").agg(F.sum("held").alias("held"))
    grid = cash.select("user_id", "day").join(sums.select("user_id", "ticker").distinct(), "user_id").join(sums, ["user_id", "day", "ticker"], "left")
    left = grid.select("user_id", "day", "ticker", run(F.coalesce("held", F.lit(0)), "user_id", "ticker").alias("held")).where("held <> 0")
    lines = left.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("ticker", _row(F.concat(F.lit("T"), "ticker"), F.col("held").cast("string")).alias("line")))).alias("s"))
    money = c.format_decimal(((F.col("cash") + F.when(F.col("user_id") % 7 == 0, 100).otherwise(0)).cast("decimal(20,0)") / 100).cast("decimal(18,2)"), 2)
    totals = cash.join(lines, ["user_id", "day"], "left").select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("report"),
        F.concat(
            _table("Остатки денежных средств", ("Валюта", "Исходящий остаток"), F.array(_row(F.lit("RUB"), money))),
            F.when(F.col("s").isNull() | (F.col("user_id") % 11 == 0), "").otherwise(_table("Портфель по ценным бумагам", ("Тикер", "Исходящий остаток"), F.transform("s", lambda r: r["line"]))),
        ).alias("totals"),
    )
    return demo_statements(spark, sf_dir).join(totals, "report").select("report", F.replace("content", F.lit("</body>"), F.concat("totals", F.lit("</body>"))).alias("content"))


def statement_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = staged(statements(controlled_statements(spark, sf_dir), "report", "content"), "parsed")
    b = R.statement_balances(R.mapped_rows(R.table_rows(parsed)), R.statement_headers(parsed))
    return b.select("report", "kind", "ticker", F.col("quantity").cast("double").alias("quantity"), F.when(F.col("kind") == "cash", F.col("currency")).alias("currency"), "as_of")


def import_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import into an empty ledger: which statements are committed, with how many rows, and how many totals differ by how much cash."""
    parsed = staged(statements(controlled_statements(spark, sf_dir), "report", "content"), "parsed")
    # tables that Spark knows to be empty, so that nothing is dealt out to meet them
    empty = lambda **columns: spark.range(1).where("false").select(*[F.lit(None).cast(kind).alias(name) for name, kind in columns.items()])
    texts = {x: "string" for x in ("name", "kind", "currency")}
    ledger, accounts, instruments = empty(**I.LEDGER), empty(account_id="long", code="string", **texts), empty(instrument_id="long", ticker="string", isin="string", **texts)
    done = I.import_statements(parsed, ledger, accounts, instruments)
    rows = done.rows.groupBy(F.col("source_report").alias("report")).agg(F.count("*").alias("taken"))
    off = done.discrepancies.groupBy(F.col("report_id").alias("report")).agg(F.count("*").alias("differ"), F.sum(F.when(F.col("kind") == "cash", F.col("difference"))).cast("double").alias("cash_off"))
    x = done.reports.join(rows, "report", "left").join(off, "report", "left")
    return x.select("report", "period_end", "committed", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("differ", F.lit(0)).alias("differ"), "cash_off")


def statement_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = R.statement_operations(R.mapped_rows(R.table_rows(statements(demo_statements(spark, sf_dir), "report", "content"))))
    d = lambda x: F.col(x).cast("double").alias(x)
    return ops.select("report", "kind", "trade_date", "ticker", d("quantity"), d("price"), d("fee"), "fee_kind", d("amount"), "currency", "broker_trade_no", "withheld_at_source")


def statement_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.statement_headers(statements(demo_statements(spark, sf_dir), "report", "content"))


_EVENTS = r"""e AS (SELECT *, regexp_extract(props, '(\d+)', 1)::INT AS k, floor(value * 100)::BIGINT AS cents, ts::DATE AS day,
  concat_ws('-', user_id::VARCHAR, (ts::DATE)::VARCHAR) AS report FROM events WHERE event_type IS NOT NULL)"""

_TOTALS = rf"""WITH {_EVENTS},
x AS (SELECT report, user_id, day, CASE event_type WHEN 'purchase' THEN 1 + k % 10 WHEN 'click' THEN -(1 + k % 10) END AS q, (k % 20)::INT AS ticker, CASE WHEN k % 3 = 0 THEN cents % 300 ELSE 0 END AS fee, cents, event_type,
  CASE WHEN event_type IN ('purchase', 'click') THEN 1 + (k % 3 = 0 AND cents % 300 <> 0)::INT ELSE 1 + (event_type = 'view' AND k % 4 = 0 AND cents % 500 <> 0)::INT END AS n FROM e),
dy AS (SELECT report, user_id, day, sum(n)::BIGINT AS n, sum(CASE WHEN q IS NOT NULL THEN -q * cents - fee WHEN event_type IN ('view', 'signup') THEN cents ELSE -cents END) AS moved FROM x GROUP BY ALL),
ud AS (SELECT report, user_id, day, n, sum(moved) OVER (PARTITION BY user_id ORDER BY day) AS cash FROM dy),
held AS (SELECT ud.report, ud.user_id, ud.day, x.ticker, sum(x.q) AS held FROM ud JOIN x ON x.user_id = ud.user_id AND x.day <= ud.day AND x.q IS NOT NULL GROUP BY ALL HAVING sum(x.q) <> 0)
"""

QUERIES = {f.__name__: f for f in (statement_operations, statement_headers, statement_balances, import_reports)}
SQL = {
    "statement_operations": f"""
WITH {_EVENTS},
t AS (SELECT *, event_type = 'purchase' AS buys, 1 + k % 10 AS q, CASE WHEN k % 3 = 0 THEN cents % 300 ELSE 0 END AS fc FROM e WHERE event_type IN ('purchase', 'click')),
m AS (SELECT *, CASE WHEN event_type = 'view' AND k % 4 = 0 THEN cents % 500 ELSE 0 END AS tc FROM e WHERE event_type NOT IN ('purchase', 'click'))
SELECT report, CASE WHEN buys THEN 'BUY' ELSE 'SELL' END AS kind, day AS trade_date, 'T' || (k % 20) AS ticker, (CASE WHEN buys THEN q ELSE -q END)::DOUBLE AS quantity, cents / 100.0::DOUBLE AS price,
  CASE WHEN fc <> 0 THEN fc / 100.0::DOUBLE END AS fee, NULL::VARCHAR AS fee_kind, (CASE WHEN buys THEN -1 ELSE 1 END) * q * cents / 100.0::DOUBLE AS amount, 'RUB' AS currency, event_id::VARCHAR AS broker_trade_no, NULL::BOOLEAN AS withheld_at_source FROM t
UNION ALL SELECT report, 'FEE', day, 'T' || (k % 20), NULL, NULL, NULL, 'BROKER', -fc / 100.0::DOUBLE, 'RUB', event_id::VARCHAR, NULL FROM t WHERE fc <> 0
UNION ALL SELECT report, CASE event_type WHEN 'view' THEN 'COUPON' WHEN 'signup' THEN 'CASH_IN' ELSE 'FEE' END, day, NULL, NULL, NULL, NULL, CASE WHEN event_type NOT IN ('view', 'signup') THEN 'BROKER' END,
  CASE WHEN event_type IN ('view', 'signup') THEN (cents + tc) / 100.0::DOUBLE ELSE -cents / 100.0::DOUBLE END, 'RUB', NULL, CASE WHEN event_type = 'view' AND k % 4 = 0 THEN false END FROM m
UNION ALL SELECT report, 'TAX', day, NULL, NULL, NULL, NULL, NULL, -tc / 100.0::DOUBLE, 'RUB', NULL, true FROM m WHERE tc <> 0
""",
    "statement_headers": f"WITH {_EVENTS} SELECT DISTINCT report, day AS period_start, day AS period_end, 'U-' || user_id::VARCHAR AS account_code FROM e",
    "statement_balances": _TOTALS + """SELECT report, 'cash' AS kind, NULL AS ticker, (cash + CASE WHEN user_id % 7 = 0 THEN 100 ELSE 0 END) / 100.0::DOUBLE AS quantity, 'RUB' AS currency, day AS as_of FROM ud
UNION ALL SELECT report, 'security', 'T' || ticker, held::DOUBLE, NULL, day FROM held WHERE user_id % 11 <> 0""",
    "import_reports": _TOTALS + """, h AS (SELECT report, count(*) AS m FROM held WHERE user_id % 11 = 0 GROUP BY 1)
SELECT report, day AS period_end, user_id % 7 <> 0 AND m IS NULL AS committed, CASE WHEN user_id % 7 <> 0 AND m IS NULL THEN n ELSE 0 END AS taken, coalesce(m, 0) + (user_id % 7 = 0)::INT AS differ, CASE WHEN user_id % 7 = 0 THEN -1.0::DOUBLE END AS cash_off FROM ud LEFT JOIN h USING (report)""",
}
