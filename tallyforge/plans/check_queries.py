"""Queries of the whole check, the inbox and whole boards, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import bonds as B
from tallyforge.operators import checks as K
from tallyforge.operators import ledger as L
from tallyforge.operators import statement_rows as R
from tallyforge.operators import verification as V
from tallyforge.operators.imports import actual_totals
from tallyforge.plans import demo
from tallyforge.plans.ledger_queries import with_reversals
from tallyforge.plans.statement_queries import demo_statements
from tallyforge.sources.statements import statements

D = lambda x: F.col(x).cast("double").alias(x)


def _troubled(spark, d):
    """The ledger with reversals, repeated keys and bad currencies."""
    x = with_reversals(spark, d)
    key = F.concat(F.lit("d"), F.col("id") - F.when(F.col("id") % 97 == 0, 1).otherwise(0))
    bad = F.when(F.col("id") % 101 == 0, "").when(F.col("id") % 103 == 0, "RUBL").otherwise(F.col("currency"))
    return x.withColumns({"natural_key": key, "currency": bad, "account_id": F.col("account_id").cast("long"), "instrument_id": F.col("instrument_id").cast("long")})


def _reports(ledger):
    weeks = F.explode(F.sequence(F.lit(1), F.lit(4))).alias("w")
    x = ledger.select("account_id").distinct().select("account_id", weeks)
    return x.select(F.concat(F.lit("a"), "account_id", F.lit("w"), "w").alias("report_id"), "account_id", "w", F.date_add(F.lit("2024-01-01").cast("date"), F.col("w") * 7).alias("as_of"))


def _checked(spark, d):
    x = _troubled(spark, d)
    reports = _reports(x)
    told = actual_totals(x, reports).join(reports.select("report_id", "account_id", "w"), "report_id")
    code = (F.col("account_id") + F.col("w") + F.length("key") + F.coalesce(F.col("key").try_cast("int"), F.lit(0))) % 5
    told = told.where(code != 1).withColumn("quantity", F.when(code == 0, F.col("quantity") + 1).otherwise(F.col("quantity")).cast("decimal(28,10)"))
    return K.check(x, reports, told.select("report_id", "kind", "key", "quantity")), reports


def check(spark, d):
    return _checked(spark, d)[0].select("kind", "source", "subject", "detail", D("difference"))


def _odd_statements(spark, d):
    """Statements whose fees of every fifth kind have a description that no phrase fits."""
    x = demo_statements(spark, d)
    return statements(x.withColumn("content", F.replace("content", F.lit("Комиссия брокера</td><td></td>"), F.lit("Прочее</td><td></td>"))), "report", "content")


def statement_unparsed(spark, d):
    x = R.unparsed_rows(R.mapped_rows(R.table_rows(_odd_statements(spark, d))))
    return x.groupBy("report").agg(F.count("*").alias("n"))


def inbox_all(spark, d):
    checked, reports = _checked(spark, d)
    gone = reports.where((F.col("account_id") + F.col("w")) % 9 == 0).select(F.col("report_id").alias("report"))
    odd = R.unparsed_rows(R.mapped_rows(R.table_rows(_odd_statements(spark, d))))
    x = K.inbox(checked, gone, odd)
    return x.groupBy("kind", "source").agg(F.count("*").alias("n"))


def report_accounts(spark, d):
    x = demo.demo_ledger(spark, d).withColumn("source_report", F.when(F.col("id") % 11 != 0, F.concat(F.lit("r"), F.col("id") % 50)))
    reports = spark.range(60).select(F.concat(F.lit("r"), "id").alias("source_report"))
    return K.report_accounts(x, reports).select("source_report", "first_id", F.col("account_id").cast("long").alias("account_id"))


def unknown_types(spark, d):
    x = demo.demo_ledger(spark, d).withColumn("event_type", F.when(F.col("id") % 37 == 0, "GIFT").when(F.col("id") % 41 == 0, None).otherwise(F.col("event_type")))
    known, unknown = L.split_unknown_types(x)
    return known.select("event_type", F.lit(True).alias("known")).unionByName(unknown.select("event_type", F.lit(False).alias("known"))).groupBy("event_type", "known").agg(F.count("*").alias("n"))


def unbalanced_reports(spark, d):
    """Each account and week as a report: cash before it, cash in it, and cash after it, which every seventh report tells wrong."""
    x = demo.demo_ledger(spark, d).withColumn("w", F.floor(F.datediff("settlement_date", F.lit("2024-01-01").cast("date")) / 7).cast("long"))
    moved = x.groupBy("account_id", "w").agg(F.sum("amount").alias("quantity"))
    from pyspark.sql import Window as W

    run = F.sum("quantity").over(W.partitionBy("account_id").orderBy("w"))
    b = moved.withColumn("after", run).withColumn("report", F.concat(F.lit("a"), "account_id", F.lit("w"), "w")).withColumn("key", F.lit("RUB"))
    wrong = F.when((F.col("account_id") + F.col("w")) % 7 == 0, 1).otherwise(0)
    out = K.unbalanced_reports(b.select("report", "key", (F.col("after") - F.col("quantity")).alias("quantity")), b.select("report", "key", "quantity"), b.select("report", "key", (F.col("after") + wrong).alias("quantity")))
    return out.select("report", D("opening"), D("moved"), D("closing"))


def _board(spark, d):
    issues = demo.demo_issues(spark, d).withColumn("currency", F.when(F.col("pk") % 19 == 0, "USD").otherwise(F.col("currency")))
    coupons, amortizations, offers = demo.demo_coupons(issues), demo.demo_amortizations(issues), demo.demo_offers(issues)
    days = issues.select("secid", "pk", "rate", F.lit("2025-03-01").cast("date").alias("trade_date"))
    told = B.accrued_interest(days.select("secid", "pk", "rate", "trade_date", F.date_add("trade_date", (F.col("pk") % 3).cast("int")).alias("on_date")), coupons)
    accrued = F.when(F.col("pk") % 17 != 0, F.col("accrued") + F.when(F.col("pk") % 13 == 0, 5).otherwise(0)).cast("decimal(24,6)")
    clean = 90 + F.col("pk") % 20
    prices = F.array(*[F.struct(F.lit(n).alias("n"), p.cast("decimal(24,6)").alias("p")) for n, p in (("PREVWAPRICE", clean - 1), ("WAPRICE", F.when(F.col("pk") % 6 != 0, clean + 1)), ("LAST", clean))])
    q = told.select("secid", "trade_date", accrued.alias("published_accrued"), F.when(F.col("pk") % 11 != 0, F.col("rate") / 100.0).alias("published_yield"), (F.col("pk") % 900 + 30).cast("int").alias("published_duration"), F.explode(prices).alias("q"))
    q = q.select("secid", "trade_date", "published_accrued", "published_yield", "published_duration", F.col("q.n").alias("price_source"), F.col("q.p").alias("clean_pct"))
    return V.verify_board(q, issues, coupons, amortizations, offers)


def verify_board(spark, d):
    return _board(spark, d).select(
        "secid", "price_source", (F.round("own_yield", 7) + 0.0).alias("own_yield"), F.round("own_yield_to_offer", 7).alias("own_yield_to_offer"), F.round("diff_bp", 1).alias("diff_bp"),
        F.round("diff_to_offer_bp", 1).alias("diff_to_offer_bp"), D("own_accrued"), D("published_accrued"), "settled", F.col("own_duration").cast("long").alias("own_duration"), "outlier", "note",
    )


def board_distribution(spark, d):
    x = B.distribution(_board(spark, d))
    return x.select("price_source", "compared", "skipped", "within", *[F.round(c, 1).alias(c) for c in ("median", "p90", "largest", "mean_bp")])


_TROUBLED = r"""rv AS (SELECT id + 1000000000 AS id, CASE WHEN id % 400 = 0 THEN -1 ELSE id END AS reverses_id, event_type, trade_date, settlement_date, account_id, instrument_id, -quantity AS quantity, -amount + CASE WHEN id % 150 = 0 THEN 1 ELSE 0 END AS amount FROM ledger WHERE id % 50 = 0),
al AS (SELECT *, 'd' || (id - CASE WHEN id % 97 = 0 THEN 1 ELSE 0 END) AS natural_key, CASE WHEN id % 101 = 0 THEN '' WHEN id % 103 = 0 THEN 'RUBL' ELSE 'RUB' END AS currency
  FROM (SELECT id, NULL::BIGINT AS reverses_id, event_type, trade_date, settlement_date, account_id, instrument_id, quantity, amount FROM ledger UNION ALL SELECT id, reverses_id, event_type, trade_date, settlement_date, account_id, instrument_id, quantity, amount FROM rv)),
rp AS (SELECT 'a' || account_id || 'w' || w AS report_id, account_id, w, DATE '2024-01-01' + (7 * w)::INT AS as_of FROM (SELECT DISTINCT account_id FROM al), range(1, 5) t(w)),
act AS (SELECT report_id, rp.account_id, w, 'cash' AS kind, k.currency AS key, coalesce(sum(amount) FILTER (settlement_date <= as_of), 0) AS q FROM rp JOIN (SELECT DISTINCT account_id, currency FROM al) k USING (account_id) JOIN al ON al.account_id = rp.account_id AND al.currency = k.currency GROUP BY ALL
  UNION ALL SELECT report_id, rp.account_id, w, 'security', instrument_id::VARCHAR, coalesce(sum(quantity) FILTER (trade_date <= as_of), 0) FROM rp JOIN al USING (account_id) WHERE event_type IN ('BUY', 'SELL') GROUP BY ALL),
cd AS (SELECT *, (account_id + w + length(key) + coalesce(try_cast(key AS INT), 0)) % 5 AS code FROM act),
ds AS (SELECT 'discrepancy' AS kind, report_id AS source, kind || ':' || key AS subject, NULL::VARCHAR AS detail, CASE WHEN code = 0 THEN -1 ELSE q END::DOUBLE AS difference FROM cd WHERE code = 0 OR code = 1 AND q <> 0),
iv AS (SELECT 'negative position' AS source, account_id || ':' || instrument_id AS subject, min(trade_date)::VARCHAR AS detail FROM (SELECT *, sum(s) OVER (PARTITION BY account_id, instrument_id ORDER BY trade_date) AS q FROM (
    SELECT account_id, instrument_id, trade_date, sum(quantity) AS s FROM al WHERE event_type IN ('BUY', 'SELL') GROUP BY ALL)) WHERE q < 0 GROUP BY account_id, instrument_id
  UNION ALL SELECT 'reversal', r.id::VARCHAR, 'missing' FROM rv r ANTI JOIN al o ON r.reverses_id = o.id
  UNION ALL SELECT 'reversal', r.id::VARCHAR, 'amount' FROM rv r JOIN al o ON r.reverses_id = o.id WHERE r.amount + o.amount <> 0
  UNION ALL SELECT 'reversal', r.id::VARCHAR, 'quantity' FROM rv r JOIN al o ON r.reverses_id = o.id WHERE coalesce(r.quantity, 0) + coalesce(o.quantity, 0) <> 0
  UNION ALL SELECT 'repeated key', natural_key, count(*)::VARCHAR FROM al GROUP BY natural_key HAVING count(*) > 1
  UNION ALL SELECT 'currency', id::VARCHAR, currency FROM al WHERE length(currency) <> 3),
ck AS (SELECT * FROM ds UNION ALL SELECT 'invariant', source, subject, detail, NULL FROM iv)"""
_ODD = r"""od AS (SELECT concat_ws('-', user_id::VARCHAR, (ts::DATE)::VARCHAR) AS report, count(*) AS n FROM events WHERE event_type NOT IN ('purchase', 'click', 'view', 'signup') GROUP BY ALL)"""
_BOARD = r""", day AS (SELECT iss.secid, DATE '2025-03-01' + i::INT AS d FROM iss, range(0, 5) t(i)),
dac AS (SELECT day.secid, d, CASE WHEN c.secid IS NULL THEN 0 ELSE (2 * c.cents * (d - c.period_start) + 182) // 364 END AS a FROM day LEFT JOIN cup c ON c.secid = day.secid AND c.period_start <= d AND d < c.pay_date),
pub AS (SELECT iss.secid, CASE WHEN pk % 17 <> 0 THEN a + CASE WHEN pk % 13 = 0 THEN 500 ELSE 0 END END AS p FROM iss JOIN dac ON dac.secid = iss.secid AND d = DATE '2025-03-01' + (pk % 3)::INT),
can AS (SELECT secid, count(*) AS n, min(d) AS f FROM dac JOIN pub USING (secid) WHERE abs(a - p) <= 1 GROUP BY secid),
st AS (SELECT iss.*, coalesce(can.n, 0) AS cand, CASE WHEN can.n = 1 THEN f END AS settled, coalesce(CASE WHEN can.n = 1 THEN f END, DATE '2025-03-02') AS od FROM iss LEFT JOIN can USING (secid)),
fac AS (SELECT st.secid, 1000 - coalesce(sum(amount) FILTER (pay_date <= od), 0) AS face FROM st LEFT JOIN amo USING (secid) GROUP BY ALL),
acc AS (SELECT st.secid, a / 100.0::DOUBLE AS accrued FROM st JOIN dac ON dac.secid = st.secid AND d = od),
bq AS (SELECT secid, 'PREVWAPRICE' AS price_source, 89 + pk % 20 AS clean FROM iss UNION ALL SELECT secid, 'WAPRICE', 91 + pk % 20 FROM iss WHERE pk % 6 <> 0 UNION ALL SELECT secid, 'LAST', 90 + pk % 20 FROM iss),
pri AS (SELECT secid, price_source, od, CASE WHEN pk % 11 <> 0 THEN rate / 100.0::DOUBLE END AS published_yield, clean * face / 100.0::DOUBLE + accrued AS price FROM bq JOIN st USING (secid) JOIN fac USING (secid) JOIN acc USING (secid)),
flo AS (SELECT secid, od, pay_date, cents / 100.0::DOUBLE AS amount FROM cup JOIN st USING (secid) WHERE pay_date > od UNION ALL SELECT secid, od, pay_date, amount FROM amo JOIN st USING (secid) WHERE pay_date > od),
nof AS (SELECT secid, od, min(offer_date) AS fd, arg_min(coalesce(price_pct, 100), offer_date) AS pct FROM off JOIN st USING (secid) WHERE offer_date > od GROUP BY ALL),
fof AS (SELECT secid, flo.od, pay_date, amount FROM flo JOIN nof USING (secid) WHERE pay_date <= fd
  UNION ALL SELECT secid, od, fd, paid FROM (SELECT nof.secid, od, fd, (1000 - coalesce(sum(amount) FILTER (pay_date <= fd), 0)) * pct / 100.0::DOUBLE AS paid FROM nof LEFT JOIN amo USING (secid) GROUP BY nof.secid, od, fd, pct) WHERE paid > 0)"""


def _root(flows: str, n: str) -> str:
    """Halvings of the yield of each quote over ``flows``, as y{n} with its flows."""
    pv = "list_sum(list_transform(range(1, len(ts) + 1), lambda j: xs[j] / pow(1 + {}, ts[j])))"
    return f""", arr{n} AS (SELECT secid, list((pay_date - od) / 365.0::DOUBLE ORDER BY pay_date, amount) AS ts, list(amount::DOUBLE ORDER BY pay_date, amount) AS xs FROM {flows} GROUP BY ALL HAVING bool_and(amount IS NOT NULL)),
sol{n} AS (SELECT secid, price_source, price, ts, xs, -0.99::DOUBLE AS lo, 10.0::DOUBLE AS hi, 0 AS i FROM pri JOIN arr{n} USING (secid) WHERE price IS NOT NULL
  UNION ALL SELECT secid, price_source, price, ts, xs, CASE WHEN pv > price THEN (lo + hi) / 2 ELSE lo END, CASE WHEN pv > price THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM (SELECT *, {pv.format("(lo + hi) / 2")} AS pv FROM sol{n} WHERE i < 60)),
y{n} AS (SELECT secid, price_source, round((lo + hi) / 2, 10) AS y{n}, ts, xs FROM sol{n} WHERE i = 60 AND price <= {pv.format("-0.99")} AND price >= {pv.format("10")})"""


_CMP = _root("flo", "1") + _root("fof", "2") + r""", cmp AS (SELECT pri.secid, price_source, y1, y2, round((y1 - published_yield) * 10000, 2) AS d1, round((y2 - published_yield) * 10000, 2) AS d2, published_yield, accrued, p / 100.0::DOUBLE AS published_accrued, settled, cand, pk, ones.ts, ones.xs,
  pri.secid IN (SELECT secid FROM flo WHERE amount IS NULL) AS unknown, pri.secid IN (SELECT secid FROM nof) AS offer
  FROM pri JOIN st USING (secid) JOIN acc USING (secid) JOIN pub USING (secid) LEFT JOIN y1 ones USING (secid, price_source) LEFT JOIN (SELECT secid, price_source, y2 FROM y2) USING (secid, price_source))"""
_B = f"WITH RECURSIVE {demo.BONDS_SQL}"
QUERIES = {f.__name__: f for f in (check, inbox_all, statement_unparsed, report_accounts, unknown_types, unbalanced_reports, verify_board, board_distribution)}
SQL = {
    "check": f"WITH {demo.LEDGER_SQL}, {_TROUBLED} SELECT * FROM ck",
    "statement_unparsed": f"WITH {_ODD} SELECT * FROM od",
    "inbox_all": f"""WITH {demo.LEDGER_SQL}, {_TROUBLED}, {_ODD} SELECT kind, source, count(*) AS n FROM ck GROUP BY ALL UNION ALL SELECT 'unparsed', report, n FROM od UNION ALL SELECT 'missing_raw', report_id, 1 FROM rp WHERE (account_id + w) % 9 = 0""",
    "report_accounts": f"WITH {demo.LEDGER_SQL}, x AS (SELECT 'r' || (id % 50) AS r, id, account_id FROM ledger WHERE id % 11 <> 0) SELECT 'r' || i AS source_report, min(id) AS first_id, arg_min(account_id, id)::BIGINT AS account_id FROM range(0, 60) t(i) LEFT JOIN x ON r = 'r' || i GROUP BY i",
    "unknown_types": f"WITH {demo.LEDGER_SQL}, x AS (SELECT CASE WHEN id % 37 = 0 THEN 'GIFT' WHEN id % 41 = 0 THEN NULL ELSE event_type END AS event_type FROM ledger) SELECT event_type, event_type IS NOT NULL AND event_type <> 'GIFT' AS known, count(*) AS n FROM x GROUP BY ALL",
    "unbalanced_reports": f"""WITH {demo.LEDGER_SQL}, m AS (SELECT account_id, floor((settlement_date - DATE '2024-01-01') / 7)::BIGINT AS w, sum(amount) AS q FROM ledger GROUP BY ALL),
    r AS (SELECT *, sum(q) OVER (PARTITION BY account_id ORDER BY w) AS z FROM m) SELECT 'a' || account_id || 'w' || w AS report, (z - q)::DOUBLE AS opening, q::DOUBLE AS moved, (z + 1)::DOUBLE AS closing FROM r WHERE (account_id + w) % 7 = 0""",
    "verify_board": _B + _BOARD + _CMP + r""" SELECT secid, price_source, round(y1, 7) + 0.0::DOUBLE AS own_yield, round(y2, 7) AS own_yield_to_offer, round(d1, 1) AS diff_bp, round(d2, 1) AS diff_to_offer_bp, accrued AS own_accrued, published_accrued, settled,
    floor(round(list_sum(list_transform(range(1, len(ts) + 1), lambda j: ts[j] * xs[j] / pow(1 + y1, ts[j]))) / list_sum(list_transform(range(1, len(ts) + 1), lambda j: xs[j] / pow(1 + y1, ts[j]))), 8) * 365 + 0.5)::BIGINT AS own_duration, coalesce(abs(d1) > 5, true) AS outlier,
    coalesce(nullif(concat_ws(', ', CASE WHEN cand = 0 THEN 'accrued interest differs: wrong schedule' WHEN cand > 1 THEN 'no accrued interest: settlement day unclear' END, CASE WHEN unknown THEN 'unknown coupons' END, CASE WHEN offer THEN 'offer before maturity' END, CASE WHEN pk % 5 = 0 THEN 'amortization' END,
      CASE WHEN pk % 19 = 0 THEN 'face value in USD' END, CASE WHEN published_yield IS NULL THEN 'no published yield' WHEN y1 IS NULL AND y2 IS NULL THEN 'no root' END, CASE WHEN coalesce(abs(d1) > 5, true) AND abs(d2) <= 5 THEN 'agrees with the offer' END), ''), 'ok') AS note FROM cmp""",
    "board_distribution": _B + _BOARD + _CMP + r""" SELECT price_source, count(d1) AS compared, count(*) - count(d1) AS skipped, count(*) FILTER (abs(d1) <= 5) AS within, round(quantile_cont(abs(d1), 0.5), 1) AS median, round(quantile_cont(abs(d1), 0.9), 1) AS p90, round(max(abs(d1)), 1) AS largest, round(avg(d1), 1) AS mean_bp FROM cmp GROUP BY ALL""",
}
