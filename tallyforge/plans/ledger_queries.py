"""Ledger queries on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import cleaning as c
from tallyforge.operators import ledger as L
from tallyforge.operators import projections as P
from tallyforge.operators.matching import longest_match
from tallyforge.plans.demo import LEDGER_SQL, demo_ledger, table

AS_OF = "2024-01-20"
D = lambda x: F.col(x).cast("double").alias(x)


def positions_asof(spark, d):
    return P.positions(demo_ledger(spark, d), AS_OF).select("account_id", "instrument_id", D("quantity"))


def cash_asof(spark, d):
    return P.cash_balances(demo_ledger(spark, d), AS_OF).select("account_id", "currency", D("amount"))


def settled_cash(spark, d):
    """Twelve accounts' cash in two currencies; two accounts have no entries, and none has a dollar."""
    x, accounts = demo_ledger(spark, d), spark.range(12).select(F.col("id").cast("int").alias("account_id"))
    one = lambda code: P.settled_cash(x, accounts, code, AS_OF).select("account_id", F.lit(code).alias("currency"), D("amount"))
    return one("RUB").unionByName(one("USD"))


def external_flow(spark, d):
    return P.external_flow_by_day(demo_ledger(spark, d)).select("day", D("amount"))


def fifo_lots(spark, d):
    return P.fifo_lots(demo_ledger(spark, d), AS_OF).select("account_id", "instrument_id", "id", "opened", D("remaining"), D("price"))


def negative_positions(spark, d):
    return P.first_negative(demo_ledger(spark, d), ("account_id", "instrument_id")).select("account_id", "instrument_id", "day", D("quantity"))


def with_reversals(spark, d):
    base = demo_ledger(spark, d)
    r = L.reversals_of(base.where("id % 50 = 0")).withColumn("id", F.col("reverses_id") + 1_000_000_000)
    r = r.withColumn("amount", F.when(F.col("reverses_id") % 150 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(24,6)"))
    r = r.withColumn("reverses_id", F.when(F.col("reverses_id") % 400 == 0, -1).otherwise(F.col("reverses_id")))
    return base.unionByName(r)


def reversal_check(spark, d):
    return L.unpaired_reversals(with_reversals(spark, d))


def live_rows(spark, d):
    return L.live_rows(with_reversals(spark, d)).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))


def duplicate_keys(spark, d):
    x = demo_ledger(spark, d).withColumn("natural_key", F.concat(F.lit("d"), F.col("id") - F.when(F.col("id") % 97 == 0, 1).otherwise(0)))
    return L.duplicate_keys(x)


def currency_check(spark, d):
    return L.missing_currency(demo_ledger(spark, d).withColumn("currency", F.when(F.col("id") % 101 == 0, "").when(F.col("id") % 103 == 0, "RUBL").otherwise(F.col("currency"))))


def _items(spark, d):
    x = demo_ledger(spark, d)
    row = F.when(F.col("id") % 10 == 0, F.col("id").cast("string"))
    no = F.when(F.col("id") % 10 == 1, F.concat(F.lit("T"), "id"))
    small = F.floor(F.col("amount") / 100).cast("decimal(24,6)")
    return x.select("id", F.col("account_id").cast("string").alias("account"), "trade_date", "event_type", F.col("instrument_id").cast("string").alias("instrument"), F.lit(None).cast("decimal(28,10)").alias("price"), "quantity", small.alias("amount"), "fee_kind", row.alias("source_row_id"), no.alias("broker_trade_no"))


def natural_keys(spark, d):
    return L.natural_keys(_items(spark, d)).select("id", F.col("ordinal").cast("long").alias("ordinal"), "natural_key")


def idempotent_diff(spark, d):
    x = demo_ledger(spark, d)
    incoming = x.where("id % 3 <> 0").select("natural_key").unionByName(x.where("id % 30 = 1").select("natural_key"))
    return L.diff_summary(L.idempotent_diff(incoming, x.where("id % 2 = 0").select("natural_key")))


def declarative_diff(spark, d):
    k = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("r"), "c_custkey").alias("source_row_id"), F.col("c_acctbal").cast("decimal(24,6)").alias("amount"), F.lit("RUB").alias("currency"))
    recorded = k.withColumn("reverses_id", F.lit(None).cast("long"))
    state = k.where("id % 10 <> 0").withColumn("amount", F.when(F.col("id") % 7 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(24,6)"))
    state = state.unionByName(k.where("id % 20 = 3").withColumn("source_row_id", F.concat(F.lit("n"), "id"))).drop("id")
    return L.declarative_diff(state, recorded).select("source_row_id", "action", F.col("versions").cast("long").alias("versions"))


def _expected_actual(spark, d):
    x = demo_ledger(spark, d)
    cash = P.cash_balances(x, AS_OF).select(F.concat(F.lit("a"), "account_id").alias("report_id"), F.lit("cash").alias("kind"), F.col("currency").alias("key"), F.col("amount").alias("quantity"), F.col("account_id").alias("code"))
    pos = P.positions(x, AS_OF).select(F.concat(F.lit("a"), "account_id").alias("report_id"), F.lit("security").alias("kind"), F.col("instrument_id").cast("string").alias("key"), F.col("quantity").cast("decimal(24,6)").alias("quantity"), (F.col("account_id") * 20 + F.col("instrument_id")).alias("code"))
    actual = cash.unionByName(pos)
    code = F.col("code") % 7
    expected = actual.where(code != 1).withColumn("quantity", F.when(code == 0, F.col("quantity") + 1).otherwise(F.col("quantity")).cast("decimal(24,6)"))
    return expected, actual


def reconcile(spark, d):
    e, a = _expected_actual(spark, d)
    return L.reconcile(e, a).select("report_id", "kind", "key", D("expected"), D("actual"), D("difference"))


def check_all_reports(spark, d):
    x = demo_ledger(spark, d)
    week = F.explode(F.sequence(F.lit(1), F.lit(4))).alias("w")
    marks = x.select("account_id", "currency").distinct().select("account_id", "currency", week)
    marks = marks.select("account_id", "currency", F.date_add(F.lit("2024-01-01").cast("date"), F.col("w") * 7).alias("as_of"), F.concat(F.lit("w"), "w").alias("report_id"))
    out = P.at_dates(x, marks, ["account_id", "currency"], F.coalesce("settlement_date", "trade_date"), F.col("amount"))
    return out.select("report_id", "account_id", "currency", "as_of", D("total"))


def inbox(spark, d):
    e, a = _expected_actual(spark, d)
    diff = L.reconcile(e, a).select(F.lit("discrepancy").alias("kind"), F.concat_ws(":", "report_id", "kind", "key").alias("title"))
    rev = reversal_check(spark, d).select(F.lit("violation").alias("kind"), F.concat_ws(":", F.lit("reversal"), "id", "problem").alias("title"))
    neg = negative_positions(spark, d).select(F.lit("violation").alias("kind"), F.concat_ws(":", F.lit("negative"), "account_id", "instrument_id").alias("title"))
    return diff.unionByName(rev).unionByName(neg)


def money_sum(spark, d):
    x = demo_ledger(spark, d).withColumn("currency", F.when((F.col("account_id") == 3) & (F.col("id") % 2 == 0), "USD").otherwise(F.col("currency")))
    return L.money_sum(x, ["account_id"]).select("account_id", D("amount"), "currency", "mixed")


def clean_numbers(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(24,2)").alias("v"))
    text = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "(").otherwise(""), c.format_decimal(F.col("v"), 2), F.when(F.col("o_orderkey") % 3 == 0, ")").otherwise(F.lit(" руб.")))
    odd = F.array(*[F.lit(x) for x in ODD_NUMBERS])
    text = F.when(F.col("o_orderkey") % 5 == 0, F.element_at(odd, (F.floor(F.col("o_orderkey") / 5) % len(ODD_NUMBERS) + 1).cast("int"))).otherwise(text)
    return o.select("o_orderkey", c.parse_decimal(text).cast("double").alias("value"))


#: Cells as statements have them, with their values.
ODD_NUMBERS = {"1 234,56": 1234.56, "(1 234,56)": -1234.56, "1.234,56": 1234.56, "1,234.56": 1234.56, "−5": -5.0, "1.234.567": 1234567.0, "12 USD": 12.0, "n/a": None, "—": None, "abc": None, "1,2,3": None, "": None, "0,00 ₽": 0.0}


def clean_dates(spark, d):
    t, n = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(n == 0, F.date_format(t, "dd.MM.yyyy")).when(n == 1, F.date_format(t, "yyyy-MM-dd HH:mm")).when(n == 2, F.date_format(t, "d/M/yyyy")).otherwise(F.date_format(t, "dd.MM.yy"))
    return table(spark, d, "orders").select("o_orderkey", c.parse_date(text).alias("day"))


def clean_currency(spark, d):
    words = F.array(*[F.lit(w) for w in ("руб.", "$", "евро", "cny", "GBP", "рубль", "12", "доллар сша")])
    return table(spark, d, "customer").select("c_custkey", c.parse_currency(F.element_at(words, (F.col("c_custkey") % 8 + 1).cast("int"))).alias("currency"))


def signature_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(c.normalize_signature(F.col("text"))).alias("sig"))


NOUNS = {"ring": "jewel", "widget": "part", "red": "colour", "small": "size", "small ring": "small jewel", "bolt": "part", "gear": "part"}


def longest_phrase(spark, d):
    return longest_match(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", NOUNS).select("p_partkey", "match")


def raw_dedupe(spark, d):
    """Distinct contents by digest with their first id: the digest is aggregated, texts are not moved."""
    return table(spark, d, "documents").select(F.sha2("text", 256).alias("sha256"), "doc_id").groupBy("sha256").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


_FIFO = r"""
m AS (SELECT * FROM ledger WHERE event_type IN ('BUY', 'SELL') AND trade_date <= DATE '2024-01-20'),
w AS (SELECT *, sum(quantity) OVER r AS cx, sum(greatest(quantity, 0)) OVER r AS cb FROM m WINDOW r AS (PARTITION BY account_id, instrument_id ORDER BY trade_date, id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, sum(greatest(-quantity, 0)) OVER g + least(0, min(cx) OVER g) AS eaten, sum(quantity) OVER g AS net FROM w WINDOW g AS (PARTITION BY account_id, instrument_id))
SELECT account_id, instrument_id, id, trade_date AS opened, greatest(0, least(quantity, cb - eaten))::DOUBLE AS remaining, price::DOUBLE AS price
FROM f WHERE quantity > 0 AND greatest(0, least(quantity, cb - eaten)) > 0 AND net <> 0"""
_NEG = r"""neg AS (SELECT account_id, instrument_id, min(trade_date) AS day, arg_min(q, trade_date)::DOUBLE AS quantity FROM (
  SELECT *, sum(s) OVER (PARTITION BY account_id, instrument_id ORDER BY trade_date) AS q FROM (
    SELECT account_id, instrument_id, trade_date, sum(quantity) AS s FROM ledger WHERE event_type IN ('BUY', 'SELL') GROUP BY ALL)) WHERE q < 0 GROUP BY ALL)"""
_REV = r"""rv AS (SELECT id + 1000000000 AS id, CASE WHEN id % 400 = 0 THEN -1 ELSE id END AS reverses_id, -amount + CASE WHEN id % 150 = 0 THEN 1 ELSE 0 END AS amount, -quantity AS quantity, event_type FROM ledger WHERE id % 50 = 0),
al AS (SELECT id, NULL::BIGINT AS reverses_id, amount, quantity, event_type FROM ledger UNION ALL SELECT id, reverses_id, amount, quantity, event_type FROM rv),
rc AS (SELECT r.id, 'missing' AS problem FROM rv r ANTI JOIN al o ON r.reverses_id = o.id
  UNION ALL SELECT r.id, 'amount' FROM rv r JOIN al o ON r.reverses_id = o.id WHERE r.amount + o.amount <> 0
  UNION ALL SELECT r.id, 'quantity' FROM rv r JOIN al o ON r.reverses_id = o.id WHERE coalesce(r.quantity, 0) + coalesce(o.quantity, 0) <> 0)"""
_REC = r"""act AS (SELECT account_id AS code, 'a' || account_id AS report_id, 'cash' AS kind, currency AS key, sum(amount)::DOUBLE AS q FROM ledger WHERE settlement_date <= DATE '2024-01-20' GROUP BY ALL
  UNION ALL SELECT account_id * 20 + instrument_id, 'a' || account_id, 'security', instrument_id::VARCHAR, sum(quantity)::DOUBLE FROM ledger WHERE event_type IN ('BUY', 'SELL') AND trade_date <= DATE '2024-01-20' GROUP BY ALL HAVING sum(quantity) <> 0),
rec AS (SELECT report_id, kind, key, CASE code % 7 WHEN 0 THEN q + 1 ELSE 0 END AS expected, q AS actual, CASE code % 7 WHEN 0 THEN -1 ELSE q END::DOUBLE AS difference FROM act WHERE code % 7 = 0 OR code % 7 = 1 AND q <> 0)"""
QUERIES = {f.__name__: f for f in (
    positions_asof, cash_asof, settled_cash, external_flow, fifo_lots, negative_positions, reversal_check, live_rows, duplicate_keys, currency_check, natural_keys, idempotent_diff,
    declarative_diff, reconcile, check_all_reports, inbox, money_sum, clean_numbers, clean_dates, clean_currency, signature_normalize, longest_phrase, raw_dedupe,
)}
_L = f"WITH {LEDGER_SQL} "
SQL = {
    "positions_asof": _L + "SELECT account_id, instrument_id, sum(quantity)::DOUBLE AS quantity FROM ledger WHERE event_type IN ('BUY', 'SELL') AND trade_date <= DATE '2024-01-20' GROUP BY ALL HAVING sum(quantity) <> 0",
    "settled_cash": _L + f" SELECT a AS account_id, c AS currency, coalesce((SELECT sum(amount) FROM ledger WHERE account_id = a AND currency = c AND settlement_date <= DATE '{AS_OF}'), 0)::DOUBLE AS amount FROM range(12) AS r(a), (VALUES ('RUB'), ('USD')) AS v(c)",
    "cash_asof": _L + "SELECT account_id, currency, sum(amount)::DOUBLE AS amount FROM ledger WHERE settlement_date <= DATE '2024-01-20' GROUP BY ALL",
    "external_flow": _L + "SELECT settlement_date AS day, sum(amount)::DOUBLE AS amount FROM ledger WHERE event_type = 'CASH_IN' GROUP BY ALL",
    "fifo_lots": f"WITH {LEDGER_SQL}, {_FIFO}",
    "negative_positions": f"WITH {LEDGER_SQL}, {_NEG} SELECT * FROM neg",
    "reversal_check": f"WITH {LEDGER_SQL}, {_REV} SELECT * FROM rc",
    "live_rows": f"WITH {LEDGER_SQL}, {_REV} SELECT event_type, count(*) AS n, sum(amount)::DOUBLE AS amount FROM al WHERE reverses_id IS NULL AND id NOT IN (SELECT reverses_id FROM rv) GROUP BY ALL",
    "duplicate_keys": _L + "SELECT 'd' || (id - CASE WHEN id % 97 = 0 THEN 1 ELSE 0 END) AS natural_key, count(*) AS n FROM ledger GROUP BY ALL HAVING count(*) > 1",
    "currency_check": _L + "SELECT id, CASE WHEN id % 101 = 0 THEN '' ELSE 'RUBL' END AS currency FROM ledger WHERE id % 101 = 0 OR id % 103 = 0",
    "natural_keys": _L + r""", it AS (SELECT id, account_id::VARCHAR AS account, trade_date::VARCHAR AS td, event_type, coalesce(instrument_id::VARCHAR, '') AS ins, coalesce(quantity::VARCHAR, '') AS qt,
      floor(amount / 100)::BIGINT::VARCHAR AS am, coalesce(fee_kind, '') AS fk FROM ledger),
    nk AS (SELECT *, row_number() OVER (PARTITION BY account, td, event_type, ins, qt, am, fk ORDER BY id) - 1 AS ordinal FROM it)
    SELECT id, ordinal, substring(sha256('k1|' || CASE WHEN id % 10 = 0 THEN concat_ws('|', 'csv', account, td, event_type, ins, id) WHEN id % 10 = 1 THEN concat_ws('|', 'trade', account, td, event_type, fk, 'T' || id)
      ELSE concat_ws('|', 'hash', account, td, event_type, ins, qt, '', am, fk, ordinal) END), 1, 40) AS natural_key FROM nk""",
    "idempotent_diff": _L + r""", i AS (SELECT id FROM ledger WHERE id % 3 <> 0 UNION ALL SELECT id FROM ledger WHERE id % 30 = 1)
    SELECT CASE WHEN n > 1 THEN 'rejected' WHEN id % 2 = 0 THEN 'unchanged' ELSE 'new' END AS action, count(*) AS n FROM (SELECT id, count(*) OVER (PARTITION BY id) AS n FROM i) GROUP BY 1""",
    "declarative_diff": r"""SELECT 'r' || c_custkey AS source_row_id, CASE WHEN c_custkey % 10 = 0 THEN 'reverse' WHEN c_custkey % 7 = 0 THEN 'replace' ELSE 'unchanged' END AS action, 1::BIGINT AS versions FROM customer
    UNION ALL SELECT 'n' || c_custkey, 'new', 0 FROM customer WHERE c_custkey % 20 = 3""",
    "check_all_reports": _L + r""", mk AS (SELECT DISTINCT account_id, currency FROM ledger), wk AS (SELECT 'w' || i AS report_id, DATE '2024-01-01' + (7 * i)::INT AS as_of FROM range(1, 5) t(i))
    SELECT report_id, mk.account_id, mk.currency, as_of, coalesce(sum(amount), 0)::DOUBLE AS total FROM mk CROSS JOIN wk LEFT JOIN ledger l ON l.account_id = mk.account_id AND l.currency = mk.currency AND l.settlement_date <= as_of GROUP BY ALL""",
    "money_sum": _L + "SELECT account_id, CASE WHEN account_id <> 3 THEN s END AS amount, CASE WHEN account_id <> 3 THEN 'RUB' END AS currency, account_id = 3 AS mixed FROM (SELECT account_id, sum(amount)::DOUBLE AS s FROM ledger GROUP BY ALL)",
    "reconcile": f"WITH {LEDGER_SQL}, {_REC} SELECT * FROM rec",
    "inbox": f"WITH {LEDGER_SQL}, {_REC}, {_REV}, {_NEG} SELECT 'discrepancy' AS kind, concat_ws(':', report_id, kind, key) AS title FROM rec UNION ALL SELECT 'violation', concat_ws(':', 'reversal', id, problem) FROM rc UNION ALL SELECT 'violation', concat_ws(':', 'negative', account_id, instrument_id) FROM neg",
    "clean_numbers": f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN [{', '.join('NULL' if v is None else str(v) for v in ODD_NUMBERS.values())}][(o_orderkey // 5) % {len(ODD_NUMBERS)} + 1]::DOUBLE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END AS value FROM orders",
    "clean_dates": "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders",
    "clean_currency": "SELECT c_custkey, ['RUB', 'USD', 'EUR', 'CNY', 'GBP', 'RUB', NULL, 'USD'][(c_custkey % 8 + 1)::INT] AS currency FROM customer",
    "longest_phrase": r"""WITH dict(p, v, i) AS (VALUES ('ring', 'jewel', 0), ('widget', 'part', 1), ('red', 'colour', 2), ('small', 'size', 3), ('small ring', 'small jewel', 4), ('bolt', 'part', 5), ('gear', 'part', 6))
    SELECT p_partkey, (SELECT v FROM dict WHERE contains(p_name, p) ORDER BY length(p) DESC, i LIMIT 1) AS match FROM part""",
    "signature_normalize": rf"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(translate(lower(trim(regexp_replace(coalesce(text, ''), '[ \t\r\n{c.SPACES}]+', ' ', 'g'))), 'ё', 'е'), '{c.PUNCTUATION.replace("'", "''")}', ' ', 'g'), ' +', ' ', 'g'))) AS sig FROM documents""",
    "raw_dedupe": "SELECT sha256(text) AS sha256, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY ALL",
}
