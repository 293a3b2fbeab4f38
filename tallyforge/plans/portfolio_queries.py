"""Queries on identities, values and returns, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.operators import bitemporal, identities, returns, store
from tallyforge.operators.concentration import concentration, herfindahl
from tallyforge.operators.deposits import deposit_schedule
from tallyforge.operators.quantiles import exact_quantiles
from tallyforge.operators.staging import shared_folder, staged
from tallyforge.plans.check_queries import SQL as CHECKS_SQL
from tallyforge.plans.check_queries import verify_board
from tallyforge.plans.demo import LEDGER_SQL, demo_ledger, table
from tallyforge.sources import snapshots
from tallyforge.streaming import ingest

AS_OF, UNTIL = "2024-01-20", "2024-02-03"
VERIFY_SQL = CHECKS_SQL["verify_board"]
D = lambda x: F.col(x).cast("double").alias(x)


# chains of mentions: each part is named by its own ticker and, up to every fourth, by its neighbour's ISIN


def demo_mentions(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("pk"), "p_size")
    code = lambda n: F.concat(F.lit("XS"), F.lpad(n.cast("string"), 10, "0"))
    own = p.select((F.col("pk") * 2).alias("seq"), F.concat(F.lit("TK"), "pk").alias("ticker"), F.when(F.col("pk") % 9 != 8, code(F.col("pk"))).alias("isin"))
    next_ = p.where("p_size % 4 <> 0").select((F.col("pk") * 2 + 1).alias("seq"), F.when(F.col("pk") % 11 != 10, F.concat(F.lit("TK"), F.col("pk") + 1)).alias("ticker"), code(F.col("pk")).alias("isin"))
    return own.unionByName(next_)


def demo_known(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("pk")).where("pk % 13 IN (5, 6)")
    return p.select(F.col("pk").alias("instrument_id"), F.concat(F.lit("TK"), "pk").alias("ticker"), F.when(F.col("pk") % 2 == 0, F.concat(F.lit("XS"), F.lpad(F.col("pk").cast("string"), 10, "0"))).alias("isin"))


def identity_chains(spark, d):
    rows, _, _ = identities.resolve_chains(demo_mentions(spark, d), demo_known(spark, d))
    return rows


def identity_codes(spark, d):
    return identities.resolve_chains(demo_mentions(spark, d), demo_known(spark, d))[1]


def identity_conflicts(spark, d):
    return identities.resolve_chains(demo_mentions(spark, d), demo_known(spark, d))[2]


_CHAINS = """WITH RECURSIVE p AS (SELECT p_partkey AS pk, p_size FROM part),
men AS (SELECT pk * 2 AS seq, 'TTK' || pk AS t, CASE WHEN pk % 9 <> 8 THEN 'IXS' || lpad(pk::VARCHAR, 10, '0') END AS i FROM p
  UNION ALL SELECT pk * 2 + 1, CASE WHEN pk % 11 <> 10 THEN 'TTK' || (pk + 1) END, 'IXS' || lpad(pk::VARCHAR, 10, '0') FROM p WHERE p_size % 4 <> 0),
kno AS (SELECT pk AS id, 'TTK' || pk AS t, CASE WHEN pk % 2 = 0 THEN 'IXS' || lpad(pk::VARCHAR, 10, '0') END AS i FROM p WHERE pk % 13 IN (5, 6)),
edge AS (SELECT coalesce(i, t) AS a, coalesce(t, i) AS b FROM (SELECT t, i FROM men UNION ALL SELECT t, i FROM kno)),
both_ AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT a AS node, a AS other FROM both_ UNION SELECT r.node, e.b FROM reach AS r JOIN both_ AS e ON r.other = e.a),
grp AS (SELECT node, min(other) AS label FROM reach GROUP BY node),
codes AS (SELECT id, t AS node FROM kno UNION SELECT id, i FROM kno WHERE i IS NOT NULL),
known AS (SELECT label, min(id) AS id, min(id) <> max(id) AS conflict FROM codes JOIN grp USING (node) GROUP BY label),
lab AS (SELECT m.*, g.label, k.id AS old, coalesce(k.conflict, FALSE) AS conflict FROM men AS m JOIN grp AS g ON coalesce(m.i, m.t) = g.node LEFT JOIN known AS k USING (label)),
fresh AS (SELECT label, row_number() OVER (ORDER BY min(seq)) + (SELECT max(id) FROM kno) AS id FROM lab WHERE old IS NULL GROUP BY label),
res AS (SELECT l.seq, substr(l.t, 2) AS ticker, substr(l.i, 2) AS isin, CASE WHEN conflict THEN coalesce(ci.id, ct.id) ELSE coalesce(l.old, f.id) END AS instrument_id
  FROM lab AS l LEFT JOIN fresh AS f USING (label) LEFT JOIN codes AS ci ON ci.node = l.i LEFT JOIN codes AS ct ON ct.node = l.t)
"""


# values and returns


def closes(ledger):
    """The last trade's price of each instrument and day."""
    t = ledger.where("instrument_id IS NOT NULL AND price IS NOT NULL")
    return t.groupBy("instrument_id", F.col("trade_date").alias("day")).agg(F.max_by("price", "id").alias("price"))


def funded(ledger):
    """The ledger, and money brought in on each account's first day."""
    first = ledger.groupBy("account_id").agg(F.min("trade_date").alias("trade_date"))
    return ledger.unionByName(first.select("account_id", "trade_date", F.lit("OPENING_BALANCE").alias("event_type"), F.lit(25_000).cast("decimal(24,6)").alias("amount")), allowMissingColumns=True)


def _nav(spark, d):
    # prices are known on two days of three, so that some are carried forward
    x = funded(demo_ledger(spark, d))
    return returns.daily_nav(x, closes(x).where("(dayofmonth(day) + instrument_id) % 3 <> 0"), UNTIL)


def daily_prices(spark, d):
    p = closes(demo_ledger(spark, d)).where("(dayofmonth(day) + instrument_id) % 3 <> 0")
    return returns.asof_prices(p, UNTIL).select("instrument_id", "day", D("price"), "priced_on")


def daily_nav(spark, d):
    return _nav(spark, d).select("account_id", "day", D("cash"), D("securities"), D("nav"), D("external_flow"), "stale", "unpriced")


def time_weighted(spark, d):
    x = returns.time_weighted(_nav(spark, d))
    return x.select("account_id", "days", "restarts", F.round("twr", 8).alias("twr"))


def account_xirr(spark, d):
    """Returns of accounts: external flows, and the last day's value as taken out."""
    n = _nav(spark, d)
    flows = n.select("account_id", "day", (-F.col("external_flow")).alias("amount")).unionByName(n.where(F.col("day") == F.lit(UNTIL).cast("date")).select("account_id", "day", F.col("nav").alias("amount")))
    return returns.money_weighted(flows).select("account_id", "flows", "roots", F.round("xirr", 6).alias("xirr"))


def customer_xirr(spark, d):
    """Flows of both signs in any order, so some customers have no root and some have several."""
    o = table(spark, d, "orders")
    sign = F.when(F.col("o_orderstatus") == "F", -1).when(F.col("o_orderpriority").startswith("1"), -2).otherwise(1)
    flows = o.select(F.col("o_custkey").alias("customer"), F.to_date("o_orderdate").alias("day"), (sign * F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"))
    return returns.money_weighted(flows, ("customer",)).select("customer", "flows", "roots", F.round("xirr", 6).alias("xirr"))


# ratings on two axes of time, from the events table


def demo_ratings(spark, d):
    """Facts on 20 issues and 5 issuers by three agencies; recorded up to six days late, often for days that have one."""
    e = table(spark, d, "events").where("event_type IN ('view', 'error')").withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("int"))
    issue = F.col("k") % 3 > 0
    day = F.to_date("ts")
    return e.select(
        "event_id", F.when(issue, "issue").otherwise("issuer").alias("entity_type"), F.when(issue, F.col("k") % 20).otherwise(F.col("k") % 5).alias("entity_id"), (F.col("user_id") % 3).cast("int").alias("agency"),
        day.alias("valid_from"), F.date_add(day, (F.col("event_id") % 7).cast("int")).alias("recorded_at"), F.when(F.col("event_id") % 6 > 0, F.floor(F.col("value") / 10).cast("int")).alias("rating"),
    )


def _rectangles(spark, d):
    return bitemporal.rectangles(demo_ratings(spark, d), ["entity_type", "entity_id", "agency"], "rating", "event_id")


def ratings_known_on(spark, d):
    """All ratings with their days, as known on one day."""
    x = _rectangles(spark, d)
    on = F.lit("2024-01-20").cast("date")
    return x.where((F.col("known_from") <= on) & (F.col("known_to").isNull() | (F.col("known_to") > on))).select("entity_type", "entity_id", "agency", "valid_from", "valid_to", F.col("value").alias("rating"))


def rating_history_area(spark, d):
    """Days times days that each value covers up to a day on both axes: a measure of the whole rectangle table."""
    end = F.lit("2024-02-10").cast("date")
    side = lambda a, b: F.date_diff(F.least(F.coalesce(b, end), end), a)
    x = _rectangles(spark, d).withColumn("area", side(F.col("valid_from"), F.col("valid_to")) * side(F.col("known_from"), F.col("known_to")))
    return x.groupBy("entity_type", "entity_id", "agency", F.col("value").alias("rating")).agg(F.sum("area").cast("long").alias("area"))


def rating_at_purchase(spark, d):
    """The rating that a purchase's instrument had on its day, as it was known some days later: the issue's, else the issuer's."""
    t = demo_ledger(spark, d).where("event_type = 'BUY'")
    marks = t.select(F.col("id").alias("mark_id"), F.col("instrument_id").alias("issue"), (F.col("instrument_id") % 5).alias("issuer"), F.col("trade_date").alias("valid_on"), F.date_add("trade_date", (F.col("id") % 5).cast("int")).alias("known_on"))
    return bitemporal.resolved(_rectangles(spark, d), marks).select("mark_id", "rating", "source")


_RATINGS = r"""WITH e AS (SELECT *, regexp_extract(props, '(\d+)', 1)::INT AS k FROM events WHERE event_type IN ('view', 'error')),
fact AS (SELECT event_id, CASE WHEN k % 3 > 0 THEN 'issue' ELSE 'issuer' END AS entity_type, CASE WHEN k % 3 > 0 THEN k % 20 ELSE k % 5 END AS entity_id, (user_id % 3)::INT AS agency,
  ts::DATE AS v, ts::DATE + (event_id % 7)::INT AS r, CASE WHEN event_id % 6 > 0 THEN floor(value / 10)::INT END AS rating FROM e)
"""


# the committed ledger


def _committed(spark, d, name):
    """The ledger as three batches, one of them committed twice: first by mistake with every amount doubled."""
    root = f"{shared_folder(spark)}/{name}"
    x = demo_ledger(spark, d)
    third = lambda k: x.where(F.col("id") % 3 == k)
    store.commit(third(0), root, "b0")
    store.commit(third(1).withColumn("amount", (F.col("amount") * 2).cast("decimal(24,6)")), root, "b1")
    store.commit(third(2), root, "b2")
    store.commit(third(1), root, "b1")
    return root


def load_entries(spark, d):
    root = _committed(spark, d, f"ledger-{uuid.uuid4().hex}")
    x = store.load(spark, root, 3, AS_OF)
    # the place in the stable order is what a reader of the sorted rows counts
    return x.withColumn("place", F.row_number().over(W.partitionBy("account_id").orderBy("trade_date", "id"))).select("place", "id", "event_type", "trade_date", "instrument_id", D("quantity"), D("amount"))


def ledger_totals(spark, d):
    root = _committed(spark, d, f"ledger-{uuid.uuid4().hex}")
    return store.read(spark, root).groupBy("account_id", "month").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))


def save_board_run(spark, d):
    """Two runs of a board's verification, the first saved twice; their headers."""
    root = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    checks = staged(verify_board(spark, d), "checks")
    odd = checks.where("secid LIKE '%3'")
    for run, rows in (("r1", odd), ("r2", odd), ("r1", checks)):
        snapshots.save_run(rows, root, run, board="TQCB")
    return snapshots.runs(spark, root)


def append_new_keys(spark, d):
    """Four batches of a stream, with keys that came before in other batches, in the same one, and one batch tried twice."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    x = demo_ledger(spark, d)
    cut = lambda sql: x.where(sql)
    again = x.where("id % 5 = 0").withColumn("id", F.col("id") + 1_000_000_000)
    for number, batch in ((0, cut("id % 4 = 0")), (1, cut("id % 4 = 1").unionByName(again)), (1, cut("id % 4 = 1").unionByName(again)), (2, cut("id % 4 < 3")), (3, cut("id % 4 = 3").unionByName(again).unionByName(cut("id % 4 = 3")))):
        ingest.append_new(batch, root, number)
    return store.read(spark, root).groupBy("account_id").agg(F.count("*").alias("n"), F.count_distinct("natural_key").alias("keys"), F.sum("id").alias("ids"))


# quantiles, deposits, concentration


def order_quantiles(spark, d):
    o = table(spark, d, "orders")
    return exact_quantiles(o, ["o_orderstatus"], "o_totalprice", [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]).select("o_orderstatus", "share", F.round("quantile", 6).alias("quantile"))


HOLIDAYS = ["2024-05-01", "2024-05-09", "2024-06-12", "2024-11-04", "2025-01-01", "2025-01-02", "2025-01-03", "2025-01-06", "2025-01-07", "2025-01-08"]


def demo_deposits(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    return c.select(
        k.alias("deposit_id"), (1000 + F.abs("c_acctbal") * 10).cast("decimal(24,2)").alias("amount"), (4 + k % 15).cast("decimal(9,4)").alias("rate_pct"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 120).cast("int")).alias("opened"),
        (1 + k % 24).cast("int").alias("months"), F.when(k % 4 == 0, None).otherwise(F.element_at(F.array(F.lit(1), F.lit(3), F.lit(6)), (k % 3 + 1).cast("int"))).alias("every"), (k % 2 == 0).alias("capitalised"), F.when(k % 5 == 0, 360).otherwise(365).alias("base"),
    )


def deposit_payments(spark, d):
    return deposit_schedule(demo_deposits(spark, d), HOLIDAYS).select("deposit_id", "n", "due", "paid_on", "days", D("interest"), D("balance"), D("principal"))


def _shares(spark, d):
    v = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    currency = F.element_at(F.array(F.lit("RUB"), F.lit("USD"), F.lit("CNY")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    v = v.select((F.col("l_suppkey") % 10).alias("account_id"), F.col("p_brand").alias("issuer"), currency.alias("currency"), F.col("p_type").alias("kind"), F.col("l_extendedprice").alias("value"))
    return concentration(v, "account_id", [["issuer"], ["currency"], ["kind"], ["currency", "kind"]])


def concentration_shares(spark, d):
    return _shares(spark, d).select("account_id", "cut", "issuer", "currency", "kind", D("value"), F.round("share", 8).alias("share"))


def concentration_index(spark, d):
    return herfindahl(_shares(spark, d), "account_id").select("account_id", "cut", "n", F.round("herfindahl", 8).alias("herfindahl"), F.round("top_share", 8).alias("top_share"))


_NAV = f"""WITH RECURSIVE {LEDGER_SQL},
lim AS (SELECT DATE '{UNTIL}' AS until),
px AS (SELECT instrument_id, trade_date AS day, arg_max(price, id) AS price FROM ledger WHERE price IS NOT NULL AND instrument_id IS NOT NULL GROUP BY ALL HAVING (dayofmonth(trade_date) + instrument_id) % 3 <> 0),
cal AS (SELECT unnest(generate_series((SELECT min(trade_date) FROM ledger), (SELECT until FROM lim), INTERVAL 1 DAY))::DATE AS day),
mv AS (SELECT account_id, instrument_id, trade_date, sum(quantity) AS q FROM ledger WHERE event_type IN ('BUY', 'SELL') AND quantity IS NOT NULL GROUP BY ALL),
pos AS (SELECT m.account_id, m.instrument_id, c.day, sum(m.q) AS q FROM cal AS c JOIN mv AS m ON m.trade_date <= c.day GROUP BY ALL HAVING sum(m.q) <> 0),
val AS (SELECT p.account_id, p.day, sum(p.q * coalesce(x.price, 0)) AS securities, count(*) FILTER (WHERE x.day < p.day) AS stale, count(*) FILTER (WHERE x.day IS NULL) AS unpriced
  FROM pos AS p ASOF LEFT JOIN px AS x ON p.instrument_id = x.instrument_id AND x.day <= p.day GROUP BY ALL),
ent AS (SELECT account_id, trade_date AS day, sum(amount) AS cash, sum(CASE WHEN event_type IN ('CASH_IN', 'OPENING_BALANCE') THEN amount ELSE 0 END) AS flow
  FROM (SELECT account_id, trade_date, amount, event_type FROM ledger UNION ALL SELECT account_id, min(trade_date), 25000, 'OPENING_BALANCE' FROM ledger GROUP BY 1) GROUP BY ALL),
csh AS (SELECT e.account_id, c.day, sum(e.cash) AS cash FROM cal AS c JOIN ent AS e ON e.day <= c.day GROUP BY ALL),
nav AS (SELECT c.account_id, c.day, c.cash::DOUBLE AS cash, coalesce(v.securities, 0)::DOUBLE AS securities, (c.cash + coalesce(v.securities, 0))::DOUBLE AS nav, coalesce(e.flow, 0)::DOUBLE AS external_flow,
  coalesce(v.stale, 0)::BIGINT AS stale, coalesce(v.unpriced, 0)::BIGINT AS unpriced FROM csh AS c LEFT JOIN val AS v USING (account_id, day) LEFT JOIN ent AS e USING (account_id, day))
"""


def _xirr(key: str, before: str, flows: str) -> str:
    """SQL by halving: signs on the grid first."""
    g, low, high = returns.GRID, f"ln({1 + returns.LOW})", f"ln({1 + returns.HIGH})"
    return f"""{before},
day_ AS (SELECT {key} AS k, day, sum(amount) AS a FROM ({flows}) GROUP BY ALL HAVING sum(amount) <> 0),
f AS (SELECT k, a::DOUBLE AS a, date_diff('day', min(day) OVER (PARTITION BY k), day) / 365.0::DOUBLE AS t FROM day_),
gr AS (SELECT f.k, j, {low} + ({high} - {low}) * j / {g} AS y, sum(a * exp(-({low} + ({high} - {low}) * j / {g}) * t)) > 0 AS up FROM f, range({g + 1}) AS r(j) GROUP BY ALL),
turn AS (SELECT k, y AS lo, lead(y) OVER w AS hi, up, lead(up) OVER w AS next_up FROM gr WINDOW w AS (PARTITION BY k ORDER BY j)),
roots AS (SELECT k, count(*) FILTER (WHERE up <> next_up) AS roots FROM turn GROUP BY k),
one AS (SELECT k, lo, hi, up FROM turn JOIN roots USING (k) WHERE roots = 1 AND up <> next_up),
fs AS (SELECT k, list({{'a': a, 't': t}} ORDER BY t) AS z FROM f GROUP BY k),
halve AS (SELECT k, lo, hi, up, 0 AS n FROM one UNION ALL
  SELECT k, CASE WHEN v = up THEN (lo + hi) / 2 ELSE lo END, CASE WHEN v = up THEN hi ELSE (lo + hi) / 2 END, up, n + 1
  FROM (SELECT h.*, list_sum([x.a * exp(-(lo + hi) / 2 * x.t) FOR x IN fs.z]) > 0 AS v FROM halve AS h JOIN fs USING (k) WHERE n < {returns.HALVINGS}))
SELECT roots.k AS {key}, (SELECT count(*) FROM f WHERE f.k = roots.k) AS flows, roots, round(exp((h.lo + h.hi) / 2) - 1, 6) AS xirr
FROM roots LEFT JOIN halve AS h ON h.k = roots.k AND h.n = {returns.HALVINGS}"""


_FLOWS = f"SELECT account_id, day, -external_flow AS amount FROM nav UNION ALL SELECT account_id, day, nav FROM nav WHERE day = DATE '{UNTIL}'"
_ORDERS = "SELECT o_custkey AS customer, o_orderdate::DATE AS day, CASE WHEN o_orderstatus = 'F' THEN -1 WHEN o_orderpriority LIKE '1%' THEN -2 ELSE 1 END * o_totalprice::DECIMAL(18,2) AS amount FROM orders"

_SHARES = """WITH v AS (SELECT l_suppkey % 10 AS account_id, p_brand AS issuer, ['RUB', 'USD', 'CNY'][l_linenumber % 3 + 1] AS currency, p_type AS kind, l_extendedprice::DECIMAL(28,6) AS value FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT account_id, issuer, currency, kind, grouping_id(account_id, issuer, currency, kind)::BIGINT AS cut, sum(value) AS value FROM v GROUP BY GROUPING SETS ((account_id), (account_id, issuer), (account_id, currency), (account_id, kind), (account_id, currency, kind))),
s AS (SELECT *, value::DOUBLE / max(CASE WHEN cut = 7 THEN value END) OVER (PARTITION BY account_id)::DOUBLE AS share FROM g)
"""

QUERIES = {
    f.__name__: f
    for f in (
        identity_chains, identity_codes, identity_conflicts, daily_prices, daily_nav, time_weighted, account_xirr, customer_xirr, ratings_known_on, rating_history_area, rating_at_purchase,
        load_entries, ledger_totals, save_board_run, append_new_keys, order_quantiles, deposit_payments, concentration_shares, concentration_index,
    )
}
SQL = {
    "identity_chains": _CHAINS + "SELECT seq, ticker, isin, instrument_id FROM res WHERE instrument_id IS NOT NULL",
    "identity_conflicts": _CHAINS + "SELECT seq, ticker, isin, 'its chain joins known instruments' AS reason FROM res WHERE instrument_id IS NULL",
    "identity_codes": _CHAINS + "SELECT id AS instrument_id, node AS code FROM codes UNION SELECT coalesce(k.id, f.id), g.node FROM grp AS g LEFT JOIN known AS k USING (label) LEFT JOIN fresh AS f USING (label) WHERE coalesce(NOT k.conflict, TRUE)",
    "daily_prices": _NAV + ", keys AS (SELECT instrument_id, min(day) AS f FROM px GROUP BY 1) SELECT k.instrument_id, c.day, x.price::DOUBLE AS price, x.day AS priced_on FROM (SELECT * FROM keys JOIN cal ON cal.day >= keys.f) AS c JOIN keys AS k USING (instrument_id) ASOF JOIN px AS x ON c.instrument_id = x.instrument_id AND x.day <= c.day",
    "daily_nav": _NAV + "SELECT * FROM nav",
    "time_weighted": _NAV + ", r AS (SELECT *, lag(nav) OVER (PARTITION BY account_id ORDER BY day) AS b FROM nav) SELECT account_id, count(*) AS days, count(*) FILTER (WHERE b = 0) AS restarts, CASE WHEN count(*) FILTER (WHERE b < 0) = 0 THEN round(coalesce(product(CASE WHEN b > 0 THEN (nav - external_flow) / b END), 1) - 1, 8) END AS twr FROM r GROUP BY 1",
    "account_xirr": _xirr("account_id", _NAV, _FLOWS),
    "customer_xirr": _xirr("customer", "WITH RECURSIVE lim AS (SELECT 1 AS one)", _ORDERS),
    "ratings_known_on": _RATINGS + """, k AS (SELECT * FROM fact WHERE r <= DATE '2024-01-20' QUALIFY row_number() OVER (PARTITION BY entity_type, entity_id, agency, v ORDER BY r DESC, event_id DESC) = 1)
SELECT entity_type, entity_id, agency, v AS valid_from, lead(v) OVER (PARTITION BY entity_type, entity_id, agency ORDER BY v) AS valid_to, rating FROM k""",
    "rating_history_area": _RATINGS + """, keys AS (SELECT DISTINCT entity_type, entity_id, agency FROM fact), days AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-09', INTERVAL 1 DAY))::DATE AS day),
cell AS (SELECT f.entity_type, f.entity_id, f.agency, y.day AS y, x.day AS x, arg_max(coalesce(f.rating, -1), (f.v, f.r, f.event_id)) AS rating FROM fact AS f JOIN days AS y ON f.v <= y.day JOIN days AS x ON f.r <= x.day GROUP BY ALL)
SELECT entity_type, entity_id, agency, nullif(rating, -1) AS rating, count(*) AS area FROM cell GROUP BY ALL""",
    "rating_at_purchase": _RATINGS.replace("WITH e AS", f"WITH {LEDGER_SQL.replace('e AS', 'e_ AS', 1).replace('FROM e)', 'FROM e_)')}, e AS") + """, mark AS (SELECT id AS mark_id, instrument_id AS issue, instrument_id % 5 AS issuer, trade_date AS y, trade_date + (id % 5)::INT AS x FROM ledger WHERE event_type = 'BUY'),
got AS (SELECT m.mark_id, f.entity_type, f.rating FROM mark AS m JOIN fact AS f ON f.v <= m.y AND f.r <= m.x AND ((f.entity_type = 'issue' AND f.entity_id = m.issue) OR (f.entity_type = 'issuer' AND f.entity_id = m.issuer))
  QUALIFY row_number() OVER (PARTITION BY m.mark_id, f.entity_type, f.agency ORDER BY f.v DESC, f.r DESC, f.event_id DESC) = 1),
one AS (SELECT mark_id, entity_type, min(rating) AS rating FROM got GROUP BY mark_id, entity_type QUALIFY row_number() OVER (PARTITION BY mark_id ORDER BY min(rating) IS NULL, entity_type) = 1)
SELECT m.mark_id, o.rating, o.entity_type AS source FROM mark AS m LEFT JOIN one AS o USING (mark_id)""",
    "load_entries": f"WITH {LEDGER_SQL} SELECT row_number() OVER (ORDER BY trade_date, id) AS place, id, event_type, trade_date, instrument_id, quantity::DOUBLE AS quantity, amount::DOUBLE AS amount FROM ledger WHERE account_id = 3 AND trade_date <= DATE '{AS_OF}'",
    "ledger_totals": f"WITH {LEDGER_SQL} SELECT account_id, strftime(trade_date, '%Y-%m') AS month, count(*) AS n, sum(amount)::DOUBLE AS amount FROM ledger GROUP BY ALL",
    "save_board_run": f"WITH b AS ({VERIFY_SQL}) SELECT 'r1' AS run_id, 'TQCB' AS board, count(*) AS checked, count(*) FILTER (WHERE note <> 'ok') AS outliers FROM b UNION ALL SELECT 'r2', 'TQCB', count(*), count(*) FILTER (WHERE note <> 'ok') FROM b WHERE secid LIKE '%3'",
    "append_new_keys": f"WITH {LEDGER_SQL}, came AS (SELECT natural_key, account_id, id, CASE WHEN id % 4 = 0 THEN 0 WHEN id % 4 = 1 THEN 1 WHEN id % 4 = 2 THEN 2 ELSE 3 END AS b FROM ledger UNION ALL SELECT natural_key, account_id, id + 1000000000, 1 FROM ledger WHERE id % 5 = 0), one AS (SELECT c.* FROM came AS c JOIN ledger AS l USING (natural_key) QUALIFY row_number() OVER (PARTITION BY natural_key ORDER BY c.b, c.id) = 1) SELECT account_id, count(*) AS n, count(DISTINCT natural_key) AS keys, sum(id)::BIGINT AS ids FROM one GROUP BY 1",
    "order_quantiles": """WITH r AS (SELECT o_orderstatus, o_totalprice AS v, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice))
SELECT o_orderstatus, p AS share, round(sum(v * greatest(0, 1 - abs(k - (n - 1) * p))), 6) AS quantile FROM r, (SELECT unnest([0.0, 0.25, 0.5, 0.9, 0.99, 1.0])::DOUBLE AS p) GROUP BY ALL""",
    "deposit_payments": f"""WITH RECURSIVE t AS (SELECT c_custkey AS id, ((1000 + abs(c_acctbal) * 10)::DECIMAL(24,2) * 100)::BIGINT AS cents, 4 + c_custkey % 15 AS rate, DATE '2024-01-01' + (c_custkey % 120)::INT AS opened, (1 + c_custkey % 24)::INT AS months,
  CASE WHEN c_custkey % 4 = 0 THEN (1 + c_custkey % 24)::INT ELSE [1, 3, 6][c_custkey % 3 + 1] END AS every, c_custkey % 2 = 0 AS cap, CASE WHEN c_custkey % 5 = 0 THEN 360 ELSE 365 END AS base FROM customer),
cal AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2026-12-31', INTERVAL 1 DAY))::DATE AS day),
work AS (SELECT day FROM cal WHERE isodow(day) < 6 AND day NOT IN ({', '.join(f"DATE '{h}'" for h in HOLIDAYS)})),
biz AS (SELECT c.day, w.day AS paid FROM cal AS c ASOF JOIN work AS w ON w.day >= c.day),
sch AS (SELECT t.*, k::INT AS k, CASE WHEN opened = last_day(opened) THEN last_day(opened + to_months(least(k * every, months)::INT)) ELSE (opened + to_months(least(k * every, months)::INT))::DATE END AS due FROM t, LATERAL (SELECT unnest(range(1, ceil(months / every)::INT + 1)) AS k)),
s AS (SELECT sch.*, biz.paid, coalesce(lag(biz.paid) OVER (PARTITION BY id ORDER BY k), opened) AS since, max(k) OVER (PARTITION BY id) AS n FROM sch JOIN biz ON biz.day = sch.due),
w AS (SELECT id, 0 AS k, cents AS bal, 0::BIGINT AS interest FROM t UNION ALL
  SELECT id, k, CASE WHEN cap THEN bal + i ELSE bal END, i FROM (SELECT s.id, s.k, s.cap, w.bal, (2 * w.bal * s.rate * (s.paid - s.since) + 100 * s.base) // (200 * s.base) AS i FROM w JOIN s ON s.id = w.id AND s.k = w.k + 1))
SELECT s.id AS deposit_id, s.k AS n, s.due, s.paid AS paid_on, s.paid - s.since AS days, w.interest / 100.0::DOUBLE AS interest, w.bal / 100.0::DOUBLE AS balance, CASE WHEN s.k = s.n THEN w.bal / 100.0::DOUBLE ELSE 0 END AS principal FROM s JOIN w ON w.id = s.id AND w.k = s.k""",
    "concentration_shares": _SHARES + "SELECT account_id, cut, issuer, currency, kind, value::DOUBLE AS value, round(share, 8) AS share FROM s",
    "concentration_index": _SHARES + ", r AS (SELECT *, row_number() OVER (PARTITION BY account_id, cut ORDER BY share DESC NULLS LAST) AS p FROM s) SELECT account_id, cut, count(*) AS n, round(sum(share * share), 8) AS herfindahl, round(sum(share) FILTER (WHERE p <= 5), 8) AS top_share FROM r GROUP BY ALL",
}
