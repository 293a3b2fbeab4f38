import random
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tallyforge.functions import cleaning as c
from tallyforge.operators import bonds as B
from tallyforge.operators import ledger as L
from tallyforge.operators import projections as P


def test_numbers(spark):
    cases = {"1 234,56": "1234.56", "-1 234.56": "-1234.56", "(1 234,56)": "-1234.56", "1.234,56": "1234.56", "1,234.56": "1234.56", "1,234": "1.234", "1.234.567": "1234567", "(-5)": "5", "100 руб.": "100", "+7": "7", "1 2 3,4,5": None, "abc": None, "": None, "—": None}
    got = spark.createDataFrame(list(cases.items()), "s string, want string").select("s", c.parse_decimal(F.col("s")).alias("v"), F.col("want").cast("decimal(28,10)").alias("w")).collect()
    assert [(r.s, r.v) for r in got] == [(r.s, r.w) for r in got]


def test_dates(spark):
    cases = [("01.02.2024", date(2024, 2, 1)), ("1.2.99", date(1999, 2, 1)), ("2024-02-01T10:00", date(2024, 2, 1)), ("1/2/2024", date(2024, 2, 1)), ("2024.2.1", date(2024, 2, 1)), ("31.02.2024", None), (None, None)]
    got = spark.createDataFrame(cases, "s string, want date").select("s", "want", c.parse_date(F.col("s")).alias("d")).collect()
    assert [r.d for r in got] == [r.want for r in got]


def fifo(rows):
    lots, net = [], Decimal(0)
    for r in rows:
        q = r[3]
        net += q
        if q > 0:
            lots.append([r[0], q])
        eat = -q
        while eat > 0 and lots:
            take = min(eat, lots[0][1])
            lots[0][1] -= take
            eat -= take
            if lots[0][1] == 0:
                lots.pop(0)
    return {i: q for i, q in lots} if net else {}


def test_fifo_equals_the_loop(spark):
    r = random.Random(1)
    rows = [(i, r.randint(0, 20), date(2024, 1, 1) + timedelta(r.randint(0, 30)), Decimal(r.randint(-9, 9))) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, instrument_id int, trade_date date, quantity decimal(28,10)").withColumns({"event_type": F.lit("BUY"), "account_id": F.lit(1), "price": F.lit(None).cast("decimal(28,10)"), "cost_basis": F.lit(None).cast("decimal(28,10)")})
    got = {x.id: x.remaining for x in P.fifo_lots(df).collect()}
    want = {}
    for k in range(21):
        want |= fifo(sorted((x for x in rows if x[1] == k), key=lambda x: (x[2], x[0])))
    assert got == want


def test_par_bond_yields_its_coupon(spark):
    df = spark.createDataFrame([(0.1, 5), (0.03, 1), (0.2, 10)], "rate double, n int")
    flows = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct(i.cast("double").alias("t"), (1000 * F.col("rate") + F.when(i == F.col("n"), 1000.0).otherwise(0.0)).alias("a")))
    x = df.withColumn("flows", flows)
    got = x.select("rate", B.solve_yield(F.col("flows"), F.lit(1000.0)).alias("y"), B.solve_yield(F.col("flows"), F.lit(0.0)).alias("none")).collect()
    assert all(abs(r.rate - r.y) < 1e-9 and r.none is None for r in got)


def test_actual_actual(spark):
    r = spark.sql("select date'2023-07-01' a, date'2025-03-01' b").select(B.year_fraction(F.col("a"), F.col("b"), "actact").alias("x"), B.year_fraction(F.col("a"), F.col("b"), "30/360").alias("y")).first()
    assert abs(r.x - (184 / 365 + 1 + 59 / 365)) < 1e-12 and abs(r.y - 600 / 360) < 1e-12


def test_number_text(spark):
    got = [r.t for r in spark.createDataFrame([("10.00",), ("10",), ("100.50",), (None,)], "s string").select(L.number_text(F.col("s")).alias("t")).collect()]
    assert got == ["10", "10", "100.5", ""]


def test_keys_are_the_same_under_both_settings(spark):
    d = spark.createDataFrame([(Decimal(x),) for x in ("0", "0.0000001", "-0.5", "12345678901234567.1000000000", "-3", "100")] + [(None,)], "q decimal(28,10)")
    want = ["0", "0.0000001", "-0.5", "12345678901234567.1", "-3", "100", ""]
    before = spark.conf.get("spark.sql.ansi.enabled")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        got = [r.t for r in d.select(L.number_text(F.col("q")).alias("t")).collect()]
        keys = [r.t for r in d.select(L.number_text(F.col("q").cast("decimal(24,6)")).alias("t")).collect()]
        assert got == want and keys[1] == "0"
    spark.conf.set("spark.sql.ansi.enabled", before)


def test_reversed_years_are_negative(spark):
    x = spark.sql("select date'2025-03-01' a, date'2023-07-01' b").select(B.year_fraction(F.col("a"), F.col("b"), "actact").alias("x"), B.year_fraction(F.col("a"), F.col("a"), "actact").alias("z")).first()
    assert abs(x.x + (184 / 365 + 1 + 59 / 365)) < 1e-12 and x.z == 0


def halved(flows, price, simple):
    pv = lambda y: sum(a / ((1 + y * t) if simple else (1 + y) ** t) for t, a in flows)
    lo, hi = (max(B.LOW, -1 / max(t for t, _ in flows) + 1e-9) if simple else B.LOW), B.HIGH
    if not flows or price <= 0 or pv(lo) < price or pv(hi) > price:
        return None
    for _ in range(200):
        lo, hi = ((lo + hi) / 2, hi) if pv((lo + hi) / 2) > price else (lo, (lo + hi) / 2)
    return (lo + hi) / 2


def test_yields_equal_halving(spark):
    r, rows = random.Random(4), []
    for i in range(600):
        n = r.randint(1, 40)
        flows = [(round(r.uniform(0.01, 30 if i % 3 else 2), 4), r.choice((0.5, 40.0, 1000.0))) for _ in range(n)]
        total = sum(a for _, a in flows)
        rows.append((i, sorted(flows), total * r.choice((0.001, 0.05, 0.3, 0.8, 1.0, 1.3, 4.0, 60.0))))
    d = spark.createDataFrame(rows, "i int, flows array<struct<t:double,a:double>>, price double")
    for simple in (False, True):
        got = {x.i: x.y for x in d.select("i", B.solve_yield(F.col("flows"), F.col("price"), simple).alias("y")).collect()}
        for i, flows, price in rows:
            want = halved(flows, price, simple)
            assert (got[i] is None) == (want is None) and (want is None or abs(got[i] - want) <= 1e-8 * max(1, abs(want))), (i, got[i], want)


def test_offer_price_and_kind(spark):
    day = lambda s: F.lit(s).cast("date")
    ask = spark.createDataFrame([("A",)], "secid string").withColumn("on_date", day("2025-01-01"))
    issues = ask.select("secid", F.lit(1000).cast("decimal(24,6)").alias("initial_face"))
    coupons = spark.createDataFrame([("A", "2025-01-01", "2026-01-01", Decimal(100)), ("A", "2026-01-01", "2027-01-01", None)], "secid string, s string, p string, amount decimal(24,6)")
    coupons = coupons.select("secid", F.col("s").cast("date").alias("period_start"), F.col("p").cast("date").alias("pay_date"), "amount")
    parts = spark.createDataFrame([("A", "2027-01-01", Decimal(1000))], "secid string, p string, amount decimal(24,6)").select("secid", F.col("p").cast("date").alias("pay_date"), "amount")
    offers = spark.createDataFrame([("A", "2026-01-01", "put", Decimal(105)), ("A", "2025-06-01", "call", None)], "secid string, d string, kind string, price_pct decimal(24,6)").select("secid", F.col("d").cast("date").alias("offer_date"), "kind", "price_pct")
    for kinds, flows in ((("put",), [100, 1050]), (None, [1000]), (("swap",), [])):
        at = B.next_offers(ask, offers, kinds)
        assert sorted(float(x.amount) for x in B.offer_flows(at, issues, coupons, parts).collect()) == flows
    f = B.flow_arrays(B.offer_flows(B.next_offers(ask, offers, ("put",)), issues, coupons, parts))
    assert abs(f.select(B.solve_yield(F.col("flows"), F.lit(1000.0)).alias("y")).first().y - 0.15) < 1e-9


def test_days_half_up(spark):
    got = spark.createDataFrame([(0.00136987,), (1.49999 / 365,), (2.0,), (None,)], "y double").select(B.duration_days(F.col("y")).alias("d")).collect()
    assert [r.d for r in got] == [1, 1, 730, None]


def test_lots_over_months(spark):
    r = random.Random(7)
    rows = [(i, r.randint(0, 5), date(2023, 1, 1) + timedelta(r.randint(0, 900)), Decimal(r.randint(-9, 9))) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, instrument_id int, trade_date date, quantity decimal(28,10)").withColumns({"event_type": F.lit("BUY"), "account_id": F.lit(1), "price": F.lit(1), "cost_basis": F.lit(1)})
    got, want = {x.id: x.remaining for x in P.fifo_lots(df).collect()}, {}
    for k in range(6):
        want |= fifo(sorted((x for x in rows if x[1] == k), key=lambda x: (x[2], x[0])))
    assert got == want


def test_board_run_is_saved(spark, tmp_path):
    from tallyforge.operators import verification as V
    from tallyforge.plans import demo

    issues = demo.demo_issues(spark, "/root/testdata/sf0.001")
    frames = {"issues": issues, "coupons": demo.demo_coupons(issues), "amortizations": demo.demo_amortizations(issues), "offers": demo.demo_offers(issues)}
    quotes = demo.demo_quotes(issues).withColumns({"published_accrued": F.lit(None).cast("decimal(24,6)"), "published_duration": F.lit(1)})
    top, spread, worst = V.run_board(quotes, frames, f"{tmp_path}/runs", "one", day="2025-03-01")
    assert top.first().checked == quotes.count() and spread.count() == 2 and worst.where("NOT outlier").count() == 0
