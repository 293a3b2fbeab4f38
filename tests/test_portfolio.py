"""Identities, values, returns, ratings, the committed ledger, quantiles, deposits and concentration against plain Python."""

import math
import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import bitemporal, identities, returns, store
from tallyforge.operators.concentration import concentration, herfindahl
from tallyforge.operators.connected import components
from tallyforge.operators.deposits import deposit_schedule
from tallyforge.operators.quantiles import exact_quantiles
from tallyforge.streaming import ingest

DAY = date(2024, 1, 1)
LEDGER = "id long, natural_key string, account_id int, instrument_id int, event_type string, trade_date date, quantity decimal(28,10), price decimal(28,10), amount decimal(24,6)"


def at(n):
    return DAY + timedelta(days=n)


def plain_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_of_chains_hubs_and_random_graphs(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(1_000, 1_200)] + [(5_000, i) for i in range(6_000, 6_300)] + [(r.randrange(500), r.randrange(500)) for _ in range(260)] + [(77_777, 77_777)]
    d = spark.createDataFrame([*edges, (None, 3), (4, None), edges[0]], "a long, b long")
    assert {x.node: x.label for x in components(d).collect()} == plain_components(edges)
    assert components(d.limit(0)).count() == 0


def test_chains_of_mentions(spark):
    known = spark.createDataFrame([(7, "AA", None), (8, None, "RU0000000008"), (9, "CC", "RU0000000009")], "instrument_id long, ticker string, isin string")
    isin = lambda n: f"RU{n:010d}"
    rows = [
        (1, "P", isin(100)), (2, "Q", isin(100)), (3, "Q", isin(101)), (4, None, isin(101)),  # a new one, through four codes
        (5, "aa", isin(102)), (6, "BB", isin(102)), (7, "BB", None),  # known by AA
        (8, "CC", isin(103)), (9, "DD", isin(103)), (10, "DD", isin(8)), (11, "DD", None), (12, None, isin(103)),  # joins 8 and 9
        (13, None, None), (14, "ZZ", None),
    ]
    m = spark.createDataFrame(rows, "seq long, ticker string, isin string")
    got, codes, lost = identities.resolve_chains(m, known)
    ids = {r.seq: r.instrument_id for r in got.collect()}
    assert [ids[i] for i in (1, 2, 3, 4)] == [10] * 4 and [ids[i] for i in (5, 6, 7)] == [7] * 3
    assert ids[8] == 9 and ids[10] == 8 and ids[13] is None and ids[14] == 11
    assert sorted(r.seq for r in lost.collect()) == [9, 11, 12]
    mine = {(r.instrument_id, r.code) for r in codes.collect()}
    assert {(7, "TAA"), (7, "TBB"), (7, "I" + isin(102)), (8, "I" + isin(8)), (9, "TCC"), (10, "TQ"), (11, "TZZ")} <= mine and (9, "TDD") not in mine
    assert identities.resolve_chains(m, known.limit(0))[0].where("seq = 8").first().instrument_id is not None
    assert identities.resolve_chains(m.limit(0), known)[0].count() == 0


@pytest.fixture(scope="module")
def story(spark):
    """Three accounts over four months; one instrument is held before its first price, some prices are missing."""
    r, rows, prices = random.Random(4), [], {}
    for n in range(300):
        day, account, instrument = at(r.randrange(110)), r.randrange(3), r.randrange(4)
        q = Decimal(r.randint(-3, 6))
        rows.append((n, f"k{n}", account, instrument, "BUY" if q > 0 else "SELL", day, q, Decimal(10), -q * 10))
    rows += [(1_000 + a, f"c{a}", a, None, "CASH_IN", DAY, None, None, Decimal(10_000)) for a in range(3)]
    rows += [(2_000, "out", 1, None, "CASH_OUT", at(119), None, None, Decimal(-500)), (2_001, "late", 1, None, "CASH_IN", at(150), None, None, Decimal(1))]
    for i in range(3):
        for n in range(40 * (i == 2), 100, 1 + 6 * i):
            prices[i, at(n)] = Decimal(r.randint(5, 20))
    return spark.createDataFrame(rows, LEDGER), spark.createDataFrame([(i, d, p) for (i, d), p in prices.items()], "instrument_id int, day date, price decimal(28,10)"), rows, prices


def test_daily_values_equal_loops(story):
    ledger, prices, rows, known = story
    got = {(r.account_id, r.day): r for r in returns.daily_nav(ledger, prices, at(120)).collect()}
    for a in range(3):
        for n in range(121):
            day, cash, value, flow, stale, unpriced = at(n), Decimal(0), Decimal(0), Decimal(0), 0, 0
            held = {}
            for _, _, account, i, kind, d, q, _, amount in rows:
                if account == a and d <= day:
                    cash += amount
                    flow += amount if d == day and kind.startswith("CASH") else 0
                    if i is not None:
                        held[i] = held.get(i, 0) + q
            for i, q in held.items():
                if q:
                    days = [d for (j, d) in known if j == i and d <= day]
                    value += q * known[i, max(days)] if days else 0
                    stale += bool(days) and max(days) < day
                    unpriced += not days
            r = got.pop((a, day))
            assert (r.cash, r.securities, r.nav, r.external_flow, r.stale, r.unpriced) == (cash, value, cash + value, flow, stale, unpriced)
    assert not got


def test_prices_are_carried_over_gaps_of_months(spark):
    p = spark.createDataFrame([(1, at(3), 5.0), (1, at(95), 6.0), (2, at(31), 7.0), (2, at(32), None)], "instrument_id int, day date, price double")
    got = {(r.instrument_id, r.day): (r.price, r.priced_on) for r in returns.asof_prices(p, at(100)).collect()}
    assert len(got) == 98 + 70 and got[1, at(94)] == (5.0, at(3)) and got[1, at(95)] == (6.0, at(95)) and got[2, at(100)] == (7.0, at(31))


def nav_rows(spark, rows):
    return spark.createDataFrame([(a, at(n), float(v), f) for a, n, v, f in rows], "account_id int, day date, nav double, external_flow double")


def test_time_weighted_chains(spark):
    rows = [(1, 0, 100, 100.0), (1, 1, 110, None), (1, 2, 160, 50.0), (1, 40, 176, 0.0), (1, 41, 76, -100.0)]  # flows on the first and the last day
    rows += [(2, 0, 100, 100.0), (2, 1, 0, -100.0), (2, 2, 50, 50.0), (2, 3, 55, 0.0), (3, 0, -5, 0.0), (3, 1, 7, 0.0), (4, 0, 9, 9.0)]
    got = {r.account_id: r for r in returns.time_weighted(nav_rows(spark, rows)).collect()}
    assert got[1].twr == pytest.approx(1.1 * 1.0 * 1.1 * 1.0 - 1) and got[1].days == 5
    assert got[2].twr == pytest.approx(0.1) and got[2].restarts == 1
    assert got[3].twr is None and got[4].twr == 0


def test_money_weighted_roots(spark):
    flows = [(1, 0, -100), (1, 365, 110), (2, 0, -100), (2, 365, 230), (2, 730, -132), (3, 0, 5), (3, 9, 7), (4, 0, -100), (4, 10, 0), (4, 400, 30), (5, 0, 100), (5, 365, -120), (6, 0, -1), (6, 0, 1)]
    d = spark.createDataFrame([(k, at(n), Decimal(a)) for k, n, a in [*flows, (7, None if False else 3, 4)]] + [(7, None, Decimal(1))], "account_id int, day date, amount decimal(18,2)")
    got = {r.account_id: r for r in returns.money_weighted(d).collect()}
    assert got[1].xirr == pytest.approx(0.1) and got[5].xirr == pytest.approx(0.2)
    assert got[2].roots == 2 and got[2].xirr is None  # 10 % and 20 %
    assert got[3].xirr is None and got[7].xirr is None and 6 not in got
    assert got[4].xirr == pytest.approx(0.3 ** (365 / 400) - 1)


def test_roots_equal_plain_loops_and_need_no_column_loops(spark):
    r = random.Random(5)
    flows = [(k, r.randrange(2000), r.choice((-90, -20, 7, 35, 100))) for k in range(60) for _ in range(r.randint(1, 9))]
    d = spark.createDataFrame([(k, at(n), Decimal(a)) for k, n, a in flows], "account_id int, day date, amount decimal(18,2)")
    got = returns.money_weighted(d)
    assert "aggregate(" not in got._jdf.queryExecution().executedPlan().toString()
    bottom, top, grid = math.log(1 + returns.LOW), math.log(1 + returns.HIGH), returns.GRID
    for x in got.collect():
        days = {}
        for k, n, a in flows:
            if k == x.account_id:
                days[n] = days.get(n, 0) + a
        days = sorted((n, a) for n, a in days.items() if a)
        worth = lambda y: sum(a * math.exp(-y * (n - days[0][0]) / 365) for n, a in days)
        ys = [bottom + (top - bottom) * j / grid for j in range(grid + 1)]
        turns = [j for j in range(grid) if (worth(ys[j]) > 0) != (worth(ys[j + 1]) > 0)]
        assert (x.flows, x.roots) == (len(days), len(turns)) and (x.xirr is not None) == (len(turns) == 1)
        if len(turns) == 1:
            assert worth(ys[turns[0]]) * worth(ys[turns[0] + 1]) <= 0 and abs(worth(math.log(1 + x.xirr))) < 1e-6


def test_rectangles_equal_looking_up_every_cell(spark):
    r = random.Random(6)
    facts = [(k, at(r.randrange(25)), at(r.randrange(25)), r.choice([None, 1, 2, 3]), n) for k in ("a", "b", None) for n in range(60)]
    d = spark.createDataFrame([*facts, ("a", None, DAY, 1, 9), ("a", DAY, None, 1, 9)], "entity string, valid_from date, recorded_at date, rating int, n int")
    rects = bitemporal.rectangles(d, ["entity"], "rating", "n")
    table = rects.collect()
    assert len(table) <= 2 * len(facts)
    for k in ("a", "b", None):
        for y in range(0, 30):
            for x in range(0, 30):
                known = [f for f in facts if f[0] == k and f[1] <= at(y) and f[2] <= at(x)]
                want = max(known, key=lambda f: (f[1], f[2], f[4]))[3:4] if known else ()
                cover = [t for t in table if t.entity == k and t.valid_from <= at(y) and (t.valid_to is None or at(y) < t.valid_to) and t.known_from <= at(x) and (t.known_to is None or at(x) < t.known_to)]
                assert tuple(t.value for t in cover) == want
    marks = spark.createDataFrame([(i, r.choice(["a", "b", "c", None]), at(r.randrange(800)), at(r.randrange(800))) for i in range(200)], "mark long, entity string, valid_on date, known_on date")
    got = bitemporal.as_known(rects, marks, ["entity"]).collect()
    assert len({g.mark for g in got}) == len(got)
    for g in got:
        known = [f for f in facts if f[0] == g.entity and f[1] <= g.valid_on and f[2] <= g.known_on]
        assert g.value == max(known, key=lambda f: (f[1], f[2], f[4]))[3]
    assert bitemporal.as_known(rects, marks.limit(0), ["entity"]).count() == 0


def test_withdrawn_is_a_state(spark):
    facts = [("issue", 1, 0, DAY, DAY, 5, 1), ("issue", 1, 0, at(10), at(10), None, 2), ("issuer", 9, 0, DAY, DAY, 3, 3), ("issue", 2, 0, DAY, DAY, None, 4)]
    d = spark.createDataFrame(facts, "entity_type string, entity_id int, agency int, valid_from date, recorded_at date, rating int, n int")
    rects = bitemporal.rectangles(d, ["entity_type", "entity_id", "agency"], "rating", "n")
    marks = spark.createDataFrame([(1, 1, 9, at(5), at(5)), (2, 1, 9, at(11), at(11)), (3, 2, None, at(5), at(5)), (4, 3, 8, at(5), at(5)), (5, 1, 9, at(11), at(9))], "mark_id int, issue int, issuer int, valid_on date, known_on date")
    got = {r.mark_id: (r.rating, r.source) for r in bitemporal.resolved(rects, marks).collect()}
    assert got == {1: (5, "issue"), 2: (3, "issuer"), 3: (None, "issue"), 4: (None, None), 5: (5, "issue")}


def entries(spark, ids, factor=1, keys=None):
    return spark.createDataFrame([(i, f"k{i if keys is None else keys}", i % 3, 1, "BUY", at(i % 90), Decimal(1), Decimal(1), Decimal(factor * i)) for i in ids], LEDGER)


def test_commits_are_whole_and_replace_themselves(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/ledger"
    assert store.read(spark, root) is None
    with pytest.raises(FileNotFoundError):
        store.load(spark, root, 1)
    assert store.commit(entries(spark, range(50)), root, "a") == 1
    store.commit(entries(spark, range(50, 90), 7), root, "b")
    store.commit(entries(spark, range(50, 90)), root, "b")
    assert store.read(spark, root).agg(F.sum("amount")).first()[0] == sum(range(90))
    assert store.read(spark, root, number=1).count() == 50 and store.read(spark, root, without="a").count() == 40
    real = store._publish

    def crash(*a):
        raise OSError("lost")

    monkeypatch.setattr(store, "_publish", crash)  # all files are written, the manifest is not
    with pytest.raises(OSError):
        store.commit(entries(spark, range(500, 600)), root, "c")
    assert store.read(spark, root).count() == 90 and store.manifest(spark, root)[0] == 3

    def raced(spark_, root_, number, content):  # another writer takes the number first, once
        monkeypatch.setattr(store, "_publish", real)
        store.commit(entries(spark, range(90, 95)), root, "d")
        real(spark_, root_, number, content)

    monkeypatch.setattr(store, "_publish", raced)
    assert store.commit(entries(spark, range(95, 100)), root, "c") == 5
    assert store.read(spark, root).count() == 100
    got = store.load(spark, root, 2, at(40)).collect()
    want = sorted((i for i in range(100) if i % 3 == 2 and i % 90 <= 40), key=lambda i: (i % 90, i))
    assert [r.id for r in got] == want
    plan = store.load(spark, root, 2, at(40))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(store.swept(spark, root)) == 2 and store.read(spark, root).count() == 100
    store.commit(entries(spark, [200]).withColumn("note", F.lit("new")), root, "e")
    assert store.read(spark, root).where("note IS NULL").count() == 100
    with pytest.raises(TypeError):
        store.commit(entries(spark, [201]).withColumn("id", F.col("id").cast("string")), root, "f")


def test_a_key_that_comes_again_after_41_days_adds_nothing(spark, tmp_path):
    root, src = f"file://{tmp_path}/ledger", tmp_path / "in"
    schema = entries(spark, [1]).schema

    def arrive(name, rows):
        rows.coalesce(1).write.parquet(str(src / name))
        q = ingest.dedupe_into(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(src)), root, str(tmp_path / "c"))
        q.awaitTermination()
        assert q.exception() is None

    arrive("day0", entries(spark, [1, 2, 3]))
    later = entries(spark, [1, 2, 3, 4]).withColumn("trade_date", F.date_add("trade_date", 41)).withColumn("id", F.col("id") + 100)
    arrive("day41", later)
    arrive("day42", entries(spark, [5]).unionByName(entries(spark, [6]).withColumn("natural_key", F.lit(None).cast("string"))))
    assert sorted(r.id for r in store.read(spark, root).collect()) == [1, 2, 3, 5, 6, 104]


def test_a_batch_is_computed_once(spark, tmp_path):
    rows = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            rows.add(len(b))
            yield b

    e = entries(spark, range(1, 41)).withColumn("natural_key", F.when(F.col("id") % 4 > 0, F.col("natural_key")))
    ingest.append_new(e.mapInPandas(count, e.schema), f"file://{tmp_path}/once", 0)
    assert rows.value == 40 and store.read(spark, f"file://{tmp_path}/once").count() == 40


def test_quantiles_equal_percentile(spark):
    r = random.Random(8)
    rows = [("big", r.choice([1.0, 2.0, r.expovariate(1), 1e300 * r.random(), -r.random()])) for _ in range(4_000)] + [("one", 3.0), ("two", -1e308), ("two", 1e308), (None, 5.0), (None, 7.0), ("none", None), ("nan", float("nan"))]
    d = spark.createDataFrame(rows, "g string, v double").repartition(7)
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    want = {r.g: list(r.q) for r in d.where("v IS NOT NULL AND NOT isnan(v)").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    got = {}
    for x in exact_quantiles(d, ["g"], "v", shares, bins=8).collect():
        got.setdefault(x.g, {})[x.share] = x.quantile
    assert set(got) == set(want) == {"big", "one", "two", None}
    for g, q in want.items():
        assert [got[g][p] for p in shares] == pytest.approx(q)
    assert exact_quantiles(d.limit(0), ["g"], "v", shares).count() == 0


def test_deposits_by_hand(spark):
    terms = [
        (1, Decimal(1000), Decimal(12), date(2024, 1, 31), 3, 1, True, 365), (2, Decimal(1000), Decimal(12), date(2024, 1, 31), 3, 1, False, 365),
        (3, Decimal(500), Decimal(10), date(2024, 2, 29), 12, None, True, 360), (4, None, Decimal(1), DAY, 3, 1, True, 365), (5, Decimal(1), Decimal(1), DAY, 0, 1, True, 365), (6, Decimal(100), Decimal(6), date(2024, 1, 15), 5, 2, True, 365),
    ]
    d = spark.createDataFrame(terms, "deposit_id int, amount decimal(24,2), rate_pct decimal(9,4), opened date, months int, every int, capitalised boolean, base int")
    got = {}
    for r in deposit_schedule(d, ["2024-04-30"]).orderBy("deposit_id", "n").collect():
        got.setdefault(r.deposit_id, []).append(r)
    assert sorted(got) == [1, 2, 3, 6]
    assert [r.due for r in got[1]] == [date(2024, 2, 29), date(2024, 3, 31), date(2024, 4, 30)]
    assert [r.paid_on for r in got[1]] == [date(2024, 2, 29), date(2024, 4, 1), date(2024, 5, 1)]  # a Sunday, a holiday
    balance = Decimal(1000)
    for r, days in zip(got[1], (29, 32, 30)):
        i = (balance * 12 * days / Decimal(36500)).quantize(Decimal("0.01"))
        balance += i
        assert (r.days, r.interest, r.balance) == (days, i, balance)
    assert got[1][-1].principal == balance and got[2][-1].principal == 1000 and {r.balance for r in got[2]} == {1000}
    assert [(r.due, r.n) for r in got[3]] == [(date(2025, 2, 28), 1)] and [r.due for r in got[6]] == [date(2024, 3, 15), date(2024, 5, 15), date(2024, 6, 15)]


def test_concentration_by_hand(spark):
    rows = [(1, "A", "RUB", 60.0), (1, "A", "USD", 20.0), (1, "B", "RUB", 20.0), (2, "A", "RUB", -5.0), (1, None, "RUB", 0.0)]
    d = spark.createDataFrame(rows, "account_id int, issuer string, currency string, value double")
    s = concentration(d, "account_id", [["issuer"], ["currency"]])
    got = {(r.account_id, r.cut, r.issuer, r.currency): r.share for r in s.collect()}
    assert got[1, 1, "A", None] == pytest.approx(0.8) and got[1, 2, None, "RUB"] == pytest.approx(0.8) and got[1, 3, None, None] == 1 and got[1, 1, None, None] == 0
    assert got[2, 1, "A", None] is None
    h = {(r.account_id, r.cut): r for r in herfindahl(s, "account_id").collect()}
    assert h[1, 1].herfindahl == pytest.approx(0.68) and h[1, 1].top_share == pytest.approx(1) and h[1, 1].n == 3 and math.isclose(h[1, 3].herfindahl, 1)
