import json
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import imports as I
from tallyforge.operators import schedules as S
from tallyforge.operators.identities import guess_kind, resolve_accounts, resolve_instruments
from tallyforge.plans.source_queries import NO_ACCOUNTS, NO_INSTRUMENTS
from tallyforge.sources import declarative_csv as C
from tallyforge.sources import snapshots as N
from tallyforge.sources.statements import statements
from tallyforge.streaming.ingest import ingest_reports_stream, ledger_dedupe_stream

OPENING = '﻿id\taccount\tdate\tticker\tisin\tquantity\tcost_basis\tbasis_quality\tcurrency\r\no1\tA\t01.02.2025\tAAA\t\t10\t5,5\tknown\t\r\n\t\t\t\t\t\t\t\t\r\no2\tA\t2025-02-01\t\t\t1 000,50\t\tunknown\tusd\r\n'
PAGE = """<html><body><p>Отчет брокера за период с 01.08.2025 по 31.08.2025, договор № {0}</p>
<div><h2>Сделки с ценными бумагами</h2><table><tr><th>Номер сделки<th>Дата сделки<th>Тикер<th>Вид<th>Количество<th>Цена</tr><tr><td>1<td>01.08.2025<td>AAA<td>Покупка<td>10<td>7</tr></table></div>
<div><h2>Движение денежных средств</h2><table><tr><th>Дата<th>Описание операции<th>Зачислено<th>Списано</tr><tr><td>01.08.2025<td>Пополнение счета<td>100<td></tr><tr><td>01.08.2025<td>Пополнение счета<td>100<td></tr></table></div>
<div><h2>Остатки денежных средств</h2><table><tr><th>Валюта<th>Исходящий остаток</tr><tr><td>RUB<td>{1}</tr></table></div>
<div><h2>Остатки по ценным бумагам</h2><table><tr><th>Тикер<th>Исходящий остаток</tr><tr><td>AAA<td>10</tr></table></div></body></html>"""


def csv_of(spark, *files):
    return C.declared_rows(C.csv_records(spark.createDataFrame(files, "file string, content string")))


def test_csv_rows_problems_and_entries(spark, tmp_path):
    bad = 'id,account,date,kind,amount\nf1,A,01.02.2025,cash_out,"1,5"\nf1,A,01.02.2025,CASH_IN,2\n\n,A,x,GIFT,\n'
    r = csv_of(spark, ("opening.tsv", OPENING), ("flow.csv", bad), ("empty.csv", ""), ("none.csv", None), ("cash.csv", "key,id\n1,2\n"), ("what.csv", "id,x\n1,2\n"))
    assert sorted((x.file, x.problem) for x in C.file_problems(r).collect()) == [
        ("cash.csv", "the first column is not id: key"), ("empty.csv", "the file is empty"), ("flow.csv", "line 3, field id: already in line 2"), ("flow.csv", "line 4, field amount: "), ("flow.csv", "line 4, field date: x"),
        ("flow.csv", "line 4, field id: "), ("flow.csv", "line 4, field kind: GIFT"), ("none.csv", "the file is empty"), ("what.csv", "the kind of file is unknown"),
    ]
    e = C.declared_entries(C.sound_rows(r)).orderBy("source_row_id").collect()
    assert [(x.event_type, x.quantity, x.amount, x.currency, x.cost_basis, x.trade_date) for x in e] == [
        ("OPENING_BALANCE", Decimal(10), Decimal(0), "RUB", Decimal("5.5"), date(2025, 2, 1)), ("OPENING_BALANCE", None, Decimal("1000.5"), "USD", None, date(2025, 2, 1)),
    ]
    (tmp_path / "opening.tsv").write_text(OPENING)
    assert C.read_declared(spark, str(tmp_path)).count() == 2
    assert csv_of(spark, ("cash.csv", 'id,account,date,kind,amount,note\nf1,A,1.2.2025,CASH_IN,3,"two\nlines"\n')).first().note == "two\nlines"


def test_declared_state_comes_goes_and_comes_again(spark, tmp_path):
    path, head = str(tmp_path / "ledger"), "id,account,date,kind,amount\n"
    ledger = I.as_ledger(spark.createDataFrame([], "id long"))
    accounts, instruments = spark.createDataFrame([], NO_ACCOUNTS), spark.createDataFrame([], NO_INSTRUMENTS)
    for text in ("a,A,1.1.2025,CASH_IN,5\nb,A,1.1.2025,CASH_OUT,2\n", "a,A,1.1.2025,CASH_IN,6\n", "a,A,1.1.2025,CASH_IN,6\nb,A,1.1.2025,CASH_OUT,2\n"):
        done = I.import_declared(csv_of(spark, ("cash.csv", head + text)), ledger, accounts, instruments)
        I.commit(done, ledger, path)
        ledger, accounts = spark.read.parquet(path), done.accounts
    got = [(r.id, r.natural_key.split(":")[0] == "reversal", r.natural_key[40:] if "reversal" not in r.natural_key else "", r.source_row_id[-1], int(r.amount), r.reverses_id) for r in ledger.orderBy("id").collect()]
    assert sorted(got[:2], key=lambda r: r[3]) == [(got[0][0] if got[0][3] == "a" else 1, False, "", "a", 5, None), (got[0][0] if got[0][3] == "b" else 1, False, "", "b", -2, None)]
    assert sorted((x[0] < 5, *x[1:5]) for x in got[2:]) == sorted([(True, True, "", "a", -5), (True, True, "", "b", 2), (True, False, ":r1", "a", 6), (False, False, ":r1", "b", -2)])
    assert [r[0] for r in got] == list(range(6)) and accounts.count() == 1


def test_statements_are_imported_once_and_only_if_they_reconcile(spark, tmp_path):
    pages = [("good", PAGE.format("A-1", "130")), ("wrong", PAGE.format("B-2", "131"))]
    parsed = statements(spark.createDataFrame(pages, "report string, html string"), "report", "html")
    none, path = I.as_ledger(spark.createDataFrame([], "id long")), str(tmp_path / "ledger")
    accounts, instruments = spark.createDataFrame([], NO_ACCOUNTS), spark.createDataFrame([], NO_INSTRUMENTS)
    done = I.import_statements(parsed, none, accounts, instruments)
    assert {r.report: r.committed for r in done.reports.collect()} == {"good": True, "wrong": False}
    assert [(r.report_id, r.kind, r.key, r.difference) for r in done.discrepancies.collect()] == [("wrong", "cash", "RUB", Decimal(-1))]
    assert sorted((r.event_type, int(r.amount)) for r in done.rows.collect()) == [("BUY", -70), ("CASH_IN", 100), ("CASH_IN", 100)]
    assert done.rejects.count() == 0 and done.unparsed.count() == 0 and [r.ticker for r in done.instruments.collect()] == ["AAA"]
    I.commit(done, none, path)
    again = I.import_statements(parsed, spark.read.parquet(path), done.accounts, done.instruments, force=True)
    assert sorted((r.source_report, r.action) for r in again.diff.collect()) == [("good", "unchanged")] * 3 + [("wrong", "new")] * 3
    assert {r.note for r in again.rows.collect() if r.event_type == "BUY"} == {"has discrepancies"}


def test_instruments_link_by_isin_then_ticker(spark):
    known = spark.createDataFrame([(7, "OLD", None, None, "other", None), (8, None, "US0000000001", "x", "bond", "USD")], NO_INSTRUMENTS)
    said = [(1, " old ", None, "Fund ETF"), (2, "NEW", "RU000A000002", "n"), (3, "NEW", None, None), (4, None, None, None), (5, "OLD", "US0000000001", None), (6, "TWO", "RU0000000003", None), (7, "TWO", "RU0000000011", None), (8, "TWO", None, None), (9, None, "US0000000001", None)]
    m = spark.createDataFrame([(*r, "RUB") for r in said], "seq long, ticker string, isin string, name string, currency string")
    rows, dim, lost = resolve_instruments(m, known)
    ids = {r.seq: r.instrument_id for r in rows.collect()}
    assert ids == {1: 7, 2: 9, 3: 9, 4: None, 5: 8, 6: 10, 7: 11, 9: 8} and [r.seq for r in lost.collect()] == [8]
    d = {r.instrument_id: (r.ticker, r.isin, r.name, r.kind, r.currency) for r in dim.collect()}
    assert d[7] == ("OLD", None, "Fund ETF", "etf", "RUB") and d[8] == (None, "US0000000001", "x", "bond", "USD") and d[9] == ("NEW", "RU000A000002", "n", "bond", "RUB")
    k = spark.createDataFrame([("SU26240RMFS0", None), ("", "облигация")], "t string, n string").select(guess_kind(F.col("t"), F.lit(None).cast("string"), F.col("n")).alias("k"))
    assert [r.k for r in k.collect()] == ["bond", "bond"]


def test_accounts_and_the_only_account(spark):
    rows = spark.createDataFrame([("A",), (" B ",), (None,)], "account string")
    one = spark.createDataFrame([(3, "A", "n", "BROKER", "RUB")], NO_ACCOUNTS)
    x, after, lost = resolve_accounts(rows, one)
    assert sorted(r.account_id for r in x.collect()) == [3, 3, 4] and after.count() == 2 and lost.count() == 0
    assert resolve_accounts(rows, after)[2].count() == 1


def answers(spark, *payloads):
    return spark.createDataFrame([(k, json.dumps(p, ensure_ascii=False)) for k, p in payloads], "secid string, content string")


def described(**fields):
    return {"description": {"columns": ["name", "value"], "data": [list(x) for x in fields.items()]}}


def test_schedules_defaults_and_rejects(spark):
    base = {"SECID": "X", "FACEUNIT": "SUR", "FACEVALUE": "1000"}
    sec = answers(spark, ("a", described(**base | {"MATDATE": "2030-01-01"})), ("b", described(**base | {"SECID": "Y", "MATDATE": "0000-00-00"})), ("c", described(**base)), ("d", described(**base | {"SECID": "Z"})))
    pays = lambda *a: {"amortizations": {"columns": ["amortdate", "value"], "data": list(a)}, "coupons": {"columns": ["startdate", "coupondate", "value", "valueprc"], "data": [["2025-01-01", "2025-07-01", 0, None], ["2025-07-01", "2026-01-01", 0, 0]]}, "offers": {"columns": ["offerdate", "offertype", "price"], "data": [["2026-01-01", " Отзывная оферта", 99.5], [None, "put", 1]]}}
    s = S.schedules(sec, answers(spark, ("a", pays()), ("b", pays(["2026-01-01", 400.5], ["2027-01-01", 599.5])), ("d", pays(["2026-01-01", 1001]))))
    assert {(r.secid, str(r.maturity_date), r.currency) for r in s["issues"].collect()} == {("X", "2030-01-01", "RUB"), ("Y", "2027-01-01", "RUB")}
    assert {(r.secid, int(r.amount), r.is_maturity) for r in s["amortizations"].collect()} == {("X", 1000, True), ("Y", 400, False), ("Y", 599, False)}
    assert {(r.key, r.reason) for r in s["rejects"].collect()} == {("c", "neither amortizations nor maturity"), ("d", "amortizations exceed the face value")}
    assert [r.amount for r in s["coupons"].where("secid = 'X'").orderBy("pay_date").collect()] == [None, Decimal(0)]
    assert {(r.kind, r.price_pct) for r in s["offers"].collect()} == {("call", Decimal("99.5"))}
    assert [(r.kind, r.known) for r in S.shown_schedule(s, "X").collect()] == [("coupon", False), ("coupon", True), ("offer call", False), ("maturity", True)]


def test_snapshots_runs_and_vanished_files(spark, tmp_path):
    for day, code in (("2025-01-01", "A"), ("2025-01-02", "B")):
        d = tmp_path / "s" / day / "board-securities"
        d.mkdir(parents=True)
        (d / "TQ.json").write_text(json.dumps({"securities": {"columns": ["SECID", "P"], "data": [[code, 1], [None, 2], ["C", 3]]}}))
    got = N.read_snapshots(spark, str(tmp_path / "s"), endpoint="board-securities").withColumn("board", F.col("name"))
    assert [(r.board, r.secid) for r in N.board_codes(got.select("board", "content")).orderBy("pos").collect()] == [("TQ", "B"), ("TQ", "C")]
    assert {r.secid: r.row["P"] for r in N.board_quotes(got.select("board", "content")).where("secid is not null").collect()} == {"B": "1", "C": "3"}
    assert N.without_block(got.select("board", "content"), "history").count() == 1
    assert N.combined_pages(got.select("board", "day", "content"), "securities", "board", "day").count() == 3
    with pytest.raises(FileNotFoundError):
        N.read_snapshots(spark, str(tmp_path / "s"), "2024-01-01")
    checks = spark.createDataFrame([("X", "ok"), ("Y", "no price")], "secid string, note string")
    for run in ("r1", "r2"):
        head = N.save_run(checks, str(tmp_path / "runs"), run, board="TQ").first()
        assert (head.run_id, head.checked, head.outliers) == (run, 2, 1)
    head = N.save_run(checks.limit(1), str(tmp_path / "runs"), "r2", board="TQ").first()
    assert head.checked == 1 and {(r.run_id, r.checked) for r in N.runs(spark, str(tmp_path / "runs")).collect()} == {("r1", 2), ("r2", 1)}
    catalog = spark.createDataFrame([("x/TQ.json",), ("x/gone.json",)], "path string")
    assert [r.path for r in N.vanished(catalog, spark, str(tmp_path / "s")).collect()] == ["x/gone.json"]


def test_streams_take_a_file_and_a_key_once(spark, tmp_path):
    src, seen = tmp_path / "in", []
    src.mkdir()
    run = lambda: ingest_reports_stream(spark, str(src), str(tmp_path / "catalog"), str(tmp_path / "check"), lambda b, n: seen.extend(r.report for r in b.collect())).awaitTermination()
    (src / "a.html").write_text("one")
    (src / "b.html").write_text("one")
    run()
    (src / "c.html").write_text("one")
    (src / "d.html").write_text("two")
    run()
    assert len(seen) == len(set(seen)) == 2 and spark.read.parquet(str(tmp_path / "catalog")).count() == 2
    spark.sql("select 'k' || (id % 3) natural_key, timestamp'2025-01-01' recorded_at from range(9)").write.parquet(str(tmp_path / "ev"))
    ev = spark.readStream.schema("natural_key string, recorded_at timestamp").parquet(str(tmp_path / "ev"))
    q = ledger_dedupe_stream(ev).writeStream.format("memory").queryName("deduped").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("deduped").count() == 3
