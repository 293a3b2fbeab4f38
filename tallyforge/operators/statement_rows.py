"""From tables of statements to operations and balances (F23-F28, R1-R12), as column expressions.

Sections and columns are found once a table, by the longest dictionary phrase. Rows are
exploded after that, so the whole mapping is one pass without a shuffle. A row that can't
be mapped keeps its cells and a reason; nothing is dropped silently.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import cleaning as c
from tallyforge.functions.cleaning import let
from tallyforge.operators.matching import longest_phrase
from tallyforge.operators.staging import dealt_out, joined, staged

# Phrases of sections, columns, totals, operations and directions.
SECTIONS = {
    "trades": ("сделки", "заключенные в отчетном периоде сделки", "сделки с ценными бумагами", "совершенные сделки"),
    "cash_flow": ("движение денежных средств", "операции с денежными средствами", "прочие операции", "неторговые операции"),
    "cash_balances": ("остатки денежных средств", "денежные средства", "остаток денежных средств"),
    "security_balances": ("остатки по ценным бумагам", "состояние портфеля", "портфель по ценным бумагам", "активы"),
    "report_header": ("отчет о сделках и операциях", "отчет брокера", "период"),
}
COLUMNS = {
    "broker_trade_no": ("номер сделки", "номер заявки", "no сделки", "№ сделки", "id сделки"),
    "trade_date": ("дата заключения", "дата сделки", "дата операции", "дата"),
    "settlement_date": ("дата расчетов", "дата поставки", "дата исполнения"),
    "ticker": ("код инструмента", "код бумаги", "тикер", "код", "инструмент", "бумага"),
    "isin": ("isin",),
    "instrument_name": ("наименование", "название бумаги", "эмитент"),
    "direction": ("вид сделки", "операция", "тип операции", "вид", "направление", "b/s"),
    "quantity": ("количество", "кол-во", "шт"),
    "price": ("цена", "курс"),
    "amount": ("сумма сделки", "сумма", "объем", "итого"),
    "accrued_int": ("нкд", "накопленный купонный доход"),
    "fee_broker": ("комиссия брокера", "вознаграждение брокера", "брокерская комиссия"),
    "fee_depositary": ("комиссия депозитария", "депозитарная комиссия", "депозитарий"),
    "fee_exchange": ("комиссия биржи", "биржевой сбор", "комиссия тс"),
    "currency": ("валюта",),
    "tax": ("сумма налога", "удержанный налог", "налог", "ндфл"),
    "description": ("описание операции", "содержание операции", "описание", "комментарий"),
    "credit": ("зачислен", "приход", "кредит", "поступлен"),
    "debit": ("списан", "расход", "дебет", "выплат"),
    "closing_balance": ("исходящий остаток", "остаток на конец", "остаток на конец периода", "конечный остаток", "плановый исходящий остаток"),
    "opening_balance": ("входящий остаток", "остаток на начало", "начальный остаток"),
}
TOTALS = ("итого", "итог", "всего", "в том числе", "подытог", "оборот")
#: A normalized cell of totals; what every such cell holds as it is written; characters that normalizing makes nothing of.
TOTAL, ABOUT_TOTAL, NOTHING = rf"^({'|'.join(TOTALS)})( |\z)", r"(?iu)тог|вс[её]го|числ[её]|оборот", " \t\r\n" + c.SPACES + "«»\"'()[]:;,."
#: Distinct headings, or texts before tables, that are sent to all executors; more of them are joined by a shuffle.
LOOKS = 10_000
OPERATIONS = {
    "TAX": ("налог на доходы", "ндфл", "налог"),
    "FEE DEPOSITARY": ("комиссия депозитария", "депозитарная комиссия"),
    "FEE WITHDRAWAL": ("комиссия за вывод", "комиссия за перевод"),
    "FEE EXCHANGE": ("комиссия биржи", "биржевой сбор"),
    "FEE BROKER": ("комиссия брокера", "вознаграждение брокера"),
    "FEE OTHER": ("комиссия",),
    "COUPON": ("выплата купона", "купон"),
    "DIVIDEND": ("дивиденд",),
    "AMORTIZATION": ("частичное досрочное погашение", "амортизация"),
    "MATURITY": ("погашение ценных бумаг", "погашение номинала", "погашение"),
    "CONVERSION": ("конвертация",),
    "TRANSFER": ("перевод между счетами", "перевод"),
    "CASH_OUT": ("вывод денежных средств", "снятие"),
    "CASH_IN": ("зачисление денежных средств", "пополнение", "внесение"),
    "BUY": ("покупка",),
    "SELL": ("продажа",),
}
BUY, SELL = ("покупка", "покупк", "buy", "приобретение", "к покупке", "b"), ("продажа", "продаж", "sell", "к продаже", "s")
NET, GROSS = ("за вычетом", "после удержания", "нетто", "net", "минус налог"), ("до удержания", "брутто", "gross", "до налога")
PERIOD = r"(?iu)(?:за\s+период\s+)?с\s+(\d{2}\.\d{2}\.\d{4})\s+(?:по|-|—)\s+(\d{2}\.\d{2}\.\d{4})"
ACCOUNT = r"(?iu)(?:договор|соглашение|счет|счёт|код\s+клиента)[^\dA-Za-zА-Яа-я]{0,20}(?:№|n|no)?\s*([\p{L}\p{N}_\-/]{3,32})"
DEFAULT_CURRENCY = "RUB"

FEES = {"fee_broker": "BROKER", "fee_depositary": "DEPOSITARY", "fee_exchange": "EXCHANGE"}
MONEY, QUANTITY = "decimal(24,6)", "decimal(28,10)"
OPERATION = (
    ("kind", "string"), ("trade_date", "date"), ("settlement_date", "date"), ("ticker", "string"), ("isin", "string"), ("instrument_name", "string"), ("quantity", QUANTITY), ("price", QUANTITY),
    ("accrued_int", MONEY), ("fee", MONEY), ("fee_kind", "string"), ("amount", MONEY), ("currency", "string"), ("broker_trade_no", "string"), ("withheld_at_source", "boolean"), ("note", "string"),
)
BALANCE = (("kind", "string"), ("ticker", "string"), ("isin", "string"), ("quantity", QUANTITY), ("currency", "string"))


def by_phrase(groups: dict[str, tuple[str, ...]]) -> dict[str, str]:
    return {p: name for name, phrases in groups.items() for p in phrases}


def has_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def record(fields, **values: Column) -> Column:
    return F.struct(*[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields])


def width_of(headers: Column, rows: Column) -> Column:
    return F.when(F.size(rows) > 0, F.array_max(F.transform(rows, F.size))).otherwise(F.size(headers))


def column_names(headers: Column, rows: Column) -> Column:
    """Names of all columns: ``col_i`` where the header is empty, ``__n`` at the n-th repetition."""
    return names_of(headers, width_of(headers, rows))


def names_of(headers: Column, width: Column) -> Column:
    raw = F.transform(F.slice(F.sequence(F.lit(0), F.greatest(width, F.lit(1))), 1, width), lambda i: F.coalesce(F.nullif(F.get(headers, i), F.lit("")), F.concat(F.lit("col_"), i)))

    def suffixed(names: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            n = F.size(F.filter(F.slice(names, 1, i), lambda y: y == x))
            return F.when(n > 0, F.concat(x, F.lit("__"), n)).otherwise(x)

        return F.transform(names, one)

    return let(raw, suffixed)


def resolve_columns(names: Column) -> Column:
    """Map of logical column to position: the longest phrase wins, then the earlier column; a position serves one of them."""

    def of(signatures: Column) -> Column:
        found = []
        for i, (logical, phrases) in enumerate(COLUMNS.items()):
            lengths = F.transform(signatures, lambda s: F.greatest(F.lit(0), *[F.when(F.contains(s, F.lit(p)), len(p)).otherwise(0) for p in phrases]))  # noqa: B023
            found.append(let(lengths, lambda n: let(F.array_max(n), lambda best: F.struct(F.lit(logical).alias("name"), F.array_position(n, best).cast("int").alias("at"), F.struct(best.alias("best"), -F.array_position(F.transform(n, lambda x: x > 0), F.lit(True)), F.lit(-i)).alias("rank")))))  # noqa: B023
        return F.filter(F.array(*found), lambda h: F.coalesce(h["rank"]["best"], F.lit(0)) > 0)

    def unique(hits: Column) -> Column:
        own = F.filter(hits, lambda h: ~F.exists(hits, lambda o: (o["at"] == h["at"]) & (o["rank"] > h["rank"])))
        return F.map_from_entries(F.transform(own, lambda h: F.struct(h["name"], h["at"] - 1)))

    return let(let(F.transform(names, c.normalize_signature), of), unique)


def phrase_of(texts: Column) -> Column:
    """The section that the first of the texts names: the caption, then the nearest text before the table. No phrase holds a digit."""
    phrase = F.transform(texts, lambda t: longest_phrase(c.normalize_signature(t), by_phrase(SECTIONS)))
    return F.get(F.filter(phrase, lambda s: s.isNotNull()), F.lit(0))


def section_of(columns: Column) -> Column:
    """By which columns there are."""
    has = lambda *names: reduce(lambda a, b: a | b, [F.map_contains_key(columns, n) for n in names])
    return (
        F.when(has("quantity") & has("price") & has("direction", "broker_trade_no"), "trades")
        .when(has("description") & has("credit", "debit", "amount"), "cash_flow")
        .when(has("closing_balance") & has("currency") & ~has("ticker"), "cash_balances")
        .when(has("closing_balance") & has("ticker", "isin"), "security_balances")
    )


def is_total(cells: Column) -> Column:
    """Totals, empty rows and subheadings (one cell without a digit). Only cells of rows with a word of totals are normalized; a cell is filled if it has more than spaces and punctuation."""
    row = F.array_join(cells, " ")
    total = F.regexp_like(row, F.lit(ABOUT_TOTAL)) & F.exists(cells, lambda x: F.regexp_like(c.normalize_signature(x), F.lit(TOTAL)))
    return total | (~F.regexp_like(row, F.lit(r"\d")) & (F.size(F.filter(cells, lambda x: F.btrim(x, F.lit(NOTHING)) != "")) <= 1))


def statement_headers(parsed: DataFrame) -> DataFrame:
    """(report, period_start, period_end, account_code), from the texts of tables and then from the whole text."""
    nothing = F.lit(None).cast("string")
    holds = lambda t: F.regexp_like(t, F.lit(PERIOD))
    told = lambda t: F.when(holds(t), t)
    # what comes after the first text that holds a period is not looked at
    first = lambda xs, of: F.aggregate(xs, nothing, lambda found, x: F.coalesce(found, of(x)))
    in_table = lambda t: F.coalesce(first(t["before"], told), told(t["caption"]), first(t["rows"], lambda r: let(F.array_join(r, " "), told)))
    period = F.coalesce(first(F.col("tables"), in_table), told(F.col("text")))
    # each step is a column of its own, so that none is computed again where the next uses it several times
    x = parsed.select("report", period.alias("told"), F.regexp_extract("text", ACCOUNT, 1).alias("account"))
    x = x.select("report", "account", *[F.regexp_extract("told", PERIOD, i).alias(n) for i, n in ((1, "a"), (2, "b"))])
    return x.select("report", c.parse_date(F.col("a")).alias("period_start"), c.parse_date(F.col("b")).alias("period_end"), F.nullif("account", F.lit("")).alias("account_code"))


def with_look(tables: DataFrame, looks: DataFrame, by: list[str]) -> DataFrame:
    """``tables`` with what was found for their look. Few looks go to the tables, which stay where they are: dealt by look they would meet in as many tasks as there are looks."""
    return tables.join(F.broadcast(looks), by) if looks.limit(LOOKS + 1).count() <= LOOKS else joined(tables, looks, by)


def table_rows(parsed: DataFrame) -> DataFrame:
    """(report, idx, section, label, row, cells, names, columns) of all rows but totals."""
    near = lambda x: F.regexp_replace(x, r"\d+", "0")
    t = parsed.select("report", F.explode("tables").alias("t")).select("report", "t.*")
    t = t.withColumns({"width": width_of(F.col("headers"), F.col("rows")), "texts": F.concat(F.array("caption"), F.reverse("before"))})
    label = F.get(F.filter("texts", lambda x: x != ""), F.lit(0))
    t = staged(t.select("report", "idx", "headers", "rows", "width", label.alias("label"), F.transform("texts", near).alias("said")), "tables")
    # statements of one broker share their headings and texts: each distinct list is looked up once
    shapes = dealt_out(t.select("headers", "width").distinct()).withColumn("names", names_of(F.col("headers"), F.col("width")))
    shapes = shapes.withColumn("columns", resolve_columns(F.col("names"))).withColumn("by_columns", section_of(F.col("columns")))
    said = dealt_out(t.select("said").distinct()).withColumn("phrase", phrase_of(F.col("said")))
    t = with_look(with_look(t, staged(shapes, "shapes"), ["headers", "width"]), staged(said, "said"), ["said"])
    t = t.withColumn("section", F.coalesce("phrase", "by_columns"))
    numeric = F.exists("rows", lambda r: F.exists(r, lambda x: c.parse_decimal(x).isNotNull()) & (F.size(F.filter(r, lambda x: x != "")) >= 2))
    t = t.where(F.col("section").isNotNull() | ((F.size("names") >= 2) & numeric))
    return t.select("report", "idx", "section", F.coalesce("label", "section", F.concat(F.lit("table "), "idx")).alias("label"), "names", "columns", F.posexplode("rows").alias("row", "cells")).where(~is_total(F.col("cells")))


def mapped_rows(rows: DataFrame) -> DataFrame:
    """Every row with its operations (0 to 4), its balance or null, or the reason why it has neither, with its names and cells.

    The rows are written: a filter on what was mapped (an explode brings its own) would
    else move below the steps and carry a copy of every step with it.
    """

    def cell(name: str) -> Column:
        return F.get("cells", F.try_element_at("columns", F.lit(name)))

    wide = {"row": c.split_code("row")}
    rows = rows.withColumns({name: cell(name) for name in COLUMNS} | wide)
    rows = rows.withColumns(wide | {name: F.when(F.col(name).isNotNull() & ~c.is_blank(F.col(name)), F.col(name)) for name in COLUMNS})
    there = lambda name, parse: F.when(F.col(name).isNotNull(), parse(F.col(name)))
    number = {n: there(n, c.parse_decimal) for n in ("quantity", "price", "amount", "accrued_int", "tax", "credit", "debit", "closing_balance", *FEES)}
    dates = {n: there(n, c.parse_date) for n in ("trade_date", "settlement_date")}
    rows = rows.withColumns({f"n_{n}": x for n, x in {**number, **dates}.items()}).withColumns({"n_currency": F.when(F.col("currency").isNull(), DEFAULT_CURRENCY).otherwise(c.parse_currency(F.col("currency"))), "n_isin": there("isin", c.isin), "n_ticker": F.trim("ticker")})
    rows = rows.withColumns({"said": there("description", c.normalize_signature), "word": there("direction", c.normalize_signature)})
    rows = rows.withColumns(wide | {"n_kind": F.when((F.col("section") == "cash_flow") & F.col("said").isNotNull(), longest_phrase(F.col("said"), by_phrase(OPERATIONS)))})
    n = lambda name: F.col(f"n_{name}")
    unread = lambda name: F.when(F.col(name).isNotNull() & n(name).isNull(), F.concat(F.lit(f"{name} is not readable: "), name))
    missing = lambda name: F.when(F.col(name).isNull(), F.lit(f"{name} is missing"))

    word = F.col("word")
    sign = F.when(n("quantity") < 0, "SELL").when((n("quantity") > 0) & (n("amount") < 0), "BUY").when((n("quantity") > 0) & (n("amount") > 0), "SELL")
    rows = rows.withColumn("n_direction", F.coalesce(F.when(has_any(word, BUY), "BUY").when(has_any(word, SELL), "SELL"), sign))
    accrued = F.coalesce(F.abs(n("accrued_int")), F.lit(0).cast(QUANTITY)).cast(MONEY)
    gross = F.coalesce(F.abs(n("amount")).cast(MONEY), (F.abs(n("quantity")).cast("decimal(19,6)") * n("price").cast("decimal(18,8)")).cast(MONEY)) + accrued
    fee = sum((F.coalesce(F.abs(n(f)), F.lit(0).cast(QUANTITY)).cast(MONEY) for f in FEES), F.lit(0).cast(MONEY)).cast(MONEY)
    buys = n("direction") == "BUY"
    common = {"trade_date": n("trade_date"), "settlement_date": F.coalesce(n("settlement_date"), n("trade_date")), "ticker": n("ticker"), "isin": n("isin"), "currency": n("currency")}
    trade = record(OPERATION, **common, kind=n("direction"), instrument_name=F.col("instrument_name"), quantity=F.when(buys, F.abs(n("quantity"))).otherwise(-F.abs(n("quantity"))), price=n("price"), accrued_int=n("accrued_int"), fee=F.when(fee != 0, fee), amount=F.when(buys, -gross).otherwise(gross), broker_trade_no=F.col("broker_trade_no"))
    fees = [(n(f) != 0, record(OPERATION, **common, kind=F.lit("FEE"), fee_kind=F.lit(k), amount=-F.abs(n(f)), broker_trade_no=F.col("broker_trade_no"), note=F.col("label"))) for f, k in FEES.items()]

    event, income = F.split("n_kind", " ")[0], F.col("n_kind").isin("COUPON", "DIVIDEND")
    single = F.when((n("amount") > 0) & event.isin("FEE", "TAX", "CASH_OUT"), -n("amount")).otherwise(n("amount"))
    zero = F.lit(0).cast(QUANTITY)
    moved = F.when(F.col("credit").isNotNull() | F.col("debit").isNotNull(), F.coalesce(n("credit"), zero) - F.abs(F.coalesce(n("debit"), zero))).otherwise(single)
    taxed = income & (F.coalesce(n("tax"), zero) != 0)
    said = F.col("said")
    withheld = F.when(income, F.when(n("tax").isNotNull(), F.lit(False)).when(has_any(said, NET), True).when(has_any(said, GROSS), False))
    flow = record(OPERATION, **common, kind=event, instrument_name=F.col("instrument_name"), fee_kind=F.try_element_at(F.split("n_kind", " "), F.lit(2)), amount=moved + F.when(taxed, F.abs(n("tax"))).otherwise(zero), withheld_at_source=withheld, note=F.col("description"))
    tax = (taxed, record(OPERATION, **common, kind=F.lit("TAX"), amount=-F.abs(n("tax")), withheld_at_source=F.lit(True), note=F.col("description")))

    section, first = F.col("section"), F.coalesce
    no_amount = F.when(F.col("amount").isNull() & F.col("price").isNull(), "neither amount nor price")
    no_flow = F.when(F.col("amount").isNull() & F.col("credit").isNull() & F.col("debit").isNull(), "no amount")
    reason = (
        F.when(section == "trades", first(missing("trade_date"), unread("trade_date"), unread("settlement_date"), missing("quantity"), unread("quantity"), unread("price"), unread("accrued_int"), unread("currency"), F.when(n("direction").isNull(), "direction is unknown"), unread("amount"), no_amount, *[unread(f) for f in FEES]))
        .when(section == "cash_flow", first(F.when(F.col("n_kind").isNull(), F.concat(F.lit("operation is unknown: "), F.coalesce("description", F.lit("")))), missing("trade_date"), unread("trade_date"), unread("settlement_date"), unread("currency"), unread("credit"), unread("debit"), no_flow, unread("amount"), unread("tax")))
        .when(section == "cash_balances", first(missing("closing_balance"), unread("closing_balance"), unread("currency")))
        .when(section == "security_balances", first(F.when(n("ticker").isNull() & n("isin").isNull(), "neither ticker nor ISIN"), missing("closing_balance"), unread("closing_balance"), unread("currency")))
        .when(section.isNull(), "section is unknown")
    )
    none = F.array().cast(f"array<struct<{', '.join(f'{name}: {kind}' for name, kind in OPERATION)}>>")
    # no filter of one array: its function would not be compiled
    some = lambda x, *more: F.concat(F.array(x), *[F.when(there, F.array(y)).otherwise(none) for there, y in more])
    rows = rows.withColumns(wide | {"reason": reason})
    operations = F.when(F.col("reason").isNull(), F.when(section == "trades", some(trade, *fees)).when(section == "cash_flow", some(flow, tax)))
    cash = section == "cash_balances"
    balance = record(BALANCE, kind=F.when(cash, "cash").otherwise("security"), ticker=F.when(~cash, n("ticker")), isin=F.when(~cash, n("isin")), quantity=n("closing_balance"), currency=n("currency"))
    balance = F.when(F.col("reason").isNull() & section.isin("cash_balances", "security_balances"), balance)
    odd = lambda name: F.when(F.col("reason").isNotNull(), F.col(name)).alias(name)
    return staged(rows.select("report", "idx", c.split_code("row"), "section", "label", odd("names"), odd("cells"), operations.alias("operations"), balance.alias("balance"), "reason"), "mapped")


def statement_operations(mapped: DataFrame) -> DataFrame:
    return mapped.select("report", "idx", "row", F.posexplode("operations").alias("part", "op")).select("report", "idx", "row", "part", "op.*")


def statement_balances(mapped: DataFrame, headers: DataFrame) -> DataFrame:
    """Control totals, as of the period's end."""
    b = mapped.where("balance IS NOT NULL").select("report", "balance.*")
    return b.join(headers.select("report", F.col("period_end").alias("as_of")), "report", "left")


def unparsed_rows(mapped: DataFrame) -> DataFrame:
    return mapped.where(F.col("reason").isNotNull()).select("report", "idx", "row", "label", F.map_from_entries(F.slice(F.arrays_zip("names", "cells"), 1, F.size("cells"))).alias("cells"), "reason")
