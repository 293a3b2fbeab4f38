"""Import jobs over many files at once: statements and declarative CSV."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.operators import statement_rows as R
from tallyforge.operators.identities import resolve_accounts, resolve_instruments
from tallyforge.operators.ledger import CONTENT, append_rows, declarative_diff, natural_keys, reconcile, reversals_of
from tallyforge.operators.projections import at_dates, moves
from tallyforge.operators.staging import numbered, staged
from tallyforge.sources.declarative_csv import declared_entries, sound_rows

MONEY, QUANTITY = "decimal(24,6)", "decimal(28,10)"
#: The ledger's columns that imports fill, with their types.
LEDGER = {
    "id": "long", "natural_key": "string", "event_type": "string", "trade_date": "date", "settlement_date": "date", "account_id": "long", "instrument_id": "long", "quantity": QUANTITY, "price": QUANTITY,
    "accrued_int": MONEY, "fee": MONEY, "fee_kind": "string", "amount": MONEY, "currency": "string", "withheld_at_source": "boolean", "broker_trade_no": "string", "source_report": "string", "source_row_id": "string",
    "cost_basis": QUANTITY, "basis_quality": "string", "note": "string", "reverses_id": "long",
}


@dataclass(frozen=True)
class Imported:
    """``rows`` to append with place (their order), ``diff`` with an action for each row, and what goes with them."""

    rows: DataFrame
    diff: DataFrame
    accounts: DataFrame
    instruments: DataFrame
    rejects: DataFrame
    reports: DataFrame | None = None
    discrepancies: DataFrame | None = None
    unparsed: DataFrame | None = None


def as_ledger(rows: DataFrame, *more: str) -> DataFrame:
    """The ledger's columns in order; those that ``rows`` lacks are null."""
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in LEDGER.items()], *more)


def actual_totals(ledger: DataFrame, reports: DataFrame) -> DataFrame:
    """(report_id, kind, key, quantity) of the ledger at every report's date: one sort for all dates.

    ``reports`` has report_id, account_id, as_of.
    """
    held = moves(ledger)
    marks = lambda rows, key: reports.join(rows.select("account_id", key).distinct(), "account_id")
    p = at_dates(held, marks(held, "instrument_id"), ("account_id", "instrument_id"), F.col("trade_date"), F.col("quantity"))
    c = at_dates(ledger, marks(ledger, "currency"), ("account_id", "currency"), F.coalesce("settlement_date", "trade_date"), F.col("amount"))
    p = p.select("report_id", F.lit("security").alias("kind"), F.col("instrument_id").cast("string").alias("key"), F.col("total").cast(QUANTITY).alias("quantity"))
    return p.unionByName(c.select("report_id", F.lit("cash").alias("kind"), F.col("currency").alias("key"), F.col("total").cast(QUANTITY).alias("quantity")))


def import_statements(parsed: DataFrame, ledger: DataFrame, accounts: DataFrame, instruments: DataFrame, force: bool = False) -> Imported:
    """Map, resolve, key, compare and reconcile statements (report, text, tables) in one plan.

    An operation that an earlier statement of the batch or the ledger has is unchanged; a
    key that one statement has twice is rejected. Statements are reconciled against the
    ledger with the batch's new rows. Rows of a statement with discrepancies are held
    back, unless ``force`` is set: then they come with a note. Statements without a
    period's end have no control totals to meet and are taken.
    """
    headers = staged(R.statement_headers(parsed), "headers")
    mapped = R.mapped_rows(R.table_rows(parsed))
    reports, accounts, lost = resolve_accounts(headers, accounts, "account_code")
    reports = staged(reports.drop("account_code").join(accounts.select(F.col("account_id").cast("long").alias("account_id"), F.col("code").alias("account")), "account_id"), "reports")

    ops = R.statement_operations(mapped).join(reports, "report")
    ops = numbered(ops, ["period_start", "report", "idx", "row", "part"], 0, "seq").withColumns({"name": F.col("instrument_name")})
    rows, instruments, unknown = resolve_instruments(ops, instruments)
    rows = rows.withColumns({"event_type": F.col("kind"), "instrument": F.coalesce("isin", "ticker"), "source_row_id": F.lit(None).cast("string"), "source_report": F.col("report")})
    rows = natural_keys(rows, "seq", ("report",))
    twice = F.count("*").over(W.partitionBy("natural_key", "report")) > 1
    later = F.row_number().over(W.partitionBy("natural_key").orderBy("seq")) > 1
    seen = ledger.select("natural_key").distinct().withColumn("there", F.lit(True))
    action = F.when(F.col("twice"), "rejected").when(F.col("later") | F.col("there"), "unchanged").otherwise("new")
    # first by key, then by key and statement: one shuffle serves both, and the join
    diff = rows.withColumn("later", later).withColumn("twice", twice).join(seen, "natural_key", "left").withColumn("action", action)
    diff = staged(as_ledger(diff, "seq", "action"), "diff")
    new = diff.where("action = 'new'")

    told = R.statement_balances(mapped, headers).join(reports.select("report"), "report")
    by_isin = instruments.where("isin IS NOT NULL").select("isin", F.col("instrument_id").alias("i1"))
    by_ticker = instruments.where("ticker IS NOT NULL").select("ticker", F.col("instrument_id").alias("i2"))
    told = told.join(by_isin, "isin", "left").join(by_ticker, "ticker", "left")
    key = F.when(F.col("kind") == "cash", F.col("currency")).otherwise(F.coalesce("i1", "i2").cast("string"))
    expected = told.select(F.col("report").alias("report_id"), "kind", key.alias("key"), F.col("quantity").cast(QUANTITY).alias("quantity"))
    dated = reports.where("period_end IS NOT NULL").select(F.col("report").alias("report_id"), "account_id", F.col("period_end").alias("as_of"))
    whole = as_ledger(ledger).unionByName(as_ledger(new))
    wrong = staged(reconcile(expected, actual_totals(whole, dated)), "discrepancies")

    bad = wrong.select(F.col("report_id").alias("report"), F.lit(True).alias("bad")).distinct()
    reports = reports.join(bad, "report", "left").select("report", "account_id", "period_start", "period_end", (F.lit(force) | F.col("bad").isNull()).alias("committed"), F.when(F.col("bad"), "has discrepancies").alias("note"))
    reports = staged(reports, "reports")
    taken = new.join(reports.where("committed").select(F.col("report").alias("source_report"), F.col("note").alias("forced")), "source_report")
    taken = as_ledger(taken.withColumn("note", F.concat_ws("; ", "note", "forced")), F.lit(2).alias("place"))
    rejects = lost.select("report", "reason").unionByName(unknown.select("report", "reason")).unionByName(diff.where("action = 'rejected'").select(F.col("source_report").alias("report"), F.lit("a key occurs twice in the statement").alias("reason")))
    return Imported(taken, diff, accounts, instruments, rejects, reports, wrong, R.unparsed_rows(mapped))


def import_declared(rows: DataFrame, ledger: DataFrame, accounts: DataFrame, instruments: DataFrame) -> Imported:
    """Bring the ledger to the state that declarative files tell, kind by kind.

    Rows that changed are reversed and replaced, rows that vanished are reversed. Every
    kind that a sound file has is told in whole: rows of that kind in no file vanish.
    A row that comes again gets a key with its version.
    """
    rows = staged(sound_rows(rows), "sound")
    entries, accounts, lost = resolve_accounts(declared_entries(rows), accounts)
    entries = numbered(entries, ["source_row_id", "account"], 0, "seq").withColumn("name", F.lit(None).cast("string"))
    state, instruments, unknown = resolve_instruments(entries, instruments)
    state = staged(as_ledger(state), "state")
    scope = F.substring_index("source_row_id", ":", 1)
    scopes = rows.select(F.col("file_kind").alias("scope")).distinct()
    recorded = as_ledger(ledger).where("source_row_id IS NOT NULL").withColumn("scope", scope).join(scopes, "scope", "left_semi").drop("scope")
    diff = staged(declarative_diff(state, recorded, content=CONTENT).drop("new"), "diff")

    gone = recorded.join(diff.where("action IN ('reverse', 'replace')").select(F.col("old_id").alias("id")), "id", "left_semi")
    back = as_ledger(reversals_of(gone.select("id", *[c for c in gone.columns if c != "id"])), F.lit(0).alias("place"))
    come = state.join(diff.where("action IN ('new', 'replace')").select("source_row_id", "action", "versions"), "source_row_id")
    come = come.withColumn("natural_key", F.when(F.col("versions") > 0, F.concat_ws("", "natural_key", F.lit(":r"), F.col("versions").cast("string"))).otherwise(F.col("natural_key")))
    come = as_ledger(come, F.when(F.col("action") == "replace", 1).otherwise(2).alias("place"))
    rejects = lost.select("source_row_id", "reason").unionByName(unknown.select("source_row_id", "reason"))
    return Imported(back.unionByName(come), diff, accounts, instruments, rejects)


def commit(done: Imported, ledger: DataFrame, path: str) -> DataFrame:
    """Append the import's rows with ids after the ledger's last."""
    return append_rows(done.rows, ledger, path)


def new_files(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """(report, content) of files whose sha256 the catalog doesn't have, once each; files without bytes are left out."""
    x = files.where(F.length("content") > 0).select(F.sha2("content", 256).alias("report"), "content").dropDuplicates(["report"])
    return x.join(catalog.select(F.col("sha256").alias("report")), "report", "left_anti")
