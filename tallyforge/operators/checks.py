"""Checks of a whole ledger and the queue of what needs attention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import ledger as L
from tallyforge.operators.imports import actual_totals
from tallyforge.operators.projections import first_negative


def violations(ledger: DataFrame) -> DataFrame:
    """(check, subject, detail) of every hard invariant that the ledger breaks."""
    text = lambda *xs: F.concat_ws(":", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in xs])
    row = lambda df, check, subject, detail: df.select(F.lit(check).alias("check"), subject.alias("subject"), detail.alias("detail"))
    out = row(first_negative(ledger, ("account_id", "instrument_id")), "negative position", text("account_id", "instrument_id"), text("day"))
    out = out.unionByName(row(L.unpaired_reversals(ledger), "reversal", text("id"), text("problem")))
    out = out.unionByName(row(L.duplicate_keys(ledger), "repeated key", text("natural_key"), text("n")))
    return out.unionByName(row(L.missing_currency(ledger), "currency", text("id"), text("currency")))


def discrepancies(ledger: DataFrame, reports: DataFrame, expected: DataFrame) -> DataFrame:
    """Cash and securities of every report (report_id, account_id, as_of) at its own date against its control totals."""
    return L.reconcile(expected, actual_totals(ledger, reports))


def check(ledger: DataFrame, reports: DataFrame, expected: DataFrame) -> DataFrame:
    """The whole check as one list: (kind, source, subject, detail, difference)."""
    d = discrepancies(ledger, reports, expected)
    d = d.select(F.lit("discrepancy").alias("kind"), F.col("report_id").alias("source"), F.concat_ws(":", "kind", F.coalesce("key", F.lit("?"))).alias("subject"), F.lit(None).cast("string").alias("detail"), "difference")
    v = violations(ledger)
    return d.unionByName(v.select(F.lit("invariant").alias("kind"), F.col("check").alias("source"), "subject", "detail", F.lit(None).cast(dict(d.dtypes)["difference"]).alias("difference")))


def report_accounts(ledger: DataFrame, reports: DataFrame) -> DataFrame:
    """The reports (source_report, account_code) with the account and id of their first ledger row; null where the ledger has none."""
    first = ledger.where("source_report IS NOT NULL").groupBy("source_report").agg(F.min("id").alias("first_id"), F.min_by("account_id", "id").alias("account_id"))
    return reports.join(first, "source_report", "left")


def inbox(checked: DataFrame, missing: DataFrame, unparsed: DataFrame) -> DataFrame:
    """(kind, source, title) of all that needs attention: files that are gone (report), rows that could not be mapped
    (report, label, reason), and what ``check`` found."""
    gone = missing.select(F.lit("missing_raw").alias("kind"), F.col("report").alias("source"), F.lit("the file is gone").alias("title"))
    rows = unparsed.select(F.lit("unparsed").alias("kind"), F.col("report").alias("source"), F.concat_ws(": ", "label", "reason").alias("title"))
    found = checked.select("kind", "source", F.concat_ws(" ", "subject", "detail").alias("title"))
    return gone.unionByName(rows).unionByName(found)


def unbalanced_reports(opening: DataFrame, operations: DataFrame, closing: DataFrame) -> DataFrame:
    """(report, key, opening, moved, closing) where a report's opening balance and operations don't give its closing one.

    Each frame has report, key (a currency or an instrument) and quantity; what one of them lacks is 0.
    """
    of = lambda df, name: df.select("report", "key", F.col("quantity").cast("decimal(28,10)").alias("q"), F.lit(name).alias("part"))
    x = of(opening, "opening").unionByName(of(operations, "moved")).unionByName(of(closing, "closing"))
    part = lambda name: F.coalesce(F.sum(F.when(F.col("part") == name, F.col("q"))), F.lit(0)).alias(name)
    x = x.groupBy("report", "key").agg(part("opening"), part("moved"), part("closing"))
    return x.where("opening + moved <> closing")
