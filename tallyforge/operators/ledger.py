"""Keys, diffs, reversals and identities of an append-only ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.operators.staging import numbered

CONTENT = ("event_type", "trade_date", "settlement_date", "instrument_id", "quantity", "price", "amount", "currency", "cost_basis", "basis_quality")
# The key's version and length, and the event types.
KEY_VERSION, KEY_LENGTH = "k1", 40
EVENT_TYPES = (
    "OPENING_BALANCE CASH_IN CASH_OUT TRANSFER BUY SELL COUPON DIVIDEND AMORTIZATION MATURITY FX_CONVERT FEE TAX "
    "CONVERSION SPIN_OFF SPLIT DEFAULT PARTIAL_REDEMPTION DEPOSIT_OPEN DEPOSIT_INTEREST DEPOSIT_CLOSE"
).split()


def number_text(x: Column) -> Column:
    """10 and 10.00 alike, never with an exponent; null is empty. Digits before and after the point are printed apart, as how a
    decimal with leading zeros is cast to a string depends on the session."""
    d = x.cast("decimal(38,10)")
    whole = F.floor(F.abs(d)).cast("decimal(28,0)")
    part = F.rtrim(F.lpad(((F.abs(d) - whole) * 10**10).cast("decimal(10,0)").cast("string"), 10, "0"), F.lit("0"))
    s = F.concat(F.when(d < 0, "-").otherwise(""), whole.cast("string"), F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))
    return F.coalesce(s, F.lit(""))


def digest(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(KEY_VERSION), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, KEY_LENGTH)


def natural_keys(items: DataFrame, order: str = "id", within: tuple[str, ...] = ()) -> DataFrame:
    """Idempotency keys: source row id, else trade number, else attributes with an ordinal within the day (and ``within``)."""
    c, n = F.col, lambda x: number_text(F.col(x))
    same = [c("account"), c("trade_date"), c("event_type"), F.coalesce(c("instrument"), F.lit("")), n("quantity"), n("price"), n("amount"), F.coalesce(c("fee_kind"), F.lit(""))]
    index = F.row_number().over(W.partitionBy(*within, *same).orderBy(order)) - 1
    head = [c("account"), c("trade_date"), c("event_type")]
    key = F.when(c("source_row_id").isNotNull(), digest(F.lit("csv"), *head, c("instrument"), c("source_row_id")))
    key = key.when(F.coalesce(c("broker_trade_no"), F.lit("")) != "", digest(F.lit("trade"), *head, c("fee_kind"), c("broker_trade_no")))
    return items.withColumn("ordinal", index).withColumn("natural_key", key.otherwise(digest(F.lit("hash"), *same, c("ordinal"))))


def split_unknown_types(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of known event types, and those of others (null among them), which no job may import."""
    known = F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False))
    return items.where(known), items.where(~known)


def idempotent_diff(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming rows with action new, unchanged or rejected (a key that occurs twice in the batch)."""
    seen = existing.select("natural_key").distinct().withColumn("there", F.lit(True))
    twice = F.count("*").over(W.partitionBy("natural_key")) > 1
    action = F.when(twice, "rejected").when(F.col("there"), "unchanged").otherwise("new")
    return incoming.join(seen, "natural_key", "left").withColumn("action", action).drop("there")


def live_rows(ledger: DataFrame) -> DataFrame:
    """Rows that are no reversals and that no reversal names."""
    gone = ledger.where("reverses_id IS NOT NULL").select(F.col("reverses_id").alias("id"))
    return ledger.where("reverses_id IS NULL").join(gone, "id", "left_anti")


def declarative_diff(state: DataFrame, recorded: DataFrame, key: str = "source_row_id", content=CONTENT) -> DataFrame:
    """A file's full state against the live rows: new, unchanged, replace or reverse, with the next version."""
    content = [c for c in content if c in state.columns and c in recorded.columns]
    live = live_rows(recorded).groupBy(key).agg(F.max_by(F.struct("id", *content), "id").alias("old"))
    versions = recorded.where("reverses_id IS NULL").groupBy(key).agg(F.count("*").alias("versions"))
    new = state.select(key, F.struct(*content).alias("new"))
    x = new.join(live, key, "full_outer").join(versions, key, "left")
    same = F.lit(True)
    for c in content:
        same = same & F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}"))
    action = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "reverse").when(same, "unchanged").otherwise("replace")
    return x.select(key, action.alias("action"), F.coalesce("versions", F.lit(0)).alias("versions"), F.col("old.id").alias("old_id"), "new")


def reversals_of(rows: DataFrame) -> DataFrame:
    neg = [(-F.col(c)).alias(c) if c in ("quantity", "accrued_int", "fee", "amount") else F.concat(F.lit("reversal:"), c).alias(c) if c == "natural_key" else F.col("id").alias(c) if c == "reverses_id" else F.col(c) for c in rows.columns if c != "id"]
    return rows.select(*neg)


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("action").agg(F.count("*").alias("n"))


def append_rows(rows: DataFrame, ledger: DataFrame, path: str) -> DataFrame:
    """Give ids after the ledger's last and append; reversals come before replacements before new rows."""
    last = ledger.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("m")).first().m
    out = numbered(rows, ["place", "natural_key"], last + 1).drop("place")
    out.write.mode("append").parquet(path)
    return out


def unpaired_reversals(ledger: DataFrame) -> DataFrame:
    """Reversals without original, or whose amount or quantity does not cancel it."""
    r = ledger.where("reverses_id IS NOT NULL").select("id", "reverses_id", "amount", "quantity")
    o = ledger.select(F.col("id").alias("reverses_id"), F.col("amount").alias("o_amount"), F.col("quantity").alias("o_quantity"), F.lit(True).alias("found"))
    z, problem = lambda c: F.coalesce(F.col(c), F.lit(0)), lambda cond, name: F.when(cond, F.lit(name))
    problems = F.array(problem(F.col("found").isNull(), "missing"), problem(F.col("found") & (z("amount") + z("o_amount") != 0), "amount"), problem(F.col("found") & (z("quantity") + z("o_quantity") != 0), "quantity"))
    return r.join(o, "reverses_id", "left").select("id", F.explode(F.array_compact(problems)).alias("problem"))


def duplicate_keys(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("natural_key").agg(F.count("*").alias("n")).where("n > 1")


def missing_currency(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.length(F.coalesce("currency", F.lit(""))) != 3).select("id", "currency")


def money_sum(items: DataFrame, by: list[str]) -> DataFrame:
    """Sums of amounts by key; a key with several currencies is flagged and has no sum."""
    g = items.groupBy(*by).agg(F.sum("amount").alias("amount"), F.count_distinct("currency").alias("currencies"), F.min("currency").alias("currency"))
    one = F.col("currencies") == 1
    return g.select(*by, F.when(one, F.col("amount")).alias("amount"), F.when(one, F.col("currency")).alias("currency"), (~one).alias("mixed"))


def reconcile(expected: DataFrame, actual: DataFrame, cash_tolerance=0.01, quantity_tolerance=0) -> DataFrame:
    """Control totals against projections, both ways, by (report_id, kind, key).

    Expected rows differ beyond the tolerance of their kind; an unresolved key always
    differs; an actual row that the report leaves out differs unless it is zero.
    """
    names = ("report_id", "kind", "key")
    a = actual.select(*[F.col(c).alias(f"a_{c}") for c in names], F.col("quantity").alias("actual"))
    e = expected.select(*[F.col(c).alias(f"e_{c}") for c in names], F.col("quantity").alias("expected"), F.lit(True).alias("told"))
    x = e.join(a, (F.col("e_report_id") == F.col("a_report_id")) & (F.col("e_kind") == F.col("a_kind")) & F.col("e_key").eqNullSafe(F.col("a_key")), "full_outer")
    x = x.select(*[F.coalesce(f"e_{c}", f"a_{c}").alias(c) for c in names], "told", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    x = x.withColumn("difference", F.col("actual") - F.col("expected"))
    tolerance = F.when(F.col("kind") == "cash", F.lit(cash_tolerance).cast("decimal(24,6)")).otherwise(F.lit(quantity_tolerance).cast("decimal(24,6)"))
    wrong = F.when(F.col("told").isNull(), F.col("actual") != 0).otherwise(F.col("key").isNull() | (F.abs("difference") > tolerance))
    return x.where(wrong).drop("told")
