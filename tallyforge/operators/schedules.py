"""Bond schedules from an exchange's blocks, and their consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import cleaning as c
from tallyforge.operators.staging import joined, staged
from tallyforge.sources.snapshots import block_rows, cell, descriptions, exchange_number, iso_date

# Words for the kinds of offers.
OFFER_KINDS = {"put": ("put", "оферта", "безотзывная оферта"), "call": ("call", "call-опцион", "досрочное погашение", "отзывная оферта")}
MONEY = "decimal(24,6)"


def issues(files: DataFrame, key: str = "secid") -> DataFrame:
    """(key, secid, name, currency, initial_face, maturity_date) of description blocks; what is absent is null."""
    f = lambda *names: F.coalesce(*[F.nullif(F.trim(F.try_element_at("fields", F.lit(n))), F.lit("")) for n in names])
    face = F.coalesce(F.nullif(exchange_number(f("INITIALFACEVALUE")), F.lit(0).cast("decimal(28,10)")), exchange_number(f("FACEVALUE")))
    d = descriptions(files, key)
    return d.select(F.col(key).alias("key"), f("SECID", "ISIN").alias("secid"), f("SHORTNAME", "NAME").alias("name"), c.exchange_currency(f("FACEUNIT")).alias("currency"), face.cast(MONEY).alias("initial_face"), iso_date(f("MATDATE")).alias("maturity_date"))


def coupons(files: DataFrame, key: str = "secid") -> DataFrame:
    value, rate = exchange_number(cell("value")), exchange_number(cell("valueprc"))
    x = block_rows(files, "coupons").select(F.col(key).alias("key"), iso_date(cell("startdate")).alias("period_start"), iso_date(cell("coupondate")).alias("pay_date"), c.known_coupon(value, rate).cast(MONEY).alias("amount"), rate.alias("rate_pct"))
    return x.where("period_start IS NOT NULL AND pay_date IS NOT NULL")


def amortizations(files: DataFrame, key: str = "secid") -> DataFrame:
    x = block_rows(files, "amortizations").select(F.col(key).alias("key"), iso_date(cell("amortdate")).alias("pay_date"), exchange_number(cell("value")).cast(MONEY).alias("amount"))
    return x.where("pay_date IS NOT NULL AND amount IS NOT NULL")


def payment_units(files: DataFrame, key: str = "secid") -> DataFrame:
    """(key, unit): the currencies that coupons and amortizations are told in."""
    x = block_rows(files, "coupons").unionByName(block_rows(files, "amortizations"))
    return x.select(F.col(key).alias("key"), c.exchange_currency(cell("faceunit")).alias("unit")).where("unit IS NOT NULL").distinct()


def offers(files: DataFrame, key: str = "secid") -> DataFrame:
    word = F.lower(F.trim(cell("offertype")))
    kind = F.coalesce(*[F.when(word.isin(*words), k) for k, words in OFFER_KINDS.items()])
    x = block_rows(files, "offers").select(F.col(key).alias("key"), iso_date(cell("offerdate")).alias("offer_date"), kind.alias("kind"), exchange_number(cell("price")).alias("price_pct"))
    return x.where("offer_date IS NOT NULL")


def schedules(securities: DataFrame, bondization: DataFrame, key: str = "secid") -> dict[str, DataFrame]:
    """Frames issues, coupons, amortizations, offers, rejects of many issues, from (key, content) files.

    An issue without amortizations is repaid whole at maturity; one without maturity ends
    at its last amortization. An issue that is inconsistent goes to rejects with its first
    reason, and its payments go with it.
    """
    # parsed once, for the five frames that are made of them
    i, cup, amo, off = staged(issues(securities, key), "issues"), staged(coupons(bondization, key), "coupons"), staged(amortizations(bondization, key), "amortizations"), staged(offers(bondization, key), "offers")
    paid = amo.groupBy("key").agg(F.max("pay_date").alias("last"), F.sum("amount").alias("repaid"))
    empty = cup.groupBy("key").agg(F.bool_or(F.col("period_start") >= F.col("pay_date")).alias("empty"))
    units = joined(payment_units(bondization, key), i.select("key", "currency"), "key").groupBy("key").agg(F.bool_or(F.col("unit") != F.col("currency")).alias("foreign"))
    x = joined(joined(joined(i, paid, "key", "left"), empty, "key", "left"), units, "key", "left")
    reason = (
        F.when(F.col("secid").isNull(), "no code").when(F.col("currency").isNull(), "no currency").when(F.col("initial_face").isNull(), "no face value")
        .when(F.col("initial_face") <= 0, "face value is not positive").when(F.col("last").isNull() & F.col("maturity_date").isNull(), "neither amortizations nor maturity")
        .when(F.col("repaid") > F.col("initial_face"), "amortizations exceed the face value").when(F.col("empty"), "a coupon period is empty").when(F.col("foreign"), "a payment is in another currency")
    )
    x = x.withColumn("reason", reason)
    good = x.where("reason IS NULL").select("key", "secid", "name", "currency", "initial_face", F.coalesce("maturity_date", "last").alias("maturity_date"), F.col("last").isNull().alias("whole"), F.col("maturity_date").alias("told"))
    codes = good.select("key", "secid")
    made = good.where("whole").select("secid", F.col("maturity_date").alias("pay_date"), F.col("initial_face").alias("amount"), F.lit(True).alias("is_maturity"))
    given = joined(amo, good.select("key", "secid", "told"), "key").select("secid", "pay_date", "amount", F.coalesce(F.col("pay_date") == F.col("told"), F.lit(False)).alias("is_maturity"))
    return {
        "issues": good.drop("key", "whole", "told"), "coupons": joined(cup, codes, "key").drop("key"), "amortizations": given.unionByName(made), "offers": joined(off, codes, "key").drop("key"),
        "rejects": x.where("reason IS NOT NULL").select("key", "secid", "reason"),
    }


def shown_schedule(frames: dict[str, DataFrame], secid: str) -> DataFrame:
    """One issue's payments by date: (pay_date, kind, amount, known)."""
    mine = lambda n: frames[n].where(F.col("secid") == secid)
    row = lambda day, kind, amount: (F.col(day).alias("pay_date"), kind.alias("kind"), amount.cast(MONEY).alias("amount"))
    x = mine("coupons").select(*row("pay_date", F.lit("coupon"), F.col("amount")))
    x = x.unionByName(mine("amortizations").select(*row("pay_date", F.when(F.col("is_maturity"), "maturity").otherwise("amortization"), F.col("amount"))))
    x = x.unionByName(mine("offers").select(*row("offer_date", F.concat_ws(" ", F.lit("offer"), "kind"), F.lit(None))))
    return x.withColumn("known", F.col("amount").isNotNull()).orderBy("pay_date", "kind")
