"""Accounts and instruments: found or made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import cleaning as c
from tallyforge.operators.connected import groups
from tallyforge.operators.staging import dealt_out, looked_up, numbered, staged

# Forms of bond codes and words in names.
BOND_TICKER, BOND_ISIN = r"^(SU\d{5}RMFS\d|RU000[A-Z0-9]{8})$", "RU000A"
BOND_NAMES, FUND_NAMES = ("облигац", "офз", "бонд"), ("фонд", "етф", "etf", "пиф")


def guess_kind(ticker: Column, isin: Column, name: Column) -> Column:
    """bond, etf, share or other, by the form of the codes and then by words of the name."""
    code, low = F.coalesce(c.ticker(ticker), F.lit("")), F.lower(F.coalesce(name, F.lit("")))
    has = lambda words: F.regexp_like(low, F.lit("|".join(words)))
    bond = F.regexp_like(code, F.lit(BOND_TICKER)) | F.startswith(F.upper(F.coalesce(isin, F.lit(""))), F.lit(BOND_ISIN))
    return F.when(bond | has(BOND_NAMES), "bond").when(has(FUND_NAMES), "etf").when(code != "", "share").otherwise("other")


def with_identity(rows: DataFrame, tickers: DataFrame) -> DataFrame:
    """``rows`` with ref: the ISIN, else the ISIN that the ticker goes with, else the ticker."""
    x = looked_up(rows, tickers.withColumnRenamed("ticker", "key"), F.when(F.col("isin").isNull(), F.col("ticker")), "isin", "seq")
    ref = F.when(F.col("isin").isNotNull(), F.concat(F.lit("I"), "isin")).when(F.coalesce("isins", F.lit(0)) > 1, None).when(F.col("its").isNotNull(), F.concat(F.lit("I"), "its")).otherwise(F.concat(F.lit("T"), "ticker"))
    return x.withColumn("ref", ref).drop("its", "isins")


def resolve_instruments(mentions: DataFrame, instruments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with instrument_id, the dimension after them, rejects).

    ``mentions`` has seq (their order), ticker, isin, name, currency; ``instruments`` has
    instrument_id, ticker, isin, name, kind, currency, with unique tickers and ISINs. A
    mention goes by ISIN first and ticker second, and links the two; an attribute that is
    known stays, an unknown one is taken from the first mention that has it. A mention
    without codes has no instrument. A mention by a ticker alone that goes with several
    ISINs, none of them the dimension's, is rejected; two known instruments stay two.
    """
    cols, codes = ("ticker", "isin", "name", "currency"), F.concat("ticker", F.lit("|"), "isin")
    clean = lambda x: x.withColumns({"ticker": c.ticker(F.col("ticker")), "isin": c.isin(F.col("isin"))})
    # mentions that say the same are one, with the first place; all that follows works on these
    said = staged(clean(mentions.groupBy(*cols).agg(F.min("seq").cast("long").alias("seq"))), "said")
    # a mention whose codes belong to two known instruments goes by its ISIN and links nothing
    clash = said.select("ticker", "isin").distinct().join(instruments.where("isin IS NULL").select("ticker"), "ticker", "left_semi").join(instruments.where("isin IS NOT NULL").select("isin"), "isin", "left_semi").select(codes.alias("key"), F.lit(True).alias("clash"))
    apart = lambda x: looked_up(x, clash, codes, *cols, "seq").withColumn("ticker", F.when(F.col("clash").isNull(), F.col("ticker"))).drop("clash")
    said, m = apart(said), apart(clean(mentions))
    known = instruments.select(*cols, F.lit(-1).cast("long").alias("seq"), F.col("instrument_id").cast("long").alias("old_id"), "kind")
    told = said.where("ticker IS NOT NULL OR isin IS NOT NULL").select(*cols, "seq", F.lit(None).cast("long").alias("old_id"), F.lit(None).cast("string").alias("kind"))
    every = known.unionByName(told)
    pairs = every.where("ticker IS NOT NULL AND isin IS NOT NULL").groupBy("ticker").agg(F.min_by("isin", F.struct("seq", "isin")).alias("its"), F.count_distinct("isin").alias("isins"), F.min("seq").alias("from"))
    # written, so that Spark knows what is small enough to be sent to the mentions, which then stay where they are
    tickers = staged(pairs.select("ticker", "its", F.when(F.col("from") < 0, 1).otherwise(F.col("isins")).alias("isins")), "tickers")
    every = with_identity(every, tickers).where("ref IS NOT NULL")
    first = lambda x: F.min_by(x, F.when(F.col(x).isNotNull(), F.struct("seq", x))).alias(x)
    g = staged(every.groupBy("ref").agg(*[first(x) for x in cols], F.min("old_id").alias("old_id"), F.max("kind").alias("kind"), F.min("seq").alias("seq")), "instruments")
    top = instruments.agg(F.coalesce(F.max("instrument_id"), F.lit(0))).first()[0]
    fresh = numbered(g.where("old_id IS NULL"), ["seq", "ref"], top + 1, "instrument_id")
    g = g.where("old_id IS NOT NULL").withColumn("instrument_id", F.col("old_id")).unionByName(fresh)
    kind = F.when(F.col("kind").isNull() | (F.col("kind") == "other"), guess_kind(F.col("ticker"), F.col("isin"), F.col("name"))).otherwise(F.col("kind"))
    g = staged(g.withColumn("kind", kind), "dimension")
    rows = looked_up(with_identity(m, tickers), g.select(F.col("ref").alias("key"), "instrument_id"), F.col("ref"), "seq")
    coded = F.col("ticker").isNotNull() | F.col("isin").isNotNull()
    lost = coded & F.col("instrument_id").isNull()
    return rows.where(~lost).drop("ref"), g.select("instrument_id", *cols, "kind"), rows.where(lost).drop("ref", "instrument_id").withColumn("reason", F.lit("the ticker goes with several ISINs"))


def resolve_chains(mentions: DataFrame, instruments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with instrument_id, the dimension's codes after them, rejects), through chains of mentions of any length.

    ``mentions`` has seq (unique), ticker, isin; ``instruments`` has instrument_id, ticker,
    isin (either may be null). Codes that one mention or one known instrument names together
    are one instrument, and so is whatever is linked through further codes. A group

    * without a known instrument is a new one; ids follow the order of first mentions;
    * with one known instrument is that one, and its other codes become the instrument's;
    * with several is in conflict: a mention goes to the known instrument of its own ISIN,
      else of its own ticker, and is rejected if it has neither; nothing is linked.

    A mention without codes stays, without an instrument. The codes after the batch are
    (instrument_id, code), ``I`` or ``T`` before an ISIN or a ticker.
    """
    tagged = lambda x: x.withColumns({"t": F.concat(F.lit("T"), c.ticker(F.col("ticker"))), "i": F.concat(F.lit("I"), c.isin(F.col("isin")))})
    # few bytes but dear to clean: dealt out, and cleaned once
    m, k = staged(tagged(dealt_out(mentions)), "mentions"), tagged(instruments)
    node = lambda x: x.select(F.coalesce("i", "t").alias("a"), F.coalesce("t", "i").alias("b"))
    group = staged(groups(node(m).unionByName(node(k))), "chains")
    codes = k.select(F.col("instrument_id").cast("long").alias("instrument_id"), F.explode(F.array("t", "i")).alias("node")).where("node IS NOT NULL")
    known = codes.join(group, "node").groupBy("label").agg(F.min("instrument_id").alias("instrument_id"), (F.min("instrument_id") != F.max("instrument_id")).alias("conflict"))
    m = looked_up(m, group.join(known, "label", "left").withColumnRenamed("node", "key"), F.coalesce("i", "t"), "seq")
    m = staged(m, "chained")
    top = instruments.agg(F.coalesce(F.max("instrument_id"), F.lit(0))).first()[0]
    fresh = m.where("label IS NOT NULL AND instrument_id IS NULL").groupBy("label").agg(F.min("seq").alias("seq"))
    fresh = staged(numbered(fresh, ["seq"], top + 1, "fresh").select("label", "fresh"), "fresh")
    own = codes.groupBy("node").agg(F.min("instrument_id").alias("own"))
    m = looked_up(m, fresh.select(F.col("label").cast("string").alias("key"), "fresh"), F.when(F.col("instrument_id").isNull(), F.col("label").cast("string")), "seq")
    # only a group in conflict asks for its own codes
    torn = lambda x: F.when(F.col("conflict"), F.col(x))
    m = looked_up(looked_up(m, own.toDF("key", "by_isin"), torn("i"), "seq"), own.toDF("key", "by_ticker"), torn("t"), "seq")
    m = m.withColumn("instrument_id", F.when(F.col("conflict"), F.coalesce("by_isin", "by_ticker")).otherwise(F.coalesce("instrument_id", "fresh")))
    plain = m.select(*[f"`{x}`" for x in mentions.columns], "instrument_id", "label")
    lost = F.col("label").isNotNull() & F.col("instrument_id").isNull()
    # a group in conflict keeps the codes it had
    told = group.join(known.where("NOT conflict").select("label", "instrument_id").unionByName(fresh.withColumnRenamed("fresh", "instrument_id")), "label").select("instrument_id", F.col("node").alias("code"))
    after = told.unionByName(codes.select("instrument_id", F.col("node").alias("code"))).distinct()
    rejects = plain.where(lost).drop("instrument_id", "label").withColumn("reason", F.lit("its chain joins known instruments"))
    return plain.where(~lost).drop("label"), after, rejects


def resolve_accounts(rows: DataFrame, accounts: DataFrame, code: str = "account") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with account_id, the dimension after them, rejects).

    Unknown codes are made. A row without a code goes to the one account, if there is just
    one in the dimension before the batch, and else to rejects.
    """
    named = rows.select(F.nullif(F.trim(F.col(code)), F.lit("")).alias("code")).where("code IS NOT NULL").distinct()
    top, n, only = accounts.agg(F.coalesce(F.max("account_id"), F.lit(0)), F.count("*"), F.min("account_id")).first()
    made = numbered(named.join(accounts.select("code"), "code", "left_anti"), ["code"], top + 1, "account_id")
    made = made.select("account_id", "code", F.concat(F.lit("Account "), "code").alias("name"), F.lit("BROKER").alias("kind"), F.lit("RUB").alias("currency"))
    after = accounts.select("account_id", "code", "name", "kind", "currency").unionByName(made)
    ids = after.select(F.col("code").alias("_code"), F.col("account_id").cast("long").alias("account_id"))
    x = rows.join(ids, F.nullif(F.trim(F.col(code)), F.lit("")) == F.col("_code"), "left").drop("_code")
    if n == 1:
        x = x.withColumn("account_id", F.coalesce("account_id", F.lit(only).cast("long")))
    return x.where("account_id IS NOT NULL"), after, x.where("account_id IS NULL").drop("account_id").withColumn("reason", F.lit("no account code, and not one account"))
