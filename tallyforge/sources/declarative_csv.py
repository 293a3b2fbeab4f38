"""Declarative CSV files: openings and cash flows with all problems collected."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions import cleaning as c
from tallyforge.operators.ledger import digest

# Allowed words and defaults.
QUALITIES, FLOWS = ("known", "estimated", "unknown"), ("CASH_IN", "CASH_OUT", "TRANSFER")
CURRENCY, QUALITY = "RUB", "unknown"
MONEY, QUANTITY = "decimal(24,6)", "decimal(28,10)"


def csv_records(files: DataFrame, name_col: str = "file", content_col: str = "content") -> DataFrame:
    """(file, line, names, cells) of every record; line 1 is the header, whose record comes out too.

    The header says whether tabs or commas separate. One file is one row, and its records
    leave the task as they are read. Null or empty content gives a record without names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, text in zip(pdf["file"], pdf["content"]):
                text = (text or "").removeprefix("﻿")
                sep = "\t" if "\t" in text.split("\n", 1)[0] else ","
                names, line, out = None, 0, []
                for cells in csv.reader(io.StringIO(text, newline=""), delimiter=sep):
                    if not cells:
                        continue
                    if names is None:
                        names = cells = [x.strip().lower() for x in cells]
                    line += 1
                    out.append((name, line, names, cells))
                    if len(out) == 1000:
                        yield pd.DataFrame(out, columns=["file", "line", "names", "cells"])
                        out = []
                if names is None:
                    out.append((name, 1, [], []))
                yield pd.DataFrame(out, columns=["file", "line", "names", "cells"])

    d = files.select(F.col(name_col).alias("file"), F.col(content_col).cast("string").alias("content"))
    return d.mapInPandas(run, "file string, line long, names array<string>, cells array<string>")


def file_kind() -> Column:
    """Kind by the file's name, then by its columns; null where neither tells."""
    stem = F.regexp_replace(F.regexp_extract(F.lower("file"), r"([^/]*)$", 1), r"\.[^.]*$", "")
    has = lambda x: F.array_contains("names", x)
    by_name = F.when(F.contains(stem, F.lit("opening")) | F.contains(stem, F.lit("остат")), "opening_balances").when(F.contains(stem, F.lit("cash")) | F.contains(stem, F.lit("flow")), "cash_flows")
    by_columns = F.when(has("quantity") & (has("cost_basis") | has("basis_quality")), "opening_balances").when(has("amount") & has("kind"), "cash_flows")
    return F.coalesce(by_name, by_columns)


def declared_rows(records: DataFrame) -> DataFrame:
    """Typed rows with the list of their problems; rows of only blank cells are left out.

    A header record stays only if the file has a problem as a whole: it is empty, its first
    column is not id, or its kind is unknown. A repeated id names the first good row's line.
    """

    def raw(name: str) -> Column:
        at = F.array_position(F.reverse("names"), name)
        return F.when(at > 0, F.trim(F.get("cells", (F.size("names") - at).cast("int"))))

    cols = ("id", "account", "date", "ticker", "isin", "quantity", "cost_basis", "basis_quality", "kind", "amount", "currency", "note")
    x = records.withColumn("file_kind", file_kind()).withColumns({f"r_{n}": raw(n) for n in cols})
    r = lambda n: F.col(f"r_{n}")
    filled = lambda n: F.when(~c.is_blank(r(n)), r(n))
    opening, flow = F.col("file_kind") == "opening_balances", F.col("file_kind") == "cash_flows"
    x = x.withColumns({
        "date": c.parse_date(r("date")), "quantity": F.when(opening, c.parse_decimal(r("quantity"))), "cost_basis": F.when(opening, c.parse_decimal(r("cost_basis"))),
        "amount": F.when(flow, c.parse_decimal(r("amount")).cast(MONEY)), "currency": F.when(c.is_blank(r("currency")), CURRENCY).otherwise(c.parse_currency(r("currency"))),
        "basis_quality": F.when(opening, F.when(F.array_contains("names", "basis_quality"), r("basis_quality")).otherwise(QUALITY)),
        "kind": F.when(opening, "OPENING_BALANCE").when(flow, F.upper(r("kind"))), "ticker": F.when(opening, filled("ticker")), "isin": F.when(opening, filled("isin")), "note": filled("note"),
    })
    bad = lambda n, cond: F.when(cond, F.concat_ws("", F.lit("line "), F.col("line").cast("string"), F.lit(f", field {n}: "), F.coalesce(r(n), F.lit("missing"))))
    whole = F.when(F.size("names") == 0, "the file is empty").when(F.get("names", F.lit(0)) != "id", F.concat(F.lit("the first column is not id: "), F.get("names", F.lit(0)))).when(F.col("file_kind").isNull(), "the kind of file is unknown")
    row = F.array(
        bad("id", F.coalesce(r("id"), F.lit("")) == ""), bad("account", r("account").isNull()), bad("date", F.col("date").isNull()), bad("currency", F.col("currency").isNull()),
        bad("quantity", opening & F.col("quantity").isNull()), bad("cost_basis", opening & F.col("cost_basis").isNull() & ~c.is_blank(r("cost_basis"))), bad("basis_quality", opening & ~F.coalesce(F.col("basis_quality").isin(*QUALITIES), F.lit(False))),
        bad("kind", flow & ~F.coalesce(F.col("kind").isin(*FLOWS), F.lit(False))), bad("amount", flow & F.col("amount").isNull()),
    )
    header = F.col("line") == 1
    x = x.where(F.when(header, whole.isNotNull()).otherwise(whole.isNull() & F.exists("cells", lambda v: ~c.is_blank(v))))
    x = x.withColumn("problems", F.array_compact(F.when(header, F.array(whole)).otherwise(row)))
    good = F.size("problems") == 0
    w = W.partitionBy("file", "r_id", good).orderBy("line")
    x = x.withColumn("n", F.row_number().over(w)).withColumn("first", F.first("line").over(w))
    again = F.array(F.concat_ws("", F.lit("line "), F.col("line").cast("string"), F.lit(", field id: already in line "), F.col("first").cast("string")))
    x = x.withColumn("problems", F.when(good & (F.col("n") > 1), again).otherwise(F.col("problems")))
    return x.select("file", "file_kind", "line", F.col("r_id").alias("row_id"), F.col("r_account").alias("account"), "date", "kind", "ticker", "isin", "quantity", "cost_basis", "basis_quality", "amount", "currency", "note", "problems")


def file_problems(rows: DataFrame) -> DataFrame:
    return rows.select("file", "line", F.explode("problems").alias("problem"))


def sound_rows(rows: DataFrame) -> DataFrame:
    """Rows of the files without any problem: a file is taken whole or not at all."""
    wrong = F.bool_or(F.size("problems") > 0).over(W.partitionBy("file"))
    return rows.withColumn("wrong", wrong).where("NOT wrong").drop("wrong", "problems")


def declared_entries(rows: DataFrame) -> DataFrame:
    """Ledger entries: cash goes to amount, securities to quantity with amount 0, and CASH_OUT lowers cash."""
    opening, cash = F.col("kind") == "OPENING_BALANCE", F.col("ticker").isNull() & F.col("isin").isNull()
    amount = F.when(opening, F.when(cash, F.col("quantity").cast(MONEY)).otherwise(F.lit(0).cast(MONEY))).when(F.col("kind") == "CASH_OUT", -F.abs("amount")).otherwise(F.col("amount"))
    source = F.concat_ws(":", "file_kind", "row_id")
    ref = F.coalesce("isin", "ticker")
    return rows.select(
        digest(F.lit("csv"), F.col("account"), F.col("date"), F.col("kind"), ref, source).alias("natural_key"), F.col("kind").alias("event_type"), F.col("date").alias("trade_date"), F.col("date").alias("settlement_date"),
        "account", "ticker", "isin", F.when(opening & ~cash, F.col("quantity")).alias("quantity"), amount.cast(MONEY).alias("amount"), "currency", F.when(opening, F.col("cost_basis")).alias("cost_basis"), "basis_quality", source.alias("source_row_id"), "note",
    )


def read_declared(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all files under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{csv,tsv,txt}").load(path)
    return declared_rows(csv_records(files.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("content"))))
