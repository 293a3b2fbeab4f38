"""Exchange answers kept as JSON files: blocks of columns and data, catalog, pages, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import cleaning as c
from tallyforge.operators.store import Layout, commit, read

BLOCKS = "map<string, struct<columns: array<string>, data: array<array<string>>>>"
PATH = r"([^/]+)/([^/]+)/([^/]+)\.json$"


def block_rows(files: DataFrame, block: str, content_col: str = "content") -> DataFrame:
    """Columns of ``files`` but the content, with pos and row (a map from column to text) of every row of a block.

    Numbers keep their text. Files without the block, or that are not JSON, give no rows;
    ``without_block`` names them. Values beyond the columns are left out.
    """
    keep = [x for x in files.columns if x != content_col]
    x = files.select(*keep, F.try_element_at(F.from_json(content_col, BLOCKS), F.lit(block)).alias("b"))
    x = x.select(*keep, F.col("b.columns").alias("names"), F.posexplode("b.data").alias("pos", "data"))
    pairs = F.filter(F.arrays_zip(F.col("names"), F.slice("data", 1, F.size("names")).alias("data")), lambda p: p["names"].isNotNull())
    return x.select(*keep, "pos", F.map_from_entries(pairs).alias("row"))


def without_block(files: DataFrame, block: str, content_col: str = "content") -> DataFrame:
    b = F.try_element_at(F.from_json(content_col, BLOCKS), F.lit(block))
    return files.where(b.isNull()).drop(content_col)


def cell(name: str) -> Column:
    return F.try_element_at("row", F.lit(name))


def descriptions(files: DataFrame, key: str = "secid") -> DataFrame:
    """(key, fields): the description block as one map; the last of repeated names counts."""
    x = block_rows(files, "description").where(cell("name").isNotNull() & cell("value").isNotNull())
    x = x.groupBy(key, cell("name").alias("name")).agg(F.max_by(cell("value"), "pos").alias("value"))
    return x.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("fields"))


def board_quotes(files: DataFrame) -> DataFrame:
    """(board, secid, row): listed securities with the market's columns over the static ones."""
    static = block_rows(files, "securities").select("board", "pos", cell("SECID").alias("secid"), "row")
    static = static.groupBy("board", "secid").agg(F.min("pos").alias("pos"), F.max_by("row", "pos").alias("row"))
    live = block_rows(files, "marketdata").select("board", "pos", cell("SECID").alias("secid"), F.map_filter("row", lambda k, v: k != "SECID").alias("live"))
    live = live.groupBy("board", "secid").agg(F.max_by("live", "pos").alias("live"))
    both = F.when(F.col("live").isNull(), F.col("row")).otherwise(F.map_concat(F.map_filter("row", lambda k, v: ~F.map_contains_key("live", k)), F.col("live")))
    return static.join(live, ["board", "secid"], "left").select("board", "secid", "pos", both.alias("row"))


def board_codes(files: DataFrame, first: int | None = None) -> DataFrame:
    """(board, pos, secid) in the answer's order; ``first`` keeps so many of each board."""
    x = block_rows(files, "securities").select("board", "pos", cell("SECID").alias("secid")).where("secid IS NOT NULL")
    return x if first is None else x.where(F.col("pos") < first)


def combined_pages(files: DataFrame, block: str, key: str, page: str) -> DataFrame:
    """All pages of a block as one relation: (key, page, pos, row), each page's own columns naming its values."""
    return block_rows(files, block).select(key, page, "pos", "row")


def read_snapshots(spark: SparkSession, root: str, day: str | None = None, endpoint: str | None = None) -> DataFrame:
    """(day, endpoint, name, content) of ``root/day/endpoint/name.json``; the latest day if none is named.

    A root without any snapshot of the day is an error, as an empty result would hide it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root)
    part = lambda i: F.regexp_extract("path", PATH, i)
    listed = files.select(part(1).alias("day"), part(2).alias("endpoint"), part(3).alias("name"), "content")
    if day is None:
        day = listed.agg(F.max("day")).first()[0]
    listed = listed.where(F.col("day") == day)
    if day is None or listed.select("day").isEmpty():
        raise FileNotFoundError(f"no snapshot of {day or 'any day'} in {root}")
    return (listed if endpoint is None else listed.where(F.col("endpoint") == endpoint)).withColumn("content", F.decode("content", "UTF-8"))


def vanished(catalog: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    """Catalog rows whose file (by its path below ``root``) is no longer there."""
    under = f"/{root.split('://')[-1].strip('/')}/"
    name = lambda p: F.regexp_extract(p, r"([^/]+)$", 1)
    # what follows the root in the path; the file's name for a catalog that was made elsewhere
    key = lambda p: F.when(F.contains(p, F.lit(under)), F.substring_index(p, under, -1)).otherwise(F.concat(F.lit("/"), name(p)))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    there = files.select(F.explode(F.array(key(F.col("path")), F.concat(F.lit("/"), name(F.col("path"))))).alias("_key")).distinct()
    return catalog.join(there, key(catalog["path"]) == there["_key"], "left_anti")


RUNS = Layout(key="run_id", day="saved_on", order=("secid",), buckets=8)


def save_run(checks: DataFrame, path: str, run_id: str, **header: str) -> DataFrame:
    """Save a verification run, its rows and its header, in one commit; saved again, it replaces itself. Returns the header.

    Rows whose note is other than ok count as outliers.
    """
    rows = checks.withColumns({"run_id": F.lit(run_id), "saved_on": F.current_date(), **{f"run_{k}": F.lit(v) for k, v in header.items()}})
    commit(rows, path, run_id, RUNS)
    return runs(checks.sparkSession, path).where(F.col("run_id") == run_id)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each saved run: run_id, its header, and how many rows were checked and are outliers."""
    rows = read(spark, path)
    if rows is None:
        raise FileNotFoundError(f"no run is saved in {path}")
    header = [c for c in rows.columns if c.startswith("run_") and c != "run_id"]
    return rows.groupBy("run_id", *[F.col(c).alias(c[4:]) for c in header]).agg(F.count("*").alias("checked"), F.count_if(F.col("note") != "ok").alias("outliers"))


def iso_date(x: Column) -> Column:
    """A date of the exchange; blank, 0000-00-00 and unreadable ones are null."""
    return c.exchange_date(F.substring(F.trim(x), 1, 10))


def exchange_number(x: Column) -> Column:
    return F.nullif(F.replace(F.replace(F.trim(x), F.lit(" "), F.lit("")), F.lit(","), F.lit(".")), F.lit("")).try_cast("decimal(28,10)")
