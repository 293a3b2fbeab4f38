"""What the training-data operators share: tables, shared folder, samples, text pieces."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: ASCII white space between words, as a Java regular expression class body.
SPACE = r"\x20\x09-\x0D"
SHINGLE_WORDS = 5
#: Rows of one file of a small intermediate table, and the least number of its files.
PART_ROWS, LEAST_PARTS = 50_000, 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_id(df: DataFrame, id_col: str) -> Column:
    """The id column as a long; ids of another type than whole numbers are an error, as "the least id" must mean one thing."""
    kind = dict(df.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"{id_col} must hold whole numbers, not {kind}")
    return F.col(f"`{id_col}`").cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    Where the setting is absent and all tasks run on this machine, as in tests, a
    temporary folder is made once and set. A cluster must name one.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def in_parts(df: DataFrame, rows: int, each: int = PART_ROWS) -> DataFrame:
    """``df``, of about ``rows`` rows, in partitions of ``each`` rows, ``LEAST_PARTS`` at least; never in more than it has."""
    return df.coalesce(max(LEAST_PARTS, math.ceil(rows / each)))


def stash(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    With ``rows``, about how many it has at most, it is written in as many files as these need
    and not in one for each shuffle partition: a small table's time is that of its files.
    """
    spark = df.sparkSession
    df = df if rows is None else in_parts(df, rows)
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    got = spark.read.schema(schema).parquet(path)
    got.stash_path = path
    return got


def discard(*stashed: DataFrame) -> None:
    """Delete the files of tables that ``stash`` gave and nothing will read any more."""
    for df in stashed:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stash_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hashed_sample(rows: DataFrame, label: str, k: int) -> DataFrame:
    """At most ``k`` distinct rows of each label (null among them), the same ones in every run: those with the least hashes.

    One pass estimates how many distinct rows each label has (a mergeable sketch, 2 %
    error). A row whose 64-bit hash exceeds its label's share of the range, with a fifth and
    six standard deviations to spare, is then filtered where it is read, at any number of
    rows; equal rows meet in a partial aggregation, and only the bounded rest is ranked.
    Copies count once in the estimate too, so a label has fewer than ``k`` rows only where
    fewer differ.
    """
    enough = 1.2 * (k + 6 * math.sqrt(k) + 10)
    columns = [F.col(f"`{c}`") for c in rows.columns]
    h = F.xxhash64(*columns)
    sizes = rows.groupBy(label).agg(F.approx_count_distinct(h, 0.02).alias("n")).where(F.col("n") > enough).collect()
    bounds = {(r[label] is None, str(r[label])): enough / r["n"] * 2.0**64 - 2.0**63 for r in sizes}
    bound = F.lit(2.0**63)
    if bounds:
        names = F.array(*[F.lit(f"{int(null)}{name}") for null, name in bounds])
        at = F.array_position(names, F.concat(F.col(label).isNull().cast("int").cast("string"), F.coalesce(F.col(label).cast("string"), F.lit("None"))))
        bound = F.when(at > 0, F.get(F.array(*map(F.lit, bounds.values())), (at - 1).cast("int"))).otherwise(bound)
    d = rows.withColumn("_h", h).where(F.col("_h").cast("double") <= bound).distinct()
    d = d.withColumn("_r", F.row_number().over(W.partitionBy(label).orderBy("_h", *columns)))
    return d.where(F.col("_r") <= k).drop("_h", "_r")


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once a row, however often (and in whichever lambda) it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words(text: Column, lower: bool = True) -> Column:
    """White-space separated words of a text as an array; null and blank texts give an empty array."""
    t = F.coalesce(text, F.lit(""))
    return F.array_remove(F.split(F.lower(t) if lower else t, f"[{SPACE}]+"), "")


def windows(a: Column, n: int) -> Column:
    """All runs of ``n`` items as structs; none if there are fewer."""
    many = F.greatest(F.size(a) - (n - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(a, i + 1, many).alias(f"w{i}") for i in range(n)])


def run_hashes(a: Column, n: int = SHINGLE_WORDS) -> Column:
    """Hashes of all runs of exactly ``n`` words."""
    return F.transform(windows(a, n), lambda s: F.xxhash64(s))


def shingle_hashes(w: Column, n: int = SHINGLE_WORDS) -> Column:
    """Hashes of all runs of ``n`` words; a shorter text is one run, an empty one has none."""
    return let(w, lambda a: F.when(F.size(a).between(1, n - 1), F.array(F.xxhash64(a))).otherwise(run_hashes(a, n)))
