"""Written intermediate tables, and ids in a stated order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    Where that is unset and all tasks run on this machine, a temporary folder is made; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    """Write ``df`` in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def dealt_out(df: DataFrame, *cols: str) -> DataFrame:
    """Rows that are small but dear to compute, over all shuffle partitions: by size alone they would be merged into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by shuffle and sort, for sides that grow with the data.

    Spark guesses a side's size from the bytes of its compressed files, and rows that are
    exploded or parsed from them count for nothing: left to itself it broadcasts, through
    the driver, what is a hundred times its threshold.
    """
    return left.join(right.hint("merge"), on, how)


def looked_up(rows: DataFrame, other: DataFrame, key: Column, *spread: str) -> DataFrame:
    """``rows`` with the columns of ``other`` where ``key``, a text, equals its column ``key``.

    Rows without a key find nothing. A plain left join sends all of them to one task, so
    they are dealt out by their columns ``spread`` instead.
    """
    mine = F.coalesce(F.concat(F.lit("k"), key), F.concat_ws("|", F.lit(""), *[F.col(x).cast("string") for x in spread]))
    return rows.withColumn("_mine", mine).join(other.withColumn("_mine", F.concat(F.lit("k"), "key")).drop("key"), "_mine", "left").drop("_mine")


def numbered(rows: DataFrame, order: list[str], first: int, name: str = "id") -> DataFrame:
    """Give ids from ``first`` on in ``order``.

    The range partitions are written before they are counted, so that counts and ids come
    from the same partitions; no task numbers more than one partition's rows. Where each
    partition starts is a running sum over one row a partition, joined back.
    """
    rows = staged(rows.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()), "numbered")
    before = W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("pid").agg(F.count("*").alias("n")).select("pid", (F.lit(first) + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("start"))
    at = F.row_number().over(W.partitionBy("pid").orderBy(*order)) - 1 + F.col("start")
    return rows.join(starts, "pid").withColumn(name, at.cast("long")).drop("pid", "start")
