"""Streams: statements as they arrive, and ledger events without repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.operators import store
from tallyforge.operators.staging import staged
from tallyforge.operators.store import Layout


def ledger_dedupe_stream(events: DataFrame, within: str = "40 days", at: str = "recorded_at") -> DataFrame:
    """Events whose natural key has not come before within the watermark; state is let go after it."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark(["natural_key"])


KEYS = Layout(key="natural_key")


def append_new(batch: DataFrame, root: str, number: int, layout: Layout = KEYS) -> None:
    """Commit the batch's events whose natural key no other batch in ``root`` has, however long ago; tried again, it replaces itself.

    The keys of the committed rows are cut by their hash: only the buckets that the batch
    has are read, only their key column, and what the batch doesn't name is dropped before
    the batch is compared. Of equal keys in one batch the first by the layout's order stays;
    events without a key stay all.
    """
    spark = batch.sparkSession
    deal = F.when(F.col("natural_key").isNull(), F.xxhash64(*layout.order))  # rows without a key are not one group
    rank = F.row_number().over(W.partitionBy("natural_key", deal).orderBy(*layout.order))
    once = staged(batch.withColumn("_rank", rank).where("_rank = 1 OR natural_key IS NULL").drop("_rank"), "batch")
    keyed = once.where("natural_key IS NOT NULL")
    known = store.read(spark, root, without=f"stream-{number}")
    fresh = keyed
    if known is not None:
        buckets = [r[0] for r in keyed.select(layout.bucket(F.col("natural_key"))).distinct().collect()]  # at most layout.buckets
        met = known.where(F.col("bucket").isin(buckets)).select("natural_key").join(keyed.select("natural_key"), "natural_key", "left_semi")
        fresh = keyed.join(met, "natural_key", "left_anti")
    store.commit(fresh.unionByName(once.where("natural_key IS NULL")).select(*batch.columns), root, f"stream-{number}", layout)


def dedupe_into(events: DataFrame, root: str, checkpoint: str, layout: Layout = KEYS) -> StreamingQuery:
    """Events without repeats, batch by batch, into the committed ledger ``root``; nothing is forgotten."""
    return events.writeStream.foreachBatch(lambda batch, number: append_new(batch, root, number, layout)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def report_stream(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """(path, report, content) of HTML files as they arrive in ``folder``; report is the content's sha256."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.htm*").option("maxFilesPerTrigger", files_at_once).load(folder)
    return files.select("path", F.sha2("content", 256).alias("report"), "content")


def ingest_reports_stream(spark: SparkSession, folder: str, catalog: str, checkpoint: str, job: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Give ``job`` the files that ``catalog`` (Parquet of sha256, path, batch) doesn't have, batch by batch, and list them there.

    The catalog is written after ``job``: a batch that failed comes again with the same
    number, so ``job`` must not count a row twice (natural keys see to that for imports).
    A batch lists only its own files, and replaces what a former try of it has listed.
    """

    def each(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        schema = "sha256 string, path string, batch long"
        known = s.read.schema(schema).parquet(catalog).where(F.col("batch") != number) if store.exists(s, catalog) else s.createDataFrame([], schema)
        fresh = batch.where(F.length("content") > 0).dropDuplicates(["report"]).join(known.select(F.col("sha256").alias("report")), "report", "left_anti")
        listed = fresh.select(F.col("report").alias("sha256"), "path")
        job(fresh.select("report", "content"), number)
        listed.write.mode("overwrite").parquet(f"{catalog}/batch={number}")

    return report_stream(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
