"""A ledger (or run) folder with commits that are all or nothing, and pruned loading.

A batch's files go to a folder of their own, cut by key bucket and month. What counts is
only the newest manifest, which names each batch's folder: a manifest is written beside
the others and then renamed to the next number, which fails if another writer has taken it.
So a crash before that leaves nothing that a reader sees, a batch id that is committed
again replaces what it held before, and a reader that has opened a manifest keeps its
files. Spark's scan prunes buckets and months by the partition folders.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

#: Parts that one bucket's month is dealt over, so that a key with most rows is not one task's.
SPREAD = 4


@dataclass(frozen=True)
class Layout:
    """How rows are cut: by a hash of ``key`` into ``buckets``, and by the month of ``day``; ``order`` is the stable order inside."""

    key: str = "account_id"
    day: str = "trade_date"
    order: tuple[str, ...] = ("trade_date", "id")
    buckets: int = 64

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")


def exists(spark: SparkSession, root: str) -> bool:
    """Whether the folder is there and holds anything."""
    fs, at = _files(spark, root)
    return fs.exists(at(".")) and len(fs.listStatus(at("."))) > 0


def manifest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """(number, content) of the newest manifest; (0, no batches) where there is none."""
    fs, at = _files(spark, root)
    if not fs.exists(at("manifest")):
        return 0, {"batches": {}, "schema": None}
    names = [s.getPath().getName() for s in fs.listStatus(at("manifest"))]
    numbers = [int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")]
    if not numbers:
        return 0, {"batches": {}, "schema": None}
    text = spark.read.text(f"{root}/manifest/v{max(numbers):010d}.json", wholetext=True).first()[0]
    return max(numbers), json.loads(text)


def _publish(spark: SparkSession, root: str, number: int, content: dict) -> None:
    fs, at = _files(spark, root)
    jvm = spark._jvm
    fs.mkdirs(at("manifest"))
    draft, final = at(f"manifest/draft-{uuid.uuid4().hex}"), at(f"manifest/v{number:010d}.json")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    plain[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")  # never over a manifest that is there
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, final, plain)
    except Exception:
        fs.delete(draft, False)
        raise


def commit(rows: DataFrame, root: str, batch: str, layout: Layout = Layout(), tries: int = 5) -> int:
    """Write ``rows`` as batch ``batch`` in place of what that batch held before; the manifest's new number.

    Writers of other batches may commit meanwhile: the manifest is then made anew.
    Columns that earlier batches lack are null there; a column of another type is an error.
    """
    spark, folder = rows.sparkSession, f"data/commit={uuid.uuid4().hex}"
    cut = rows.withColumns({"bucket": layout.bucket(F.col(layout.key)), "month": F.date_format(layout.day, "yyyy-MM")})
    part = F.pmod(F.xxhash64(*[F.col(c) for c in layout.order]), F.lit(SPREAD))
    cut.repartition("bucket", "month", part).sortWithinPartitions("bucket", "month", *layout.order).write.partitionBy("bucket", "month").parquet(f"{root}/{folder}")
    for last in range(tries):
        number, content = manifest(spark, root)
        known = StructType.fromJson(content["schema"]) if content["schema"] else StructType()
        changed = [f.name for f in rows.schema if f.name in known.names and known[f.name].dataType != f.dataType]
        if changed:
            raise TypeError(f"columns of another type than in {root}: {changed}")
        fields = list(known) + [f for f in rows.schema if f.name not in known.names]
        content = {"batches": content["batches"] | {batch: folder}, "schema": StructType(fields).jsonValue()}
        try:
            _publish(spark, root, number + 1, content)
            return number + 1
        except Exception as e:  # another writer was first
            if last == tries - 1 or "FileAlreadyExistsException" not in str(e):
                raise
    raise AssertionError


def read(spark: SparkSession, root: str, without: str | None = None, number: int | None = None) -> DataFrame | None:
    """All committed rows with their bucket and month, as of the newest manifest or an earlier one; None before the first commit.

    ``without`` leaves one batch out, for a batch that is tried again.
    """
    if number is None:
        _, content = manifest(spark, root)
    else:
        content = json.loads(spark.read.text(f"{root}/manifest/v{number:010d}.json", wholetext=True).first()[0])
    if not content["schema"]:
        return None
    schema = StructType.fromJson(content["schema"]).add("commit", StringType()).add("bucket", IntegerType()).add("month", StringType())
    folders = [f"{root}/{f}" for b, f in sorted(content["batches"].items()) if b != without]
    if not folders:
        return spark.createDataFrame([], schema).drop("commit")
    return spark.read.schema(schema).option("basePath", f"{root}/data").parquet(*folders).drop("commit")


def load(spark: SparkSession, root: str, key, until=None, layout: Layout = Layout()) -> DataFrame:
    """One key's rows up to a day, in stable order; only its bucket's folders and the months up to that day are read."""
    rows = read(spark, root)
    if rows is None:
        raise FileNotFoundError(f"nothing is committed in {root}")
    kind = dict(rows.dtypes)[layout.key]
    mine = rows.where((F.col("bucket") == layout.bucket(F.lit(key).cast(kind))) & (F.col(layout.key) == F.lit(key)))
    if until is not None:
        day = F.lit(until).cast("date")
        mine = mine.where((F.col("month") <= F.date_format(day, "yyyy-MM")) & (F.col(layout.day) <= day))
    return mine.drop("bucket", "month").orderBy(*layout.order)


def swept(spark: SparkSession, root: str) -> list[str]:
    """Delete folders and drafts that the newest manifest doesn't name, such as those of failed or replaced batches. Not while writers or readers of older manifests are at work."""
    _, content = manifest(spark, root)
    fs, at = _files(spark, root)
    live, gone = set(content["batches"].values()), []
    for kind, keep in (("data", lambda n: f"data/{n}" in live), ("manifest", lambda n: n.startswith("v"))):
        for s in fs.listStatus(at(kind)) if fs.exists(at(kind)) else []:
            if not keep(s.getPath().getName()):
                fs.delete(s.getPath(), True)
                gone.append(s.getPath().getName())
    return sorted(gone)
