"""Operator 10: bottom-k sketches of word-shingle hashes.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's
five-word shingles (lower-cased words; a shorter text is one shingle, a text without
words has an empty sketch). Sketches of parts merge into the sketch of the whole, and
two of them estimate resemblance, containment and the number of distinct shingles.

Defined cases: null text counts as empty; two empty sketches resemble each other by 1,
an empty and a non-empty one by 0, and an empty one is contained in any; very long texts
are sketched whole; equal hashes count once. In the edited-text comparison, documents are
ordered by id (null first) and then by text hash; repeated rows count once in that order
and all get the same result; a lone document is its own successor; an empty table gives
an empty result; columns beyond those named are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import SHINGLE_WORDS, SPACE, let, run_hashes, shingle_hashes, stash, table, words

K = 128


def sketch(text: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(words(text)))), 1, k)


def sketches_with_ends(head: Column, ends: list[Column], k: int = K) -> Column:
    """Sketches of several texts that begin alike, head + end for each end, as an array.

    The head's complete words are hashed once; each end is hashed with the head's last
    word and the four words before it, so that no run across the seam is missing.
    """
    near = SHINGLE_WORDS - 1
    w = words(head)
    gap = F.when(F.regexp_like(head, F.lit(f"[{SPACE}]$")), F.lit(" ")).otherwise(F.lit(""))

    def split(a: Column) -> Column:
        done = F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
        return F.struct(done.alias("done"), F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")).alias("last"))

    def of(x: Column, end: Column) -> Column:
        before = F.slice(x["done"], F.greatest(F.size(x["done"]) - (near - 1), F.lit(1)), near)
        b = F.concat(before, words(F.concat(x["last"], gap, end)))
        whole = F.size(x["done"]) <= near

        def seam(y: Column) -> Column:
            short = whole & F.size(y).between(1, near)
            return F.when(short, F.array(F.xxhash64(y))).otherwise(run_hashes(y))

        return let(b, seam)

    def all_of(x: Column) -> Column:
        base = F.struct(F.slice(F.sort_array(F.array_distinct(run_hashes(x["done"]))), 1, k).alias("base"))
        return let(base, lambda y: F.array(*[merged(y["base"], F.array_distinct(of(x, e)), k) for e in ends]))

    return let(let(w, split), all_of)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_sketches(df: DataFrame, by: list[str], sketch_col: str, k: int = K) -> DataFrame:
    """Sketches of parts, grouped: the k smallest distinct hashes of each group.

    Each part's hashes are aggregated by (group, hash) before they are ranked, so a
    group of many parts meets in one task only as its distinct hashes.
    """
    h = df.select(*by, F.explode_outer(sketch_col).alias("h")).distinct()
    salted = W.partitionBy(*by, F.pmod(F.xxhash64("h"), F.lit(64))).orderBy("h")
    first = h.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k)
    return first.groupBy(*by).agg(F.slice(F.sort_array(F.collect_list("h")), 1, k).alias(sketch_col))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    def of(u: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(a, b), u))
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(both / F.size(u))

    return let(merged(a, b, k), of)


def distinct_count(a: Column, k: int = K) -> Column:
    """Exact below k hashes, else (k - 1) over the k-th smallest hash as a fraction of the hash range."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of a's shingles that b has, from resemblance and the two counts."""
    r = resemblance(a, b, k)
    both = r / (1 + r) * (distinct_count(a, k) + distinct_count(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def text_form(a: Column) -> Column:
    return F.concat_ws(".", F.transform(a, lambda h: F.lower(F.hex(h))))


def successors(docs: DataFrame) -> DataFrame:
    """(id, th, n) of each distinct document with nid, nth of the next in ascending order; the last gets the first.

    The ids are range-partitioned and looked ahead within each partition; only the first
    id of every partition (as many rows as partitions) goes through one task.
    """
    keys = docs.groupBy("id", "th").agg(F.max("n").alias("n"))
    keys = stash(keys.repartitionByRange("id", "th").sortWithinPartitions("id", "th").withColumn("pid", F.spark_partition_id()), "op10-order")
    here = F.lead(F.struct("id", "th")).over(W.partitionBy("pid").orderBy("id", "th"))
    heads = keys.groupBy("pid").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "th")).alias("head"))
    ring = W.orderBy("pid").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = F.coalesce(F.lead("head").over(W.orderBy("pid")), F.first("head").over(ring))
    heads = heads.select("pid", after.alias("after"))
    x = keys.withColumn("here", here).join(heads, "pid")
    return x.select("id", "th", "n", F.when(F.col("here").isNotNull(), F.col("here.id")).otherwise(F.col("after.id")).alias("nid"), F.when(F.col("here").isNotNull(), F.col("here.th")).otherwise(F.col("after.th")).alias("nth"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Sketches of each text, of its edited text and of the next text, with their likeness.

    The edited text has its last quarter (code points) replaced by the start of the next
    document. Each next document sends that start and its sketch to its predecessor, so a
    whole text is shuffled once.
    """
    def key(i: str, th: str) -> list[Column]:
        """A row's place as plain values, so that one hash partitioning serves both joins and the grouping."""
        return [F.coalesce(F.col(i).cast("string"), F.lit("")).alias("k"), F.col(i).isNull().alias("k0"), F.col(th).alias("kh")]

    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), t.alias("text")).withColumn("th", F.xxhash64("text"))
    follow = stash(successors(d.select("id", "th", F.char_length("text").cast("long").alias("n"))), "op10-next")
    wanted = follow.select(*key("nid", "nth"), F.struct(*key("id", "th")).alias("to"), F.floor(F.col("n") / 4).cast("int").alias("m"))
    text = d.select(*key("id", "th"), "text")  # the same columns for both joins: its exchange is reused
    at = ["k", "k0", "kh"]
    sent = text.join(wanted, at).select("to.*", F.struct(F.substring("text", F.lit(1), F.col("m")).alias("start"), sketch(F.col("text"), k).alias("next_fp")).alias("s"))
    sent = sent.groupBy(*at).agg(F.first("s").alias("s")).select(*at, "s.*")
    x = text.join(sent, at)
    n = F.char_length("text")
    m = F.floor(n / 4).cast("int")
    x = x.select(F.when(~F.col("k0"), F.col("k")).cast(dict(d.dtypes)["id"]).alias("id"), "next_fp", "start", n.alias("n"), F.substring("text", F.lit(1), n - m).alias("head"), F.substring("text", n - m + 1, m).alias("tail"))
    x = x.withColumn("fps", sketches_with_ends(F.col("head"), [F.col("tail"), F.col("start")], k))
    return x.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), F.sha2(F.concat("head", "start"), 256).alias("edited_sha256"),
        F.col("fps")[0].alias("fp"), F.col("fps")[1].alias("edited_fp"), "next_fp",
    )


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fingerprint_edits(table(spark, sf_dir, "documents"))
    return x.select(
        "doc_id", "n_chars", "edited_sha256", text_form(F.col("fp")).alias("fingerprint"), text_form(F.col("edited_fp")).alias("edited_fingerprint"),
        F.round(resemblance(F.col("fp"), F.col("edited_fp")), 6).alias("near_edited"), F.round(resemblance(F.col("fp"), F.col("next_fp")), 6).alias("near_next"),
        F.round(distinct_count(F.col("fp")), 3).alias("n_shingles"), F.round(containment(F.col("fp"), F.col("next_fp")), 6).alias("held_by_next"),
    )
