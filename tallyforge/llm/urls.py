"""Operator 7: URL filter by host and path rules, then by two character language models.

A rule fits its host and all subdomains where the path starts with the rule's path; the
longest fitting rule decides. Every other url is scored by two smoothed variable-order
Markov models, of accepted and of rejected urls (those that rules decide), by the
difference of their mean log-likelihoods a character of the whole url, its host in lower
case; the threshold is calibrated on urls that the models have not seen. No sample is taken:
of each verdict's distinct urls, one half by hash is counted and the other calibrates, all
in Spark. Counts of character runs are sums in ``BUCKETS`` buckets of their hashes, so the
models are of one size for any table; runs that share a bucket are counted together.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no
rule and is left to the models (null and an empty string are allowed); a url with a host
but no path does not start with a rule's ``/`` and fits none; very long urls are scored
whole; two rules of one length cannot both fit, as they name different hosts; a
difference equal to the threshold allows; repeated rows get equal verdicts and count once
in the models; without training urls of both kinds everything is allowed; null ids stay;
an empty table gives an empty result; columns beyond those named are ignored, whatever
their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import stash, table

# The rules of the contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = 5
#: Buckets of the runs' counts, a power of two; characters that a task counts or scores at once.
BUCKETS, PIECE = 1 << 20, 500_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.position(F.lit("://"), url) + 3))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))
    return host, F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def whole(url: Column) -> Column:
    """The url with its host in lower case; null is an empty string."""
    at = F.position(F.lit("://"), url)
    host = host_and_path(url)[0]
    text = F.concat(F.substr(url, F.lit(1), at + 2), host, F.substr(url, at + 3 + F.length(host)))
    return F.coalesce(F.when(at > 0, text).otherwise(url), F.lit(""))


def ruled(urls: DataFrame, url_col: str, rules=RULES) -> DataFrame:
    """Add host, path, rule and the rule's verdict (null where no rule fits)."""
    host, path = host_and_path(F.col(url_col))
    d = urls.withColumn("host", host).withColumn("path", path)
    rule = verdict = F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: len(x[0])):
        h, _, p = r.partition("/")
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit("/" + p))
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return d.withColumn("rule", rule).withColumn("verdict", verdict)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def runs(strings: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of what stands before each character and of that with the character, a line for each length from 0 to ``order``; where each string begins."""
    long = np.array([len(s) + 1 for s in strings])
    c = np.frombuffer("".join("\x02" * order + s + "\x03" for s in strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start = np.cumsum(long) - long
    at = np.arange(long.sum()) + np.repeat(np.arange(1, len(long) + 1) * order, long)
    x, before, whole = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64), [], []
    for k in range(order + 1):
        x = mixed(x ^ c[at - k]) if k else x
        before.append(x)
        whole.append(mixed((x + np.uint64(0xD6E8FEB86659FD93)) ^ (c[at] * np.uint64(0x94D049BB133111EB))))
    return np.stack(before), np.stack(whole), start


def pieces(strings: list[str]) -> Iterator[list[str]]:
    """The strings in lists of about ``PIECE`` characters."""
    held, size = [], 0
    for s in strings:
        held.append(s)
        size += len(s)
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def run_counts(strings: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct run, what stands before its last character, and how often it occurs."""
    before, whole, _ = runs(strings, order)
    whole, first, n = np.unique(whole, return_index=True, return_counts=True)
    return whole, before.ravel()[first], n


class CharModel:
    """Variable-order Markov model: each order is smoothed with the next lower one (Witten-Bell); runs are counted in ``BUCKETS`` buckets of their hashes."""

    def __init__(self, strings: list[str] = (), order: int = ORDER):
        self.order = order
        self.counts, self.total, self.kinds = (np.zeros(BUCKETS, np.int64) for _ in range(3))
        if strings:
            whole, before, n = run_counts(strings, order)
            for to, at, x in ((self.counts, whole, n), (self.total, before, n), (self.kinds, before, 1)):
                np.add.at(to, at % np.uint64(BUCKETS), x)

    def __getstate__(self):
        """Empty buckets aren't sent to the workers."""
        tables = (self.counts, self.total, self.kinds)
        return self.order, [(at := np.flatnonzero(x).astype(np.int32), x[at]) for x in tables]

    def __setstate__(self, state):
        self.__init__(order=state[0])
        for to, (at, x) in zip((self.counts, self.total, self.kinds), state[1]):
            to[at] = x

    def means(self, strings: list[str]) -> np.ndarray:
        out = []
        for some in pieces(strings):
            before, whole, start = runs(some, self.order)
            p = np.full(before.shape[1], 1 / 128)
            for x, g in zip(before % np.uint64(BUCKETS), whole % np.uint64(BUCKETS)):
                n, kinds = self.total[x], self.kinds[x]
                p = np.where(n > 0, (self.counts[g] + kinds * p) / np.maximum(n + kinds, 1), p)
            out.append(np.add.reduceat(np.log(p), start) / [len(s) + 1 for s in some])
        return np.concatenate(out) if out else np.zeros(0)

    def mean(self, s: str) -> float:
        return float(self.means([s])[0])


class UrlModel:
    def __init__(self, allowed: list[str], blocked: list[str]):
        self.ready, self.threshold = bool(allowed and blocked), 0.0
        if self.ready:
            self.allow, self.block = CharModel(allowed[::2] or allowed), CharModel(blocked[::2] or blocked)
            own = [(self.difference(s), y) for y, xs in ((1, allowed[1::2]), (0, blocked[1::2])) for s in xs]
            self.threshold = calibrated(own)

    def differences(self, strings: list[str]) -> np.ndarray:
        return self.allow.means(strings) - self.block.means(strings)

    def difference(self, s: str) -> float:
        return float(self.differences([s])[0])

    def verdicts(self, strings: list[str]) -> list[str]:
        if not self.ready:
            return ["allow"] * len(strings)
        return ["allow" if not s or x >= self.threshold else "block" for s, x in zip(strings, self.differences(strings))]


def calibrated(scored: list[tuple[float, int]]) -> float:
    """The threshold with the fewest errors, the kinds weighing alike: the middle of the widest gap that has them; 0 without scores of both kinds."""
    n = Counter(y for _, y in scored)
    if len(n) < 2:
        return 0.0
    scored = sorted(scored)
    best, at, error = (1.0, 0.0), scored[0][0], 1.0
    for i, (x, y) in enumerate(scored):
        gap = x - scored[i - 1][0] if i else 0.0
        if (error, -gap) < best or i == 0:
            best, at = (error, -gap), x - gap / 2
        error += 1 / n[1] if y else -1 / n[0]
    return at


def threshold_of(scored: DataFrame) -> float:
    """``calibrated`` of a table (x, allow), without bringing it together: ranges of scores are summed, and each range's best is found with the sums before it."""
    d = scored.groupBy("x").agg(F.sum(F.col("allow").cast("long")).alias("a"), F.sum((~F.col("allow")).cast("long")).alias("b"))
    d = stash(d.repartitionByRange("x").withColumn("part", F.spark_partition_id()), "op7-scores")
    parts = sorted(d.groupBy("part").agg(F.min("x").alias("x"), F.max("x").alias("end"), F.sum("a").alias("a"), F.sum("b").alias("b")).collect(), key=lambda r: r.x)
    a = b = 0
    end, before = None, []
    for r in parts:
        before.append((r.part, a, b, end))
        a, b, end = a + r.a, b + r.b, r.end
    if not a or not b:
        return 0.0
    d = d.join(d.sparkSession.createDataFrame(before, "part int, a0 long, b0 long, end double"), "part")
    w = W.partitionBy("part").orderBy("x")
    so_far = lambda c: (F.sum(c).over(w) - F.col(c) + F.col(f"{c}0")).cast("decimal(19,0)")
    gap = F.coalesce(F.col("x") - F.coalesce(F.lag("x").over(w), F.col("end")), F.lit(0.0))
    errors = so_far("a") * F.lit(b).cast("decimal(19,0)") - so_far("b") * F.lit(a).cast("decimal(19,0)")
    best = d.select(F.struct(errors.alias("errors"), (-gap).alias("gap"), "x").alias("best")).agg(F.min("best").alias("best")).first().best
    return best.x + best.gap / 2


def fit_url_model(urls: DataFrame, url_col: str = "url", rules=RULES) -> UrlModel:
    """Learn from every distinct url that rules decide: half of each verdict's, by hash, are counted, the others give the threshold."""
    model = UrlModel([], [])
    d = ruled(urls.select(F.col(url_col).alias("url")), "url", rules).where(F.col("verdict").isNotNull()).select((F.col("verdict") == "allow").alias("allow"), whole(F.col("url")).alias("whole")).distinct()
    d = stash(d.withColumn("learn", F.pmod(F.xxhash64("whole"), F.lit(2)) == 0), "op7-decided")
    sizes = {r.allow: r.n for r in d.groupBy("allow").agg(F.sum(F.col("learn").cast("long")).alias("n")).collect()}
    if len(sizes) < 2:
        return model
    for kind, n in sizes.items():
        if not n:
            d = d.withColumn("learn", F.col("learn") | (F.col("allow") == kind))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column("allow").to_numpy(zero_copy_only=False)
            text = np.array(batch.column("whole").to_pylist(), object)
            for k in (False, True):
                for some in pieces(text[kind == k].tolist()):
                    g, x, n = run_counts(some)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k)), pa.array(g.view(np.int64)), pa.array(x.view(np.int64)), pa.array(n)], ["allow", "g", "x", "n"])

    bucket = lambda c: F.col(c).bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket")
    n = d.where("learn").select("allow", "whole").mapInArrow(count, "allow boolean, g long, x long, n long").groupBy("allow", "g", "x").agg(F.sum("n").alias("n"))
    n = stash(n, "op7-runs")
    ones = n.groupBy("allow", bucket("g")).agg(F.sum("n").alias("counts"))
    tops = n.groupBy("allow", bucket("x")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    model.allow, model.block, model.ready = CharModel(), CharModel(), True
    for got, names in ((ones.toArrow(), ["counts"]), (tops.toArrow(), ["total", "kinds"])):
        kind, at = got.column("allow").to_numpy(), got.column("bucket").to_numpy()
        for m, k in ((model.allow, True), (model.block, False)):
            for name in names:
                getattr(m, name)[at[kind == k]] = got.column(name).to_numpy()[kind == k]
    shared = d.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(m.differences(batch.column("whole").to_pylist()), pa.float64()), batch.column("allow")], ["x", "allow"])

    model.threshold = threshold_of(d.where("NOT learn").select("allow", "whole").mapInArrow(score, "x double, allow boolean"))
    return model


def judge_urls(urls: DataFrame, model: UrlModel, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """id, host, path, rule, verdict of every url."""
    d = ruled(urls.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), "url", rules)
    schema = d.drop("url").schema
    d = d.select(*schema.names, whole(F.col("url")).alias("whole"))
    shared = d.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            open_ = pdf["verdict"].isna()
            pdf.loc[open_, "verdict"] = m.verdicts(pdf.loc[open_, "whole"].tolist())
            yield pdf.drop(columns="whole")

    return d.mapInPandas(run, schema)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, fit_url_model(pages))
