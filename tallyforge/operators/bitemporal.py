"""Facts on two axes of time: when they hold, and since when they are known.

A fact says what holds from ``valid_from`` on, until the next fact's day, and is known from
``recorded_at`` on; a later record for the same day corrects the earlier one. The history
becomes rectangles: ``value`` holds on [valid_from, valid_to) as known on [known_from,
known_to), with nulls for no end. A new fact cuts short the one it falls into and a
correction ends the knowledge of the one before, so there are at most twice as many
rectangles as facts.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAR = "9999-12-31"


def rectangles(facts: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """by, valid_from, valid_to, known_from, known_to, value of all facts (by, valid_from, recorded_at dates, value, tie).

    Of facts recorded on one day for one day, the greatest ``tie`` counts. Equal values that
    follow each other in knowledge are merged. Keys are read in the order in which facts
    were recorded; of a key only what is known so far is held, one entry for each of its days.
    """
    f = facts.where("valid_from IS NOT NULL AND recorded_at IS NOT NULL").groupBy(*by, "valid_from", "recorded_at").agg(F.max_by(value, tie).alias("value"))
    f = f.select(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("key"), *by, F.unix_date("valid_from").alias("v"), F.unix_date("recorded_at").alias("k"), "value")
    kinds = dict(f.dtypes)
    names = [*by, "v", "vt", "k", "kt", "value"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, mine, starts, held = None, (), [], {}  # held: valid_from -> [valid_to, known_from, value]

        def closed(v, kt):
            vt, k, value = held[v]
            return [] if kt is not None and kt <= k else [(*mine, v, vt, k, kt, value)]

        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.key != key:
                    out += [r for v in starts for r in closed(v, None)]
                    key, mine, starts, held = row.key, tuple(getattr(row, b) for b in by), [], {}
                v, k, value = row.v, row.k, row.value
                if v in held:
                    if held[v][2] != value:
                        out += closed(v, k)
                        held[v] = [held[v][0], k, value]
                    continue
                i = bisect.bisect(starts, v)
                if i:
                    p = starts[i - 1]
                    out += closed(p, k)
                    held[p] = [v, k, held[p][2]]
                held[v] = [starts[i] if i < len(starts) else None, k, value]
                starts.insert(i, v)
            yield table(out)
        yield table([r for v in starts for r in closed(v, None)])

    def table(rows: list) -> pd.DataFrame:
        t = pd.DataFrame(rows, columns=names)
        return t.astype({c: "Int32" for c in ("v", "vt", "k", "kt")} | {"value": object})

    schema = ", ".join(f"`{b}` {kinds[b]}" for b in by) + f", v int, vt int, k int, kt int, value {kinds['value']}"
    r = f.repartition("key").sortWithinPartitions("key", "k", "v").mapInPandas(run, schema)
    day = lambda c, name: F.date_from_unix_date(c).alias(name)
    return r.select(*by, day("v", "valid_from"), day("vt", "valid_to"), day("k", "known_from"), day("kt", "known_to"), "value")


def as_known(rects: DataFrame, marks: DataFrame, by: list[str]) -> DataFrame:
    """The marks (by, valid_on, known_on, ...) joined with the rectangle of each that covers both days, if there is one.

    An equality join on the key and the years of both axes, so that an open rectangle meets
    the marks of each year by themselves; the days are compared inside.
    """
    top = marks.agg(F.max(F.year("valid_on")), F.max(F.year("known_on"))).first()
    years = lambda a, b, most: F.sequence(F.year(a), F.least(F.year(F.date_sub(F.coalesce(b, F.lit(FAR).cast("date")), 1)), F.lit(most or 0)))
    x = rects.where((F.year("valid_from") <= F.lit(top[0])) & (F.year("known_from") <= F.lit(top[1])))
    x = x.withColumn("vy", F.explode(years("valid_from", "valid_to", top[0]))).withColumn("ky", F.explode(years("known_from", "known_to", top[1])))
    m = marks.withColumns({"vy": F.year("valid_on"), "ky": F.year("known_on")})
    inside = lambda on, a, b: (m[on] >= x[a]) & (x[b].isNull() | (m[on] < x[b]))
    same = [m[c].eqNullSafe(x[c]) if c in by else m[c] == x[c] for c in [*by, "vy", "ky"]]
    got = m.join(x, [*same, inside("valid_on", "valid_from", "valid_to"), inside("known_on", "known_from", "known_to")])
    return got.select(*[m[c] for c in marks.columns], "valid_from", "known_from", "value")


def resolved(rects: DataFrame, marks: DataFrame, agency: str = "agency") -> DataFrame:
    """mark_id, rating, source of each mark: the worst (least) of the issue's ratings, else of the issuer's, as known on a day.

    ``rects`` has entity_type (issue or issuer), entity_id, ``agency`` and a number as value, null
    where a rating was withdrawn; ``marks`` has mark_id, issue, issuer, valid_on, known_on.
    A withdrawn rating is no rating, yet it is a state: a mark whose ratings are all
    withdrawn has the source and a null rating, one that nothing covers has neither.
    """
    ask = lambda kind: marks.select("mark_id", F.lit(kind).alias("entity_type"), F.col(kind).alias("entity_id"), "valid_on", "known_on")
    asked = ask("issue").unionByName(ask("issuer")).where("entity_id IS NOT NULL")
    got = as_known(rects, asked, ["entity_type", "entity_id"])
    one = got.groupBy("mark_id", "entity_type").agg(F.min("value").alias("rating"))
    best = one.groupBy("mark_id").agg(F.min_by(F.struct("rating", "entity_type"), F.struct(F.col("rating").isNull(), F.col("entity_type") != "issue")).alias("b"))
    return marks.join(best, "mark_id", "left").select(*[marks[c] for c in marks.columns], "b.rating", F.col("b.entity_type").alias("source"))
