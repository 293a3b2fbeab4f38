"""Operator 12: hard negatives by an inverted multi-index with certified stops.

Vectors become whole numbers (floor(256 x)). Two codebooks, one for each half of the
components and fitted on a bounded sample, cut all rows into cells (i, j); every row is in
the index. With the radius r of a half's cluster around its centre c, no row of it scores
more than q.c + |q| r with a query's half q. A query visits cells in descending order of the
two halves' summed bounds (the multi-sequence walk: one heap over sorted half bounds), and
stops at the first cell whose bound lies below what it has already found.

Each search takes two visits. The first covers at least ``SEED`` rows of the nearest cells
and gives a floor, the score of the last row found. The second covers every cell whose
bound reaches the floor (and, for windows, whose least possible score does not exceed the
greatest positive), so its result is exact, however little the bounds cut off. On vectors
without structure they cut off nearly nothing, and the second visit is a product of all
anchors and all rows, in blocks.

Cells are packed into shards of bounded size; a cell that outgrows one is dealt over several.
A shard's rows are held by one task while the anchors that visit it pass by. Rows of equal
label and vector are one class that keeps its least ids only, as no result reaches further,
so copies cost nothing.

Defined cases: rows with a null label, a null vector, or a null, NaN or infinite component
take no part; a shorter vector counts as filled up with zeros; components are held within
the greatest bound for which every score fits a long (2.6e8 after scaling for 64 of them);
rows with a null id can be positives and negatives, last among ties, but are no anchors; a
row that occurs several times takes part as often, and an anchor that does returns its
result as often; an anchor without another row of its label, or without a row in a window,
returns nothing there; an empty table gives an empty result; columns beyond those named are
ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import discard, hashed_sample, stash, table, whole_id

SCALE = 256
#: Positives of an anchor, and negatives of a positive.
POSITIVES, NEGATIVES = 5, 5
#: A negative's least share of its positive's score, in hundredths.
SHARE = 80
#: Clusters of a half, and rows from which they are fitted, at most.
CLUSTERS, SAMPLE, STEPS = 32, 4_096, 12
#: Rows that the first visit covers at least; shards at least, and rows of a shard at most, about; rows and anchors of one product.
SEED, SHARDS, SHARD, ROWS, ANCHORS = 2_000, 48, 200_000, 4_096, 256
#: Scores found in a shard that are held before they are cut down to the best.
HELD = 500_000

ROW = "shard int, kind int, cell int, label long, q binary, ids array<bigint>, id long, h long, cells binary, floors array<bigint>, tops array<bigint>"


def whole_vectors(rows: DataFrame, id_col: str, label_col: str, vector_col: str, anchor: Column) -> tuple[DataFrame, int]:
    """(id, label, anchor, q) of the rows that take part, and the number of components."""
    d = rows.select(whole_id(rows, id_col).alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    d = d.where(F.col("label").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    dim = d.select(F.max(F.size("v"))).first()[0] or 0
    most = min(2**31 - 1, int((2**62 // max(dim, 1)) ** 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, n = b.column("v"), b.num_rows
            long = np.diff(v.offsets.to_numpy())
            out = np.zeros((n, dim), "<i4")
            x = np.floor(v.flatten().to_numpy(zero_copy_only=False) * float(SCALE)).clip(-most, most)
            out[np.repeat(np.arange(n), long), np.arange(len(x)) - np.repeat(np.cumsum(long) - long, long)] = x
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("anchor"), pa.array([r.tobytes() for r in out], pa.binary())], ["id", "label", "anchor", "q"])

    return d.mapInArrow(run, "id long, label long, anchor boolean, q binary"), dim


def classes_of(vectors: DataFrame, keep: int) -> DataFrame:
    """(label, q, ids): the ``keep`` least ids (null last) of the rows of equal label and vector.

    Copies are cut down batch by batch where they are read and then in two levels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[tuple[int, bytes], list] = {}
            for i, label, q in zip(b.column("id").to_pylist(), b.column("label").to_pylist(), b.column("q").to_pylist()):
                held.setdefault((label, q), []).append(i)
            ids = [sorted(x, key=lambda i: (i is None, i))[:keep] for x in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.binary()), pa.array(ids, pa.list_(pa.int64()))], ["label", "q", "ids"])

    d = vectors.select("id", "label", "q").mapInArrow(run, "label long, q binary, ids array<bigint>")
    # an array's nulls sort first: ids stand in structs behind a mark
    least = lambda c: F.transform(F.slice(F.array_sort(F.transform(F.flatten(F.collect_list(c)), lambda i: F.struct(i.isNull().alias("no"), i.alias("i")))), 1, keep), lambda s: s["i"])
    d = d.groupBy("label", "q", F.spark_partition_id().alias("part")).agg(least("ids").alias("ids"))
    return d.groupBy("label", "q").agg(least("ids").alias("ids"))


def matrix(qs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(qs), "<i4").reshape(len(qs), dim)


def codebook(x: np.ndarray, k: int = CLUSTERS, steps: int = STEPS) -> np.ndarray:
    """Centres of Lloyd's iterations, started from the first distinct rows."""
    first = np.sort(np.unique(x, axis=0, return_index=True)[1])[:k] if x.size else np.arange(min(1, len(x)))
    c = x[first].astype(float)
    for _ in range(steps if len(c) else 0):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, at, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


class Directory:
    """What a visit must know of all cells: centres and radii of both halves, rows and shards of each cell. Bounded by ``CLUSTERS``."""

    def __init__(self, one: np.ndarray, two: np.ndarray):
        self.half = one.shape[1]
        self.centres = one, two
        self.radii = [np.zeros(len(one)), np.zeros(len(two))]
        self.rows = np.zeros(len(one) * len(two), np.int64)
        self.first = self.parts = self.rows
        self.shards = 1

    def cell(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell and distances to both centres of each row."""
        halves = x[:, : self.half], x[:, self.half :]
        i, j = (nearest(h, c) for h, c in zip(halves, self.centres))
        far = [np.linalg.norm(h - c[k], axis=1) for h, c, k in zip(halves, self.centres, (i, j))]
        return i * len(self.centres[1]) + j, *far

    def learn(self, found: list) -> None:
        """Take in (cell, rows, greatest distances) of all cells and deal the cells over shards."""
        k = len(self.centres[1])
        for r in found:
            self.rows[r.cell] = r.n
            for half, at, d in ((0, r.cell // k, r.d1), (1, r.cell % k, r.d2)):
                self.radii[half][at] = max(self.radii[half][at], d)
        total = int(self.rows.sum())
        size = max(1, -(-total // max(SHARDS, -(-total // SHARD))))
        self.first = (np.cumsum(self.rows) - self.rows) // size
        self.parts = np.maximum(1, -(-self.rows // size))
        self.shards = int((self.first + self.parts).max()) if len(self.rows) else 1

    def bounds(self, q: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each half's clusters, the greatest and the least score that a row of it can have with q."""
        top, low = [], []
        for h, c, r in zip((q[: self.half], q[self.half :]), self.centres, self.radii):
            norm = np.linalg.norm(h)
            slack = 1 + 1e-9 * norm * (np.linalg.norm(c, axis=1) + r)  # rounding
            top.append(c @ h + norm * r + slack)
            low.append(c @ h - norm * r - slack)
        return top, low

    def walk(self, top: list[np.ndarray]) -> Iterator[tuple[float, int]]:
        """(bound, cell) of all cells with rows, in descending order of the summed bounds."""
        order = [np.argsort(-t, kind="stable") for t in top]
        a, b = (t[o] for t, o in zip(top, order))
        heap = [(-(a[0] + b[0]), 0, 0)] if len(a) and len(b) else []
        k = len(b)
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < k:
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if not j and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
            cell = int(order[0][i]) * k + int(order[1][j])
            if self.rows[cell]:
                yield -bound, cell

    def visited(self, q: np.ndarray, again: bool, floor: float, top: float) -> list[int]:
        """The cells of a query's first visit, or those of its second one."""
        high, low = self.bounds(q)
        seen, out, k = 0, [], len(self.centres[1])
        for bound, cell in self.walk(high):
            first, seen = seen < SEED, seen + int(self.rows[cell])
            if bound < floor:
                break
            if first != again and low[0][cell // k] + low[1][cell % k] <= top:
                out.append(cell)
            if not again and seen >= SEED:
                break
        return out


def build_index(classes: DataFrame, dim: int) -> tuple[DataFrame, Directory]:
    """(cell, label, q, ids) of all classes, stashed, and the directory."""
    rows = hashed_sample(classes.select(F.lit(1).alias("one"), "q"), "one", SAMPLE).select("q").orderBy(F.xxhash64("q"), "q").collect()
    x = matrix([bytes(r.q) for r in rows], dim)
    directory = Directory(codebook(x[:, : dim // 2]), codebook(x[:, dim // 2 :]))
    shared = classes.sparkSession.sparkContext.broadcast(directory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(len, batches):
            cell, d1, d2 = shared.value.cell(matrix(b.column("q").to_pylist(), dim))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column("label"), b.column("q"), b.column("ids"), pa.array(d1), pa.array(d2)], ["cell", "label", "q", "ids", "d1", "d2"])

    index = stash(classes.select("label", "q", "ids").mapInArrow(run, "cell int, label long, q binary, ids array<bigint>, d1 double, d2 double"), "op12-index")
    directory.learn(index.groupBy("cell").agg(F.count("*").alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2")).collect())
    return index, directory


def probes(anchors: DataFrame, directory: Directory, dim: int, again: bool) -> DataFrame:
    """One row for each anchor and shard that it visits, with the cells there. ``floors`` and ``tops`` bound the wanted scores."""
    shared = anchors.sparkSession.sparkContext.broadcast(directory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shared.value
        for b in batches:
            row, shard, cells = [], [], []
            x, floors, tops = matrix(b.column("q").to_pylist(), dim).astype(float), b.column("floors").to_pylist(), b.column("tops").to_pylist()
            for n in range(b.num_rows):
                open_ = [(f, t) for f, t in zip(floors[n], tops[n]) if f <= t]
                if not open_:
                    continue
                at: dict[int, list[int]] = {}
                for c in d.visited(x[n], again, min(f for f, _ in open_), max(t for _, t in open_)):
                    for s in range(d.first[c], d.first[c] + d.parts[c]):
                        at.setdefault(int(s), []).append(c)
                row += [n] * len(at)
                shard += at.keys()
                cells += [np.array(c, "<i4").tobytes() for c in at.values()]
            own = b.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), own.column("label"), own.column("q"), own.column("id"), own.column("h"), pa.array(cells, pa.binary()), own.column("floors"), own.column("tops")], ["shard", "label", "q", "id", "h", "cells", "floors", "tops"])

    return anchors.select("id", "h", "label", "q", "floors", "tops").mapInArrow(run, "shard int, label long, q binary, id long, h long, cells binary, floors array<bigint>, tops array<bigint>")


class Shard:
    """A shard's rows, by cell."""

    def __init__(self, t: pa.Table, dim: int, exact: bool):
        self.x = matrix(t.column("q").to_pylist(), dim).astype(float if exact else np.int64)
        self.label, self.ids = t.column("label").to_numpy(), t.column("ids").to_pylist()
        self.least = np.array([np.iinfo(np.int64).max if i[0] is None else i[0] for i in self.ids], np.int64)
        cell = t.column("cell").to_numpy()
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        self.place = {int(cell[i]): (int(i), int(j)) for i, j in zip(first, np.append(first[1:], len(cell)))}

    def search(self, q: np.ndarray, label: np.ndarray, cells: list[np.ndarray], floors: np.ndarray, tops: np.ndarray, same: bool, keep: int):
        """(anchor, window, row, score) of the ``keep`` best classes of each anchor's windows, floors rising as they are found."""
        who, which = np.repeat(np.arange(len(cells)), [len(c) for c in cells]), np.concatenate(cells)
        order = np.argsort(which, kind="stable")
        who, which = who[order], which[order]
        cut = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
        best, held, windows, floors = [np.zeros((0, 3), np.int64)], 0, tops.shape[1], floors.copy()

        def reduce() -> np.ndarray:
            f = np.concatenate(best)
            f = f[np.lexsort((self.least[f[:, 1]], -f[:, 2], f[:, 0]))]
            start = np.flatnonzero(np.append(True, f[1:, 0] != f[:-1, 0])) if len(f) else np.zeros(0, int)
            rank = np.arange(len(f)) - np.repeat(start, np.diff(np.append(start, len(f))))
            last = f[rank == keep - 1]
            flat = floors.reshape(-1)
            flat[last[:, 0]] = np.maximum(flat[last[:, 0]], last[:, 2])
            return f[rank < keep]

        for i, j in zip(cut, np.append(cut[1:], len(which))):
            if int(which[i]) not in self.place:
                continue
            a, (start, end) = who[i:j], self.place[int(which[i])]
            for at in range(start, end, ROWS):
                to = min(end, at + ROWS)
                score = (q[a] @ self.x[at:to].T).astype(np.int64)
                fits = (self.label[at:to] == label[a, None]) == same
                for w in range(windows):
                    y, z = np.nonzero(fits & (score >= floors[a, w, None]) & (score <= tops[a, w, None]))
                    if len(y):
                        best.append(np.stack([a[y] * windows + w, z + at, score[y, z]], 1))
                        held += len(y)
                if held > HELD:
                    best, held = [reduce()], 0
        f = reduce()
        return f[:, 0] // windows, f[:, 0] % windows, f[:, 1], f[:, 2]


def visit(index: DataFrame, found: DataFrame, directory: Directory, dim: int, exact: bool, same: bool, keep: int) -> DataFrame:
    """(id, h, window, score, other): the best rows of each anchor's windows in each shard that it visits."""
    cells = index.sparkSession.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(directory.first, directory.parts)) if directory.rows[i]], "cell int, first int, parts int")
    null = lambda kind: F.lit(None).cast(kind)
    rows = index.join(F.broadcast(cells), "cell")  # at most CLUSTERS squared
    rows = rows.select((F.col("first") + F.pmod(F.xxhash64("label", "q"), F.col("parts"))).cast("int").alias("shard"), F.lit(0).alias("kind"), "cell", "label", "q", "ids", null("long").alias("id"), null("long").alias("h"), null("binary").alias("cells"), null("array<bigint>").alias("floors"), null("array<bigint>").alias("tops"))
    asked = found.select("shard", F.lit(1).alias("kind"), null("int").alias("cell"), "label", "q", null("array<bigint>").alias("ids"), "id", "h", "cells", "floors", "tops")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, now = [], None, None

        def answer(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at in range(0, b.num_rows, ANCHORS):
                p = b.slice(at, ANCHORS)
                q, ids = matrix(p.column("q").to_pylist(), dim), p.column("id").to_pylist()
                floors, tops = (np.array(p.column(c).to_pylist(), np.int64) for c in ("floors", "tops"))
                a, w, r, s = shard.search(q.astype(shard.x.dtype), p.column("label").to_numpy(), [np.frombuffer(c, "<i4") for c in p.column("cells").to_pylist()], floors, tops, same, keep + 1)
                take, window, score, other = [], [], [], []
                for i, k, row, sc in zip(a.tolist(), w.tolist(), r.tolist(), s.tolist()):
                    own = list(shard.ids[row])
                    if same and ids[i] in own and (shard.x[row] == q[i]).all():
                        own.remove(ids[i])  # the anchor itself, once
                    own = own[:keep]
                    take += [i] * len(own)
                    window += [k] * len(own)
                    score += [sc] * len(own)
                    other += own
                own = p.take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("h"), pa.array(window, pa.int32()), pa.array(score, pa.int64()), pa.array(other, pa.int64())], ["id", "h", "window", "score", "other"])

        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column("shard").to_numpy(), batch.column("kind").to_numpy()], 1)
            first = np.append(0, np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1)
            for i, j in zip(first.tolist(), np.append(first[1:], batch.num_rows).tolist()):
                part, (number, kind) = batch.slice(i, j - i), at[i].tolist()
                if kind == 0:
                    if now != number:
                        held, now = [], number
                    held.append(part.select(["cell", "label", "q", "ids"]))
                    shard = None
                elif now == number:
                    if shard is None:
                        shard, held = Shard(pa.Table.from_batches(held), dim, exact), []
                    yield from answer(part)

    together = rows.unionByName(asked).repartition(directory.shards, "shard").sortWithinPartitions("shard", "kind", "cell")
    return together.select(*[c.split()[0] for c in ROW.split(", ")]).mapInArrow(run, "id long, h long, window int, score long, other long")


def ranked(found: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best of each anchor's windows, with their rank."""
    order = W.partitionBy("id", "h", "window").orderBy(F.desc("score"), F.asc_nulls_last("other"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def search(index: DataFrame, anchors: DataFrame, directory: Directory, dim: int, exact: bool, same: bool, keep: int) -> DataFrame:
    """The ``keep`` best rows of each anchor's windows, exactly: (id, h, window, score, other, rank), stashed."""
    near = stash(ranked(visit(index, probes(anchors, directory, dim, False), directory, dim, exact, same, keep), keep), "op12-near")
    last = near.where(F.col("rank") == keep).groupBy("id", "h").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("last"))
    raised = F.transform("floors", lambda f, w: F.greatest(f, F.element_at("last", w)))
    again = anchors.join(last, ["id", "h"], "left").withColumn("floors", F.when(F.col("last").isNull(), F.col("floors")).otherwise(raised))
    rest = visit(index, probes(again, directory, dim, True), directory, dim, exact, same, keep)
    both = near.drop("rank").unionByName(rest)
    out = stash(ranked(both, keep), "op12-found")
    discard(near)
    return out


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, share: int = SHARE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows where ``anchor`` holds."""
    vectors, dim = whole_vectors(rows, id_col, label_col, vector_col, anchor)
    vectors = stash(vectors, "op12-vectors")
    index, directory = build_index(stash(classes_of(vectors, max(positives, negatives) + 1), "op12-classes"), dim)
    exact = dim * largest(vectors) ** 2 < 2**53  # then floating-point products are exact, and faster
    a = vectors.where("anchor AND id IS NOT NULL").groupBy("id", "label", "q").agg(F.count("*").alias("times")).withColumn("h", F.xxhash64("id", "label", "q"))
    anchors = stash(a, "op12-anchors")
    no, all_ = (F.lit(sign * (2**63 - 1)).cast("long") for sign in (-1, 1))
    found = search(index, anchors.withColumn("floors", F.array(no)).withColumn("tops", F.array(all_)), directory, dim, exact, True, positives)
    # windows 0 to positives - 1; one that no positive opens is shut (its floor lies above its top)
    each = found.groupBy("id", "h").agg(F.map_from_entries(F.collect_list(F.struct((F.col("rank") - 1).alias("w"), "score"))).alias("p"))
    at = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda w: F.element_at("p", w.cast("int")))
    wanted = anchors.join(each, ["id", "h"]).withColumn("at", at)
    wanted = wanted.withColumn("floors", F.transform("at", lambda s: F.when(s >= 0, least_share(s, share)).otherwise(F.lit(0)))).withColumn("tops", F.transform("at", lambda s: F.when(s >= 0, s).otherwise(F.lit(-1).cast("long"))))
    got = search(index, wanted, directory, dim, exact, False, negatives)
    pairs = found.select("id", "h", (F.col("rank") - 1).alias("window"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    got = got.select("id", "h", "window", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    out = pairs.join(got, ["id", "h", "window"]).join(anchors.select("id", "h", "times"), ["id", "h"])
    out = out.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return out.select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def largest(vectors: DataFrame) -> int:
    """The greatest absolute component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column("q").to_pylist()), "<i4").astype(np.int64)
            yield pa.RecordBatch.from_pydict({"m": [int(np.abs(x).max(initial=0))]})

    return vectors.select("q").mapInArrow(run, "m long").agg(F.max("m")).first()[0] or 0


def least_share(score: Column, share: int) -> Column:
    """The least whole number n with share * score <= 100 * n, for scores from 0 on; nothing leaves the range of a long."""
    return F.call_function("div", score, F.lit(100)) * share + F.call_function("div", score % 100 * share + 99, F.lit(100))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, row_number() OVER () AS n,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
s AS (
  SELECT a.n AS a, a.vec_id AS anchor_id, r.vec_id AS other, r.label = a.label AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
  FROM r AS a JOIN r ON a.n <> r.n WHERE a.vec_id % 100 = 0
),
p AS (
  SELECT a, anchor_id, other AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, other NULLS LAST) AS place FROM s WHERE same
  QUALIFY place <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.a, p.place ORDER BY s.score DESC, s.other NULLS LAST)
QUALIFY row_number() OVER w <= 5
"""
