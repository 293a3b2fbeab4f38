"""Operator 2: near-duplicate groups by a MinHash LSH forest.

Every text's set of five-word shingles gets a MinHash signature of ``TREES`` groups of
``DEPTH`` values. Equal sets are one class. The classes' signatures are sorted in
``TREES`` orders, one for each group; in each order, rows with a common prefix are
neighbours. How long a prefix must be depends on the region: the shortest with which at
most ``REGION`` rows agree makes all pairs of these rows candidates, and adjacent rows
that agree in the first value are candidates everywhere.

Crowds are larger regions that agree in ``CROWD`` values. Once these links are known,
rows of crowds that are not all in one component are joined on their rarest shingles, of
which two linked sets must share one: a quarter of the larger set's, a seventh of the
smaller one's, by counts in ``BUCKETS`` buckets over the crowds. What the sizes and the
places of a shared shingle leave possible is confirmed on full sets, so nothing is lost.
Words that a whole crowd shares are not among a set's rarest unless most of the set is
such, so texts with a common passage do not meet. Groups of one shingle with up to ``FEW``
rows make pairs of ids; larger ones, whose rows are mostly linked already, are cut into
blocks in which rows outside the group's largest component are compared with the others,
in one pass that only links leave. Only there can work grow with the square of the rows,
if they hardly differ and yet stay apart.

The other candidates whose signatures (one byte a value) are too unlike are dropped, with
a margin of four standard deviations. The rest are confirmed on full sets, in two rounds:
each class's most alike candidate, then those pairs that still lie in different components.
Components are found by star contraction.

Orders are range-partitioned; regions at a cut between two partitions count as crowds.
Two texts that agree in ``CROWD`` values of any order are thus compared or linked by
others, which a pair of likeness 0.75 misses with a chance of 2 in a million.

Defined cases: null texts and texts without words are linked with nothing; very long
texts are shingled whole; rows of one id count as one document, whose links are those of
any of its texts, and of a kept id's repeated rows the pipeline keeps one (the least text
hash decides); rows with a null id are represented by the least id of their component, if
there is one, and else are kept, and all stay in the pipeline; of equally alike candidates the least id comes first; ids
must be whole numbers; an empty table gives an empty result; columns beyond those named
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import SHINGLE_WORDS, discard, in_parts, stash, table, whole_id
from tallyforge.llm.components import components, joined

TREES, DEPTH = 16, 8
VALUES = TREES * DEPTH
#: Rows of a region that are all compared; percent of the union that two sets must share; least estimate.
REGION, SHARED, ESTIMATE = 8, 75, 0.6
#: Values that a crowd agrees in, buckets of its shingles' counts, rows of a group that makes pairs, and rows on each side of a task for larger groups.
CROWD, BUCKETS, FEW, BLOCK = 2, 1 << 20, 32, 500
#: Sorted rows that a worker holds, at most.
HELD = 200_000
#: Pairs that a task confirms, or texts that it reads, about.
PAIRS = 2_000
_r = np.random.default_rng(42)
FACTORS = _r.integers(0, 1 << 32, VALUES, np.uint64).astype(np.uint32) | np.uint32(1)
MASKS = _r.integers(0, 1 << 32, VALUES, np.uint64).astype(np.uint32)


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    # nothing is remembered between texts: rare words would fill every worker of an executor
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(ws)}
    h = np.fromiter((known[w] for w in ws), np.uint64, len(ws))
    n = min(SHINGLE_WORDS, len(h))
    s = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        s = (s ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(29)
    return np.unique(s * np.uint64(0xBF58476D1CE4E5B9 + 2 * n))


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values; a long set is taken in pieces, so that memory stays bounded."""
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        y = (x[at : at + 2048, None] ^ MASKS[None]) * FACTORS[None]
        y ^= y >> np.uint32(15)
        np.minimum(out, (y * np.uint32(0x2C1B3C6D)).min(0), out=out)
    return out


def sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, set key (null for an empty set) and signature (big-endian values) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key, sig = [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py())
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s).astype(">u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], ["id", "n", "key", "sig"])

    d = docs.select(whole_id(docs, id_col).alias("id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, "id long, n long, key binary, sig binary")


def neighbours(tree: np.ndarray, keys: np.ndarray, node: np.ndarray, lead: int = 0, stop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (smaller, larger node) of sorted rows, whose later row is one of [lead, stop)."""
    n = len(node)
    stop = n if stop is None else stop
    if n < 2:
        return node[:0], node[:0]
    same = np.cumprod(keys[1:] == keys[:-1], axis=1).sum(1)
    agree = np.append(0, np.where(tree[1:] == tree[:-1], same, 0))  # with the row before
    i = np.flatnonzero(agree >= 1)
    i = i[(i >= lead) & (i < stop)]
    a, b = [i - 1], [i]
    start, done = np.arange(n), np.zeros(n, bool)
    for depth in range(1, DEPTH + 1):
        first = np.flatnonzero(agree < depth)
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        small = (np.diff(np.append(first, n)) <= REGION)[run] & ~done
        start[small] = first[run][small]
        done |= small
    for apart in range(2, REGION):
        i = np.arange(max(apart, lead), stop)
        i = i[done[i] & (i - apart >= start[i])]
        a.append(i - apart)
        b.append(i)
    x, y = node[np.concatenate(a)], node[np.concatenate(b)]
    return np.minimum(x, y), np.maximum(x, y)


def crowd_keys(tree: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A number for each row's region of ``CROWD`` values."""
    key = tree.astype(np.uint64)
    for c in range(CROWD):
        key = (key ^ keys[:, c]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def crowded(key: np.ndarray) -> np.ndarray:
    """Which of the sorted rows are in a region of more than ``REGION`` rows."""
    first = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
    size = np.diff(np.append(first, len(key)))
    return np.repeat(size > REGION, size)


def candidates(classes: DataFrame) -> DataFrame:
    """Candidate pairs (a < b) of class nodes, from all sorted orders; with a null b, that node a is of a crowd."""

    def pairs_of(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        pairs = np.unique(np.stack([x, y], 1)[x != y], axis=0)
        for at in range(0, len(pairs), 100_000):
            p = pairs[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.nulls(len(p), pa.int64())], ["a", "b", "crowd"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are held in pieces; a piece begins and ends with ``REGION`` rows of its neighbours, which tell small runs from large ones."""
        held, rows, lead, edge = [], 0, 0, None
        for batch in chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                keys = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), ">u4").reshape(-1, DEPTH)
                held.append((batch.column("tree").to_numpy(), keys, batch.column("node").to_numpy()))
                rows += batch.num_rows
                if rows < HELD:
                    continue
            if not held:
                return
            tree, keys, node = (np.concatenate(x) for x in zip(*held))
            stop = len(node) if batch is None else len(node) - REGION
            yield from pairs_of(*neighbours(tree, keys, node, lead, stop))
            key = crowd_keys(tree, keys)
            edge = key[0] if edge is None else edge
            wide = crowded(key) | (key == edge)  # a region at a cut may go on in another partition
            if batch is None:
                wide |= key == key[-1]
            i = np.flatnonzero(wide[lead:stop]) + lead
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.nulls(len(i), pa.int64()), pa.array(key[i])], ["a", "b", "crowd"])
            keep = max(0, stop - REGION)
            held, lead = [(tree[keep:], keys[keep:], node[keep:])], stop - keep
            rows = len(node) - keep

    rows = classes.select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = rows.select("tree", F.substring("sig", F.col("tree") * 4 * DEPTH + 1, F.lit(4 * DEPTH)).alias("prefix"), "node")
    order = ["tree", "prefix", "node"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long, crowd long")


def lows(classes: DataFrame) -> DataFrame:
    """node, last byte of each of its signature's values."""
    return classes.select("node", F.expr("unhex(regexp_replace(hex(sig), '.{6}(..)', '$1'))").alias("low"))


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated from signatures' last bytes."""
    return ((x == y).mean(1) - 1 / 256) / (1 - 1 / 256)


def likely(pairs: DataFrame, classes: DataFrame, least: float = ESTIMATE) -> DataFrame:
    """Pairs whose signatures' last bytes agree often enough, with the estimated likeness."""
    low = lows(classes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(-1, VALUES) for c in ("la", "lb"))
                pdf = pdf[["a", "b"]].assign(e=likeness(x, y))
                yield pdf[pdf["e"] >= least]

    x = pairs.join(low.withColumnsRenamed({"node": "a", "low": "la"}), "a").join(low.withColumnsRenamed({"node": "b", "low": "lb"}), "b")
    return x.select("a", "b", "la", "lb").mapInPandas(run, "a long, b long, e double")


def block_links(texts: list[str], node: np.ndarray, root: np.ndarray, lone: np.ndarray, shared: int = SHARED) -> list[tuple[int, int]]:
    """Linked pairs of lone rows and others with different roots, by full sets; one for each lone row and root."""
    sets = [shingle_set(t) for t in texts]
    long = np.array([len(x) for x in sets])
    place = np.unique(np.concatenate(sets), return_inverse=True)[1]
    end = np.cumsum(long)
    to = np.flatnonzero(~lone & (long > 0))
    out: list[tuple[int, int]] = []
    if not len(to):
        return out
    line = np.concatenate([place[end[j] - long[j] : end[j]] for j in to])
    starts = np.cumsum(long[to]) - long[to]
    mark = np.zeros(place.max() + 1, np.int32)
    for i in np.flatnonzero(lone & (long > 0)):
        own = place[end[i] - long[i] : end[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[line], starts)
        mark[own] = 0
        j = to[(100 * both >= shared * (long[i] + long[to] - both)) & (root[to] != root[i])]
        out += [(int(min(node[i], node[k])), int(max(node[i], node[k]))) for k in j[np.unique(root[j], return_index=True)[1]]]
    return out


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """How many shingles of all texts fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b.column(0):
                np.add.at(n, (shingle_set(t.as_py()) % np.uint64(BUCKETS)).astype(np.int64), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["bucket", "n"])

    got = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.uint32)
    out[got.column("bucket").to_numpy()] = np.minimum(got.column("n").to_numpy(), 0xFFFFFFFF)
    return out


def rarest(s: np.ndarray, counts: np.ndarray, shared: int = SHARED) -> tuple[np.ndarray, np.ndarray]:
    """The rarest shingles of a set, of which every set linked with it holds one, and their places; those counted once are left out."""
    often = counts[(s % np.uint64(BUCKETS)).astype(np.int64)]
    first = np.lexsort((s, often))[: len(s) * (100 - shared) // 100 + 1]
    place = np.flatnonzero(often[first] > 1)
    return s[first[place]], place


def rare_keys(texts: DataFrame, shared: int = SHARED) -> DataFrame:
    """(h, node, root, n, place) for the rarest shingles of each text."""
    counts = texts.sparkSession.sparkContext.broadcast(shingle_counts(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, root, t in zip(*(b.column(c).to_pylist() for c in ("node", "root", "text"))):
                s = shingle_set(t)
                h, place = rarest(s, counts.value, shared)
                same = lambda x, n=len(h): pa.array(np.full(n, x, np.int64))
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), same(node), same(root), same(len(s)), pa.array(place, pa.int64())], ["h", "node", "root", "n", "place"])

    return texts.select("node", "root", "text").mapInArrow(run, "h long, node long, root long, n long, place long")


def rare_groups(keys: DataFrame, shared: int = SHARED) -> DataFrame:
    """The keys of rows that may be linked with a row of another component through the shingle; with ``reach``, the largest partner's size, and the group's rows ``many``.

    A set with n shingles, linked with one of m and sharing nothing before place i of its
    own order, has (100 + shared) * (n - i) >= shared * (n + m); and if n <= m, it
    shares one of its first (100 - shared) / (100 + shared) * n + 1.
    """
    reach = F.floor((100 + shared) * (F.col("n") - F.col("place")) / shared - F.col("n") + 1e-6)
    keys = keys.withColumn("reach", reach)
    small = F.col("reach") >= F.col("n")
    g = keys.groupBy("h").agg(F.count("*").alias("many"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.max(F.when(small, F.col("reach"))).alias("most"), F.min(F.when(small, F.col("n"))).alias("least"))
    g = g.where("r0 <> r1 AND most IS NOT NULL").select("h", "many", "most", "least")
    return keys.join(g, "h").where("n BETWEEN least AND most").select("h", "node", "root", "n", "reach", "many")


def rare_pairs(groups: DataFrame, shared: int = SHARED) -> DataFrame:
    """Pairs (a, b) of small groups whose sizes and places leave a link possible."""
    few = groups.where(F.col("many") <= FEW).select("h", "node", "root", "n", "reach")
    x, y = few.where("reach >= n"), few.toDF("h", "node2", "root2", "n2", "reach2")
    fits = (F.col("root") != F.col("root2")) & (F.col("n") <= F.col("n2")) & (F.col("n2") <= F.col("reach")) & (F.col("n") <= F.col("reach2")) & (100 * F.col("n") >= shared * F.col("n2"))
    return x.join(y, "h").where(fits).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def crowd_links(crowds: DataFrame, docs: DataFrame, id_col: str, text_col: str, roots: DataFrame) -> DataFrame:
    """Links (a, b) between rows of crowds that are in different components."""
    rows = crowds.join(roots, "node", "left").select("crowd", "node", F.coalesce("root", "node").alias("root"))
    mixed = rows.groupBy("crowd").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("crowd")
    rows = stash(rows.join(mixed, "crowd").select("node", "root").distinct(), "op2-crowds", crowds.count())
    texts = docs.select(whole_id(docs, id_col).alias("node"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    texts = stash(in_parts(texts.join(rows, "node").distinct(), rows.count(), PAIRS), "op2-texts")
    keys = stash(rare_keys(texts), "op2-keys")
    groups = stash(rare_groups(keys), "op2-groups", keys.count())
    many = groups.count()
    pairs = stash(rare_pairs(groups), "op2-pairs", many)
    links = confirmed(pairs, docs, id_col, text_col)
    large = groups.where(F.col("many") > FEW)
    # groups of the same rows are one
    same = large.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum")).groupBy("n", "sum").agg(F.min("h").alias("h"))
    large = stash(large.join(same.select("h"), "h", "left_semi").select(F.col("h").alias("crowd"), "node", "root").distinct(), "op2-large", many)
    if not large.isEmpty():
        links = links.unionByName(large_links(large, texts.select("node", "text")))
    return links.distinct()


def large_links(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between the rows of large groups outside the group's largest component and those of other components, block by block."""
    parts = rows.groupBy("crowd", "root").agg(F.count("*").alias("n")).groupBy("crowd").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main"))
    alone = F.col("n") - F.col("main.n")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    parts = parts.where(alone > 0).select("crowd", blocks(F.col("n")).alias("blocks"), blocks(alone).alias("lone_blocks"), F.col("main.root").alias("main"))
    rows = rows.join(parts, "crowd")
    dealt = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    to = rows.select("crowd", dealt("blocks", 1).alias("x"), every("lone_blocks").alias("y"), "node", "root", F.lit(False).alias("lone"))
    lone = rows.where("root <> main").select("crowd", every("blocks").alias("x"), dealt("lone_blocks", 2).alias("y"), "node", "root", F.lit(True).alias("lone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell = [], None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held)
                got = block_links(t.column("text").to_pylist(), *(t.column(c).to_numpy() for c in ("node", "root", "lone")))
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy() for c in ("crowd", "x", "y")], axis=1)
            first = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist()]
            for i, j in zip(first, [*first[1:], batch.num_rows]):
                if cell != tuple(at[i]):
                    yield from flush()
                    cell = tuple(at[i])
                held.append(batch.slice(i, j - i))
        yield from flush()

    cells = to.unionByName(lone).join(texts, "node").repartition("crowd", "x", "y").sortWithinPartitions("crowd", "x", "y")
    return cells.select("crowd", "x", "y", "node", "root", "lone", "text").mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, shared: int = SHARED) -> DataFrame:
    """The pairs that share enough of their full sets."""
    many = pairs.count()
    wanted = stash(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "op2-wanted", 2 * many)
    texts = docs.select(whole_id(docs, id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi")
    texts = texts.groupBy("id").agg(F.collect_set("text").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, sets = [], None, []
            for i in range(batch.num_rows):
                b = batch.column("b")[i].as_py()
                if b != last:
                    last, sets = b, [shingle_set(t) for t in batch.column("tb")[i].as_py()]
                keep.append(any(linked(shingle_set(t), s, shared) for t in batch.column("ta")[i].as_py() for s in sets))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = pairs.select("a", "b").join(texts.withColumnsRenamed({"id": "a", "texts": "ta"}), "a").join(texts.withColumnsRenamed({"id": "b", "texts": "tb"}), "b")
    return in_parts(x.select("a", "b", "ta", "tb"), many, PAIRS).mapInArrow(run, "a long, b long")


def linked(x: np.ndarray, y: np.ndarray, shared: int = SHARED) -> bool:
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < shared * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= shared * (len(x) + len(y) - both)


def joined_crowds(found: DataFrame, docs: DataFrame, id_col: str, text_col: str, roots: DataFrame) -> DataFrame:
    """The roots after the crowds' links between different components are known too."""
    crowds = found.where("b IS NULL").select("crowd", F.col("a").alias("node")).distinct()
    wide = crowds.groupBy("crowd").count().where("count > 1").select("crowd")
    crowds = stash(crowds.join(wide, "crowd"), "op2-crowds", found.count())
    links = stash(crowd_links(crowds, docs, id_col, text_col, roots), "op2-links")
    if not links.isEmpty():
        roots = stash(joined(roots, links), "op2-roots", roots.count() + 2 * links.count())
    discard(crowds, links)
    return roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    signed = stash(sign(docs, id_col, text_col), "op2-signed")
    classes = signed.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("node"), F.first("sig").alias("sig"))
    rows = signed.count()
    classes = stash(classes, "op2-classes", rows)
    known = classes.where(F.col("node").isNotNull())
    found = stash(candidates(known), "op2-candidates", TREES * rows)
    pairs = stash(likely(found.where("b IS NOT NULL").select("a", "b").distinct(), known), "op2-pairs", found.count())

    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "e"))
    best = both.groupBy("a").agg(F.max_by("b", F.struct("e", -F.col("b"))).alias("b"))
    best = stash(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "op2-best", rows)
    links = stash(confirmed(best, docs, id_col, text_col), "op2-links")
    # an id with several texts ties their classes
    ties = signed.where(F.col("key").isNotNull()).select("id", "key").join(classes.select("key", "node"), "key").where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b")).distinct()
    ties = ties.join(known.select(F.col("node").alias("a")).distinct(), "a", "left_semi")
    roots = components(stash(links.unionByName(ties), "op2-links", rows))

    rest = pairs.join(best, ["a", "b"], "left_anti")
    rest = rest.join(roots.withColumnsRenamed({"node": "a", "root": "ra"}), "a", "left").join(roots.withColumnsRenamed({"node": "b", "root": "rb"}), "b", "left")
    rest = stash(rest.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"), "op2-rest", pairs.count())
    more = stash(confirmed(rest, docs, id_col, text_col), "op2-links")
    if not more.isEmpty():
        roots = stash(joined(roots, more), "op2-roots", rows)
    discard(pairs, more)
    roots = joined_crowds(found, docs, id_col, text_col, roots)

    # a class by the least id of its component
    c = classes.select("key", "node").join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("component"))
    c = stash(c, "op2-components", rows)
    discard(classes, found, best, rest)
    out = signed.select("id", "n", "key").join(c, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with their own columns, that are the least of their group, each once; documents without words stay."""
    groups = near_duplicates(docs, id_col, text_col).select("doc_id", "kept")
    ids = groups.groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n"))
    ids = stash(ids.where(F.col("doc_id").isNotNull() & (~F.col("kept") | (F.col("n") > 1))).select(F.col("doc_id").alias("_id"), F.col("kept").alias("_kept")), "op2-gone")
    once = docs.join(ids, docs[id_col].cast("long") == ids["_id"], "left_anti")
    # the few kept ids that occur more than once
    again = docs.join(ids.where("_kept"), docs[id_col].cast("long") == ids["_id"], "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = again.select(F.col(f"`{id_col}`").alias("id"), F.struct(F.xxhash64(f"`{text_col}`").alias("h"), F.to_json(row).alias("j")).alias("order"), row.alias("row"))
    return once.unionByName(again.groupBy("id").agg(F.min_by("row", "order").alias("row")).select("row.*"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
