"""Operator 11: alignment of two tokenizers' tokens over the same bytes.

Both tokenizers cut a text's bytes (a space and the text) into tokens. Their end offsets
are two ascending lists, and the alignment is a galloping intersection: the shorter list
drives, each search starts where the last one stopped, doubles its step until it has
passed the value and finishes by binary search. A common end closes a group of tokens; the
differences of the ranks found are the ranges of tokens that overlap.

A text is cut into units before each space that follows a non-space. There both tokenizers
always end a token (the byte-level one splits there first, and no piece of the other holds
a space behind another character, which is checked when it is loaded), so a text's
alignment is that of its units in a row, and a worker aligns equal units once.

One pass tokenizes and aligns, and writes each document's figures, its distinct id pairs
and how often it links each, as Parquet. From these come the corpus-wide counts, added up
partially in every task. The table of counts is bounded by the vocabularies, not by the
corpus: up to ``MOST_PAIRS`` rows it is sent to all executors, and a larger one is joined by
a salted shuffle instead, with equal results.

Defined cases: texts that are null or empty have no tokens (zeros, and '' for the groups);
neither have texts whose tokens of either kind don't join to the text's bytes, such as those
with U+2581; tokenizers' special strings are plain text; very long texts are aligned whole;
every row is a document, so repeated rows count as often as they occur; null ids stay; an
empty table gives an empty result; columns beyond those named are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import discard, stash, table

#: Ends that are searched for together; units, and links of units, that a worker remembers.
BLOCK, REMEMBER, LINKS = 1_024, 500_000, 5_000_000
#: Pairs that are sent to all executors at most, and parts that a pair is dealt over where they are joined.
MOST_PAIRS, SALT = 4_000_000, 16
#: Texts that are worked on together, and characters of a unit that the faster encoder takes at most.
TOGETHER, LONGEST = 200, 500
#: A unit, where no other white space stands before a space; and where one does.
UNIT, ODD = re.compile(r" *[^ ]+(?: +\Z)?| +"), re.compile(r"[^\S ] ")
CUT = re.compile(r"(?<=\S)(?= )")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
#: Fixed value: how byte-level vocabularies of this kind cut texts before their merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each value of the shorter ascending list, how many of the longer one's are less."""
    out, at, n = np.empty(len(short), np.int64), 0, len(long)
    for i in range(0, len(short), BLOCK):
        block, reach = short[i : i + BLOCK], 1
        while at + reach < n and long[at + reach] < block[-1]:
            reach *= 2
        out[i : i + BLOCK] = at + np.searchsorted(long[at : at + reach + 1], block)
        at = out[i + len(block) - 1]
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two lists of token ends that end alike: places of the common ends in a and in b, and the overlapping tokens (a, b)."""
    if len(a) > len(b):
        y, x, q, p = align(b, a)
        order = np.lexsort((q, p))
        return x, y, p[order], q[order]
    rank = gallop(a, b)
    same = b[rank] == a
    # a token overlaps those from where the one before it ended to the one that holds its last byte
    start = np.append(0, rank[:-1] + same[:-1]) if len(a) else rank
    many = rank - start + 1
    p = np.repeat(np.arange(len(a)), many)
    q = np.arange(len(p)) - np.repeat(np.cumsum(many) - many - start, many)
    return np.flatnonzero(same), rank[same], p, q


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers and, by id, the bytes of their tokens."""

    loaded: dict[tuple[str, str], Tokenizers] = {}

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_alphabet()
        self.bytes_a = [bytes(letters[c] for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of the second tokenizer holds a space behind another character, so texts can't be cut before spaces")
        self.long_a, self.long_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # an id and what follows it: another of its kind, the other kind, the next group, the next unit
        self.printed = [[f"{i}{end}" for i in range(max(len(self.bytes_a), len(self.bytes_b)))] for end in ",|;\n"]
        self.quick = self.ranked(json.loads(self.a.to_str()))

    def ranked(self, setup: dict):
        """The first tokenizer's vocabulary in an encoder that merges by rank; None where its merges don't come in the order of ids."""
        import tiktoken

        special = {t["id"] for t in setup["added_tokens"]}
        own = [i for i in range(len(self.bytes_a)) if i not in special]
        merges = [m if isinstance(m, list) else m.split(" ") for m in setup["model"].get("merges", [])]
        number = setup["model"]["vocab"]
        made = [number[x + y] for x, y in merges]
        way = setup["pre_tokenizer"] or {}
        plain = way.get("type") == "ByteLevel" and not way.get("add_prefix_space") and way.get("use_regex", True) and not setup["normalizer"]
        if not plain or made != sorted(made) or len(made) + 256 != len(own):
            return None
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={self.bytes_a[i]: i for i in own}, special_tokens={})

    @classmethod
    def at(cls, path_a: str, path_b: str) -> Tokenizers:
        if (path_a, path_b) not in cls.loaded:
            cls.loaded[path_a, path_b] = cls(path_a, path_b)
        return cls.loaded[path_a, path_b]

    def encode_a(self, units: list[str], data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units in a row, and how many each has. Short units that end with a non-space are encoded as one text."""
        plain = [bool(self.quick) and len(u) <= LONGEST and not u[-1].isspace() for u in units]
        joined = self.quick.encode_ordinary("".join([u for u, k in zip(units, plain) if k])) if any(plain) else []
        ids = np.array(joined, np.int64)
        at = np.append(0, np.searchsorted(np.cumsum(self.long_a[ids]), np.cumsum([len(x) for x, k in zip(data, plain) if k]), "right"))
        if all(plain):
            return ids, np.diff(at)
        other = iter([e.ids for e in self.a.encode_batch_fast([u for u, k in zip(units, plain) if not k], add_special_tokens=False)])
        runs = iter(zip(at, at[1:]))
        each = [ids[slice(*next(runs))] if k else np.array(next(other), np.int64) for k in plain]
        return np.concatenate(each), np.array([len(x) for x in each])

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of units that begin with a space (which the second tokenizer adds by itself): ids and counts of both kinds in a row,
        and which units' tokens join to their bytes; the others have none."""
        data = [u.encode("utf-8", "replace") for u in units]
        a, many_a = self.encode_a(units, data)
        each = self.b.encode([u[1:] for u in units], num_threads=1)
        b, many_b = np.array([i for x in each for i in x], np.int64), np.array([len(x) for x in each], np.int64)
        good, whole = np.ones(len(units), bool), b"".join(data)
        for ids, many, known in ((a, many_a, self.bytes_a), (b, many_b, self.bytes_b)):
            got = [known[i] for i in ids.tolist()]
            if b"".join(got) != whole or (np.append(0, np.cumsum([*map(len, got)]))[np.cumsum(many)] != np.cumsum([*map(len, data)])).any():
                ends = np.cumsum(many)
                good &= [b"".join(got[e - n : e]) == x for x, e, n in zip(data, ends, many)]
        return a[np.repeat(good, many_a)], many_a * good, b[np.repeat(good, many_b)], many_b * good, good


def cut(text: str) -> list[str]:
    """The units of a text that begins with a space."""
    return CUT.split(text) if ODD.search(text) else UNIT.findall(text)


class Units:
    """Alignments of the units that a worker has met: counts, printed groups, and links as numbers of pairs."""

    loaded: dict[tuple[str, str], Units] = {}

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.clear()

    @classmethod
    def at(cls, path_a: str, path_b: str) -> Units:
        if (path_a, path_b) not in cls.loaded:
            cls.loaded[path_a, path_b] = cls(Tokenizers.at(path_a, path_b))
        return cls.loaded[path_a, path_b]

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.counts, self.good = np.zeros((0, len(COUNTS)), np.int32), np.zeros(0, bool)
        self.groups: list[str] = []
        self.first, self.links = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.pairs: dict[int, int] = {}
        self.keys = np.zeros(0, np.int64)

    def meet(self, units: list[str]) -> None:
        """Align units that are not known yet, all in a row."""
        t = self.tokenizers
        a, many_a, b, many_b, good = t.encode(units)
        end_a, end_b = np.cumsum(many_a), np.cumsum(many_b)
        last_a, last_b, p, q = align(np.cumsum(t.long_a[a]), np.cumsum(t.long_b[b]))
        # every unit's last tokens are common ends: what lies before them is counted by binary search
        ends = np.stack([end_a, end_b, np.searchsorted(last_a, end_a), np.searchsorted(p, end_a)], 1)
        keys, place = np.unique((a[p] << 32) | b[q], return_inverse=True)
        new = [k for k in keys.tolist() if k not in self.pairs]
        self.pairs.update(zip(new, range(len(self.pairs), len(self.pairs) + len(new))))
        number = np.array([self.pairs[k] for k in keys.tolist()], np.int32)
        printed = iter(self.printed(a, b, last_a, last_b, end_a[good]).split("\n"))
        self.keys = np.append(self.keys, np.array(new, np.int64))
        self.links = np.append(self.links, number[place.reshape(-1)])
        self.first = np.append(self.first, self.first[-1] + ends[:, 3])
        self.counts, self.good = np.concatenate([self.counts, np.diff(ends, axis=0, prepend=0).astype(np.int32)]), np.append(self.good, good)
        self.groups += [next(printed) if g else "" for g in good]
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units))))

    def printed(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, ends: np.ndarray) -> str:
        """All groups, a line for each unit: where a token stands among both kinds follows from the groups' ends."""
        group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
        ids, after = np.empty(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
        before_b = np.append(0, last_b + 1)
        at_a, at_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + last_a[group_b] + 1
        ids[at_a], ids[at_b] = a, b
        after[at_a[last_a]] = 1
        after[at_b[last_b]] = 2
        after[at_b[last_b[np.searchsorted(last_a, ends - 1)]]] = 3
        table = self.tokenizers.printed
        return "".join([table[k][i] for k, i in zip(after.tolist(), ids.tolist())])

    def numbers(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Each text's units by number; None for texts without tokens. Numbers hold until the next call."""
        if len(self.known) > REMEMBER or len(self.links) > LINKS:
            self.clear()
        texts = [" " + t if t else None for t in texts]
        units = [cut(t) if t else [] for t in texts]
        new = set().union(*units).difference(self.known)
        if new:
            self.meet(sorted(new))
        out = []
        for t, x in zip(texts, units):
            n = np.array([*map(self.known.__getitem__, x)], np.int64) if x else None
            if n is not None and not self.good[n].all():
                # units that don't join to their bytes: the text as a whole may still do
                if t not in self.known:
                    self.meet([t])
                n = np.array([self.known[t]])
                n = n if self.good[n].all() else None
            out.append(n)
        return out

    def links_of(self, n: np.ndarray) -> np.ndarray:
        """Pair numbers of the links of the given units."""
        start, many = self.first[n], self.first[n + 1] - self.first[n]
        return self.links[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - start, many)]


def aligned(docs: DataFrame, tokenizers: tuple[str, str], id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """doc_id, counts, groups_sha256, distinct id pairs (a * 2^32 + b) with their links, and the printed groups if asked for, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units.at(*tokenizers)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                counts, text, pairs, links = np.zeros((batch.num_rows, len(COUNTS)), np.int64), [], [], []
                for i, n in enumerate(units.numbers(batch.column("text").to_pylist())):
                    text.append("" if n is None else ";".join(map(units.groups.__getitem__, n.tolist())))
                    p, many = np.unique(units.links_of(n), return_counts=True) if n is not None else (units.links[:0], units.first[:0])
                    counts[i] = 0 if n is None else units.counts[n].sum(0)
                    pairs.append(units.keys[p])
                    links.append(many)
                ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
                columns = {
                    "doc_id": batch.column("doc_id"), **{c: counts[:, k] for k, c in enumerate(COUNTS)}, "groups_sha256": [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in text],
                    "pairs": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(pairs))), "links": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(links), pa.int32())),
                }
                yield pa.RecordBatch.from_pydict(columns | ({"groups": text} if groups else {}))

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {dict(d.dtypes)['doc_id']}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, pairs array<bigint>, links array<int>"
    return d.mapInArrow(run, schema + (", groups string" if groups else ""))


def pair_table(rows: DataFrame) -> DataFrame:
    """(pair, n, best): in how many rows a pair occurs; best where that is the most of its first id's pairs."""
    n = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    by_a = W.partitionBy(F.shiftright("pair", 32))  # at most one row for each id of the second vocabulary
    return n.select("pair", "n", (F.col("n") == F.max("n").over(by_a)).alias("best"))


def summed(rows: DataFrame, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """The rows with n_best and count_sum in place of pairs and links; the table has sorted pairs, counts and marks of the best."""
    shared = rows.sparkSession.sparkContext.broadcast(table)
    schema = ", ".join(f"{c} {k}" for c, k in rows.drop("pairs", "links").dtypes) + ", n_best long, count_sum long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for b in batches:
            lists, links = b.column("pairs"), b.column("links").flatten().to_numpy()
            at = np.searchsorted(pair, lists.flatten().to_numpy())
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            both = (np.append(0, np.cumsum(links * x[at]))[ends] for x in (best, n))
            plain = b.drop_columns(["pairs", "links"])
            yield pa.RecordBatch.from_arrays([*plain.columns, *(pa.array(np.diff(x), pa.int64()) for x in both)], [*plain.schema.names, "n_best", "count_sum"])

    return rows.mapInArrow(run, schema)


def joined(rows: DataFrame, table: DataFrame) -> DataFrame:
    """What ``summed`` gives, for a table of any size: a shuffled join, its pairs dealt over ``SALT`` parts. Equal groups have equal links, so sums are made once for each distinct digest."""
    own = rows.where("n_links > 0").groupBy("groups_sha256").agg(F.first(F.arrays_zip("pairs", "links")).alias("z"))
    own = own.select("groups_sha256", F.explode("z").alias("z"), F.pmod(F.hash("groups_sha256"), F.lit(SALT)).alias("salt")).select("groups_sha256", "salt", F.col("z.pairs").alias("pair"), F.col("z.links").alias("k"))
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    sums = own.join(salted, ["pair", "salt"]).groupBy("groups_sha256").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
    out = rows.drop("pairs", "links").join(sums, "groups_sha256", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def align_tokens(docs: DataFrame, tokenizers: tuple[str, str], id_col: str = "doc_id", text_col: str = "text", groups: bool = False, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document, and its printed groups if asked for."""
    rows = stash(aligned(docs, tokenizers, id_col, text_col, groups), "op11-rows")
    table = stash(pair_table(rows), "op11-pairs")
    if table.count() > most_pairs:
        out = joined(rows, table)
    else:
        t = table.toPandas().sort_values("pair")
        discard(table)
        out = summed(rows, (t["pair"].to_numpy(), t["n"].to_numpy(), t["best"].to_numpy()))
    return out.select("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256", *(["groups"] if groups else []))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokens(table(spark, sf_dir, "documents"), tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))))
