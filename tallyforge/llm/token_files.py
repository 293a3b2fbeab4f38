"""Operator 3: token ids in bit- or byte-plane files.

Documents are range-partitioned and sorted by id, encoded, and packed into chunks of
whole documents. A chunk's ids are cut into fixed-size blocks; each block is transposed
into byte planes (or bit planes) and every plane is compressed with zstandard. One
Parquet row holds one chunk: its place (part, chunk), its index (doc ids and token
counts) and its blocks, so that a reader can decode any chunk alone and Spark's own
commit protocol guards the files.

Encoding: a text is cut before white space that follows a non-space and after Latin
letters, where this byte-level pre-tokenizer always cuts too, and equal pieces are
encoded once per worker.
Texts with white space other than space and newline are encoded as a whole.

Defined cases: null text is empty and yields the end id alone; very long texts are
encoded whole and may exceed a chunk's usual size; rows of one id are ordered by text
hash, equal rows stay as often as they occur; null ids come first; ids must be whole
numbers; an empty table gives empty files; columns beyond those named are ignored,
whatever their names.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import fresh_path, table, whole_id

END = 2
BLOCK = 1 << 14
CHUNK = 1 << 17
#: Pieces whose ids a worker remembers, at most.
REMEMBER = 1_000_000
#: Latin letters that no other letter or numeral follows, with the space before; else up to the next space.
PIECE = re.compile(r"[ \n]*[a-zA-ZÀ-ÖØ-öø-ɏ]+(?![^\W\d_])|[ \n]*[^ \n]+|[ \n]+$")
ODD_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85᠎​﻿]")

CHUNKS = "part int, chunk int, doc_ids array<bigint>, n_tokens array<bigint>, n_ids bigint, blocks array<struct<n:int,planes:array<binary>>>"
ARROW = pa.schema([
    ("part", pa.int32()), ("chunk", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("n_ids", pa.int64()),
    ("blocks", pa.list_(pa.struct([("n", pa.int32()), ("planes", pa.list_(pa.binary()))]))),
])


class OddSpace(Exception):
    """A piece with white space that may reach over the piece's bounds."""


class Pieces(dict):
    """Ids of pieces as little-endian unsigned 32-bit integers; a piece is encoded when it is first asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, piece: str) -> bytes:
        if ODD_SPACE.search(piece):
            raise OddSpace(piece)
        ids = array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        self[piece] = got = ids.tobytes()
        return got


class Encoder:
    """A tokenizer and the pieces that it met before."""

    loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Pieces(self.tokenizer)

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if len(self.known) > REMEMBER:
            self.known.clear()
        try:
            return b"".join(map(self.known.__getitem__, PIECE.findall(text)))
        except OddSpace:
            return self.whole(text)


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    planes = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if not bits:
        return [planes[:, i].tobytes() for i in range(4)]
    return [np.packbits((ids >> np.uint32(i)).astype(np.uint8) & 1).tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4").copy()
    ids = np.zeros(n, "<u4")
    for i, p in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype("<u4") << np.uint32(i)
    return ids


def packed(data: bytes, bits: bool) -> list[dict]:
    ids, z = np.frombuffer(data, "<u4"), zstandard.ZstdCompressor(level=3)
    cut = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    return [{"n": len(x), "planes": [z.compress(p) for p in to_planes(x, bits)]} for x in cut]


def unpacked(blocks: list[dict]) -> bytes:
    z = zstandard.ZstdDecompressor()
    return b"".join(from_planes([z.decompress(p) for p in b["planes"]], b["n"]).tobytes() for b in blocks)


def chunk_writer(path: str, end: int, bits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, tail = Encoder.at(path), TaskContext.get().partitionId(), np.array([end], "<u4").tobytes()
        ids, data, held, chunk = [], [], 0, 0

        def out() -> pa.RecordBatch:
            row = {"part": part, "chunk": chunk, "doc_ids": ids, "n_tokens": [len(x) // 4 for x in data], "n_ids": held, "blocks": packed(b"".join(data), bits)}
            return pa.RecordBatch.from_pylist([row], ARROW)

        for batch in batches:
            for i in range(batch.num_rows):
                x = encoder.encode(batch.column(1)[i].as_py() or "") + tail
                ids.append(batch.column(0)[i].as_py())
                data.append(x)
                held += len(x) // 4
                if held >= CHUNK:
                    yield out()
                    ids, data, held, chunk = [], [], 0, chunk + 1
        if data:
            yield out()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, bits: bool = False) -> None:
    """Encode all documents in ascending id order and write the chunk files under ``path``."""
    d = docs.select(whole_id(docs, id_col).alias("id"), F.col(text_col).alias("text"))
    order = [F.col("id"), F.xxhash64("text")]
    d = d.repartitionByRange(*order).sortWithinPartitions(*order)
    d.mapInArrow(chunk_writer(tokenizer, end, bits), CHUNKS).write.option("compression", "uncompressed").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(path)


def chunk_starts(chunks: DataFrame) -> DataFrame:
    """(part, chunk, first): ids before each chunk. One row per part goes through one task."""
    sizes = chunks.select("part", "chunk", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("s"))
    before = F.coalesce(F.sum("s").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("inside", inside).join(parts.select("part", before.alias("before")), "part").select("part", "chunk", (F.col("before") + F.col("inside")).alias("first"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(part, chunk, doc_id, at, ids binary) of every document in the files; ids are little-endian unsigned 32-bit."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # one chunk is decoded at a time
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                data, ends = unpacked(row["blocks"]), np.cumsum(row["n_tokens"])
                at = [0, *ends[:-1].tolist()]
                yield pa.RecordBatch.from_pydict({
                    "part": [row["part"]] * len(at), "chunk": [row["chunk"]] * len(at), "doc_id": pa.array(row["doc_ids"], pa.int64()), "at": at,
                    "ids": [data[4 * a : 4 * e] for a, e in zip(at, ends.tolist())],
                }, pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("ids", pa.binary())]))

    return read_chunks(spark, path).mapInArrow(run, "part int, chunk int, doc_id bigint, at bigint, ids binary")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    docs = read_documents(spark, path).select("part", "chunk", "doc_id", "at", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    x = docs.join(chunk_starts(read_chunks(spark, path)), ["part", "chunk"])
    return x.select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokens_of(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and return their index."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    return token_index(spark, path)


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(table(spark, sf_dir, "documents"))
