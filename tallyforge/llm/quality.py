"""Operator 13: quality by compression.

Two zstandard dictionaries are built, one from text labelled good and one from text
labelled bad. A text is cut into pieces of 512 bytes, so that what a dictionary knows
weighs alike in short and in very long texts, and every piece is compressed with both. The
normalised difference of the compressed sizes, (bad - good) / the greater of both, is the
evidence; a logistic curve turns it into a score. The curve's second input is how small
the lesser size is against the text, as text that only repeats itself shrinks to nothing
with either dictionary and leaves no difference to see.

The dictionaries learn from one half of a bounded sample of labelled rows, the curve from
the other half, weighted by how many rows each label has, so that a score is a share.

Defined cases: null and empty texts have neither evidence nor size and get the curve's
value there; very long texts are compressed whole, piece by piece; equal texts get equal
scores, and copies of a text count once in the sample; labels other than 0 and 1, null
labels and labels of unknown documents teach nothing; with one label only, every score is
that label, and without labelled rows 0.5; too little text for a dictionary's builder
serves as a dictionary itself; null ids stay and teach nothing; an empty table gives an
empty result; columns beyond those named stay as they are, but a caller's ``score`` is an
error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import discard, hashed_sample, stash, table
from tallyforge.llm.language import held_out

#: Bytes of a piece, of a dictionary, and the compressor's level.
PIECE, DICTIONARY, LEVEL = 512, 1 << 16, 3
#: Labelled rows of each label, at most, and pieces of one text (evenly spaced over all of it) that a dictionary learns from.
SAMPLE, PIECES_EACH = 3_000, 16
#: Share of its size below which a text counts as repeating itself, and the least share told apart.
DENSE, LEAST = 0.25, 0.001
#: From this score on a text is called good.
THRESHOLD = 0.3
#: How firmly the curve is held flat, as a share of its evidence.
FIRMNESS = 1e-3


def pieces(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "replace")
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def build_dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary's bytes; the samples' own last bytes where the builder finds too few of them."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(dictionary) < 8:  # the library takes no shorter one
        return zstandard.ZstdCompressor(**plain)
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, **plain)


def curve_inputs(good: float, bad: float, whole: float) -> tuple[float, float]:
    """(normalised difference, how far the lesser size lies below a dense text's, as a logarithm) of sizes."""
    if not whole:
        return 0.0, 0.0
    return (bad - good) / max(good, bad), min(0.0, float(np.log((min(good, bad) / whole + LEAST) / DENSE)))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, firmness: float = FIRMNESS) -> np.ndarray:
    """Weights (the first is the bias) of a logistic curve over ``x``, by damped Newton steps on its penalised loss."""
    spread = np.maximum(x.std(0), 1e-6)
    z = np.hstack([np.ones((len(x), 1)), x / spread])
    weight = weight / weight.sum()
    hold = firmness * np.diag([0.0] + [1.0] * x.shape[1])

    def loss(w):
        m = z @ w
        return float(weight @ (np.logaddexp(0, m) - y * m) + w @ hold @ w / 2)

    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-(z @ w).clip(-500, 500)))
        gradient = z.T @ (weight * (p - y)) + hold @ w
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + hold + 1e-9 * np.eye(len(w)), gradient)
        share = 1.0
        while share > 1e-6 and loss(w - share * step) > loss(w):
            share /= 2
        w = w - share * step
        if np.abs(share * step).max() < 1e-9:
            break
    return np.append(w[0], w[1:] / spread)


class QualityModel:
    def __init__(self, good: bytes = b"", bad: bytes = b"", curve: np.ndarray | None = None):
        self.good, self.bad, self.curve = good, bad, np.zeros(3) if curve is None else curve
        self._with = None

    def __getstate__(self):
        return self.good, self.bad, self.curve

    def __setstate__(self, state):
        self.__init__(*state)

    def inputs(self, text: str | None) -> tuple[float, float]:
        if self._with is None:
            self._with = compressor(self.good), compressor(self.bad)
        cut = pieces(text)
        good, bad = (sum(len(c.compress(p)) for p in cut) for c in self._with)
        return curve_inputs(good, bad, sum(map(len, cut)))

    def score(self, text: str | None) -> float:
        m = self.curve[0] + np.dot(self.curve[1:], self.inputs(text))
        return float(1 / (1 + np.exp(-np.clip(m, -500, 500))))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(text, label) of the documents of at most ``sample`` ids of each label, chosen by hash of the id before texts are read.

    So few ids are broadcast (twice ``sample``), and no text is shuffled for them.
    """
    ids = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull())
    x = docs.join(F.broadcast(hashed_sample(ids, "_y", sample)), docs[id_col] == F.col("_id"))
    return x.select(F.col("text"), F.col("_y").alias("label"))


def fit_quality_model(sample: DataFrame, shares: tuple[float, float]) -> QualityModel:
    """Train on a bounded sample of (text, label); ``shares`` are the numbers of labelled rows, bad and good, that it stands for."""
    sample = stash(sample.where(F.col("text").isNotNull() & F.col("label").isNotNull()).distinct(), "op13-sample")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, label in zip(pdf["text"], pdf["label"]):
                key, ps = xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")), pieces(text)
                if key % 2 and ps:
                    rows += [(label, str(key), n, ps[i]) for n, i in enumerate(np.unique(np.linspace(0, len(ps) - 1, PIECES_EACH).astype(int)))]
            yield pd.DataFrame(rows, columns=["label", "key", "n", "piece"])

    taught = sample.mapInPandas(cut, "label int, key string, n int, piece binary").collect()
    taught.sort(key=lambda r: (r.key, r.n))
    model = QualityModel(*(build_dictionary([bytes(r.piece) for r in taught if r.label == k]) for k in (1, 0)))
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rest = [(label, *shared.value.inputs(t)) for t, label in zip(pdf["text"], pdf["label"]) if xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) % 2 == 0]
            yield pd.DataFrame(rest, columns=["label", "difference", "small"])

    rest = sample.mapInPandas(weigh, "label int, difference double, small double").toPandas().sort_values(["label", "difference", "small"])
    discard(sample)
    seen = {*rest["label"], *(r.label for r in taught)}
    y = rest["label"].to_numpy()
    if len(set(y)) == 2:
        weight = np.array(shares, float)[y] / np.bincount(y)[y]
        model.curve = fit_curve(rest[["difference", "small"]].to_numpy(), y, weight)
    elif len(seen) == 1:
        model.curve = np.array([500.0 if 1 in seen else -500.0, 0, 0])
    return model


def score_quality(df: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and, last, score."""
    if "score" in {c.lower() for c in df.columns}:
        raise ValueError("rename the column score first, the prediction adds one")
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(shared.value.score).astype("float64")

    return df.select("*", score(F.col(text_col)).alias("score"))


def label_shares(labels: DataFrame, label_col: str = "quality") -> tuple[float, float]:
    """How many rows are labelled bad and good."""
    y = F.col(label_col).cast("int")
    return tuple(map(float, labels.select(F.count_if(y == 0), F.count_if(y == 1)).first()))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id"), 5, 0).alias("held_out"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out(F.col("doc_id"), 5, 0))
    model = fit_quality_model(labelled_sample(docs.select("doc_id", "text"), labels), label_shares(labels))
    return score_quality(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
