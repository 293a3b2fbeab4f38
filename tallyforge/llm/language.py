"""Operator 4: language identification by sparse multinomial logistic regression.

Inputs are TF-IDF weights of hashed character 1- to 3-grams of the whole lower-cased
text. Document frequencies are counted over all training rows; the weights are trained
with follow-the-regularised-leader (per-coordinate rates, elastic-net penalty) on a
bounded sample, balanced by language, and the scores are then calibrated by one
temperature fitted on rows that training did not see.

Defined cases: a text that is null or has no letter (as Unicode names letters; ½ and Ⅷ
are none) is ``und`` with score 0; very long texts are hashed whole, in pieces; of
languages that score alike the first by name is taken; a language is only ever one that
was learned, and there is no bound on how many; without training rows every text is
``und``; equal texts, so repeated rows, get equal predictions and count once in the
sample; null ids stay; an empty table gives an empty result; columns beyond those named
stay as they are, but a caller's ``lang_pred`` or ``score`` is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import hashed_sample, table

BUCKETS = 1 << 15
ORDERS = 3
#: Characters that are hashed at a time.
PIECE = 1 << 20
#: Training rows of each language, at most.
SAMPLE = 800
#: Below this score the pipeline rejects a document.
LEAST_SCORE = 0.5


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the text."""
    out = np.zeros(BUCKETS, np.int64)
    text = text.lower()
    for at in range(0, max(len(text), 1), PIECE):
        c = np.frombuffer(text[max(0, at - ORDERS + 1) : at + PIECE].encode("utf-32-le", "replace"), "<u4")
        skip = min(at, ORDERS - 1)  # n-grams that end there were counted with the piece before
        h = np.zeros(len(c), np.uint32)
        for n in range(1, ORDERS + 1):
            h = (h[:-1] if n > 1 else h) * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(n)
            out += np.bincount(((h * np.uint32(0x9E3779B1)) >> np.uint32(17))[max(0, skip - n + 1) :], minlength=BUCKETS)
    return out


class LanguageModel:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.languages, self.idf, self.weights, self.bias, self.temperature = languages, idf, weights, bias, temperature

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        n = gram_counts(text)
        i = np.flatnonzero(n)
        x = (1 + np.log(n[i])) * self.idf[i]
        return i, (x / max(np.linalg.norm(x), 1e-12)).astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return "und", 0.0
        i, x = self.vector(text)
        p = softmax((x @ self.weights[i] + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def follow_the_leader(xs, ys, k: int, epochs: int = 3, alpha: float = 0.8, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with elastic net; the last row of the state is the bias, which is not penalised."""
    z, n = np.zeros((BUCKETS + 1, k), np.float32), np.zeros((BUCKETS + 1, k), np.float32)

    def weights(i):
        pull = l1 * (i < BUCKETS)[:, None]
        w = -(z[i] - np.sign(z[i]) * pull) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= pull, 0, w)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for t in order.permutation(len(xs)):
            i, x = xs[t]
            i, x = np.append(i, BUCKETS), np.append(x, 1.0)
            w = weights(i)
            p = softmax(x @ w)
            p[ys[t]] -= 1
            g = x[:, None] * p
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = weights(np.arange(BUCKETS + 1)).astype(np.float32)
    return w[:-1], w[-1]


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each bucket occurs, and how many texts there are; 32768 sums reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for pdf in batches:
            for t in pdf["text"]:
                df += gram_counts(t or "") > 0
                n += 1
        yield pd.DataFrame({"b": np.append(np.arange(BUCKETS), -1), "n": np.append(df, n)})

    got = texts.select("text").mapInPandas(count, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS, np.int64)
    own = got[got.b >= 0]
    df[own.b.to_numpy()] = own.n.to_numpy()
    return df, int(got.n[got.b < 0].sum())


def fit_language_model(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Train on rows with a label: frequencies from all, weights from at most ``sample`` distinct rows a language, chosen by hash.

    The sample's texts become vectors where they are read, so what reaches the driver is
    bounded however long the texts are.
    """
    d = labelled.select(F.col(text_col).alias("text"), F.col(label_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, n = document_frequencies(d)
    if not n:
        return LanguageModel([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0))
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    shared = d.sparkSession.sparkContext.broadcast(LanguageModel([], idf, np.zeros((0, 0)), np.zeros(0)))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[np.array([has_letter(t) for t in pdf["text"]], bool)]
            if not len(pdf):
                continue
            got = [shared.value.vector(t) for t in pdf["text"]]
            key = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 for t in pdf["text"]]
            yield pd.DataFrame({"lang": pdf["lang"].tolist(), "key": key, "i": [i.astype(np.int16).tobytes() for i, _ in got], "x": [x.tobytes() for _, x in got]})

    rows = hashed_sample(d, "lang", sample).repartition(16).mapInPandas(vectors, "lang string, key long, i binary, x binary").collect()
    rows.sort(key=lambda r: (r.lang, r.key, r.x))
    languages = sorted({r.lang for r in rows})
    model = LanguageModel(languages, idf, np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)))
    number = {k: i for i, k in enumerate(languages)}
    xs = [(np.frombuffer(r.i, np.int16).astype(np.int64), np.frombuffer(r.x, np.float32)) for r in rows]
    ys = [number[r.lang] for r in rows]
    seen = [i for i in range(len(xs)) if i % 5 or len(xs) < 20]
    model.weights, model.bias = follow_the_leader([xs[i] for i in seen], [ys[i] for i in seen], len(languages))
    rest = [i for i in range(len(xs)) if i % 5 == 0]

    def loss(t: float) -> float:
        return -sum(np.log(softmax((xs[i][1] @ model.weights[xs[i][0]] + model.bias) / t)[ys[i]] + 1e-12) for i in rest)

    model.temperature = float(min(np.geomspace(0.05, 5, 40), key=loss)) if rest else 1.0
    return model


def predict_language(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and, last, lang_pred and score."""
    taken = {"lang_pred", "score"} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"rename these columns first, the prediction adds them: {sorted(taken)}")
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for s in texts:
            yield pd.DataFrame([m.predict(t) for t in s], columns=["lang_pred", "score"])

    p = predict(F.col(text_col)).alias("_p")
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_d"), p).select("_d.*", "_p.lang_pred", "_p.score")


def accepted(docs: DataFrame, model: LanguageModel, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The documents, with their own columns, whose language is known with at least the given score."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    p = predict_language(d, model)
    return p.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")


def held_out(doc_id, k: int, r: int):
    return F.coalesce(F.crc32(doc_id.cast("string")) % k == r, F.lit(False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    model = fit_language_model(docs.where(~F.col("held_out")))
    return predict_language(docs.select("doc_id", "held_out", "text"), model).drop("text")
