"""Operator 6: toxicity by a bidirectional gated recurrent network with attention pooling.

Words (hashed embeddings) and their characters (mean of hashed 3- and 4-gram embeddings)
are the inputs. The recurrence runs over a text once, in segments that begin and end
``CONTEXT`` words early and late; attention then pools the states of each window of
``SPAN`` words, at every start. As a window's logit is a quotient of two sums over its
words, all windows together cost two running sums. A text's score is that of its worst
window. The network is trained in numpy on a bounded sample
of labelled texts, as multiple-instance learning: of a toxic text the worst window
counts, of a clean text its worst ones. The embeddings' first component starts at the
log-odds of the label in the sample, and the largest log-odds of a word's n-grams is one
more input. The logit is shifted at last so that the threshold 0.7 is the best one on
texts that training did not see.

Defined cases: null texts and texts without words score 0; very long texts are scored
whole; of windows that score alike any gives the text's score; equal texts, so repeated
rows, score alike and count once in the sample; labels other than 0 and 1 teach nothing;
without labels of both kinds every score is 0; null ids stay; an empty table gives an
empty result; columns beyond those named stay as they are, but a caller's ``score`` is an
error.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import hashed_sample, table
from tallyforge.llm.language import held_out

WORD = re.compile(r"\w+")
#: Words of a window, words read around it before its states count, words of a segment, bound of the attention's energy.
SPAN, CONTEXT, SEGMENT, ENERGY = 12, 6, 104, 6.0
WORD_ROWS, CHAR_ROWS, DIM, HIDDEN = 1 << 16, 1 << 16, 8, 8
THRESHOLD = 0.7
#: Embedding rows found in fewer training texts than this stay 0: what they could teach is chance.
OFTEN = 6
#: Labelled texts of each kind from which the network learns, at most, and words of each.
SAMPLE = 1_500
#: Windows of a clean text that are taught in each epoch, at most.
WORST = 6
#: Words whose input vectors a worker remembers, at most.
REMEMBER = 200_000


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Vocabulary:
    """Words by number (0 is none), with the embedding rows of the word and of its 3- and 4-grams."""

    def __init__(self):
        self.number: dict[str, int] = {"": 0}
        self.tables = rows_of([""])

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Word numbers of each text; words not met before are added."""
        new = sorted(set().union(*texts) - self.number.keys())
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.tables = rows_of(new) if new else None
        return [np.array(list(map(self.number.__getitem__, ws)), np.int64) for ws in texts]


def rows_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows, all words' gram rows in a line, and where each word's grams begin (one more than words)."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    long = np.array([len(w) + 2 for w in words], np.int64)
    first = np.cumsum(long) - long
    place = np.arange(len(codes)) - np.repeat(first, long)
    mixed = (codes + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))
    whole = np.add.reduceat(mixed, first) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)
    c = np.append(codes, np.zeros(3, np.uint64))
    n = len(codes)
    three = (c[:n] * np.uint64(1_000_003) + c[1 : n + 1]) * np.uint64(1_000_003) + c[2 : n + 2]
    four = three * np.uint64(1_000_003) + c[3 : n + 3]
    rest = np.repeat(long, long) - place  # characters from here to the word's end
    grams = np.stack([three, four], axis=1) * np.uint64(0x94D049BB133111EB) >> np.uint64(40)
    fits = np.stack([(rest >= 3) | (place == 0), rest >= 4], axis=1)
    many = np.add.reduceat(fits.sum(1), first)
    return (whole % np.uint64(WORD_ROWS)).astype(np.int64), (grams[fits] % np.uint64(CHAR_ROWS)).astype(np.int64), np.append(0, np.cumsum(many))


def some(tables, i: np.ndarray):
    """The tables of the words numbered ``i``."""
    w, grams, at = tables
    many = np.diff(at)[i]
    begin = np.cumsum(many) - many
    return w[i], grams[np.arange(many.sum()) + np.repeat(at[:-1][i] - begin, many)], np.append(begin, many.sum())


def windows_of(long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of ``long`` words (one at least) in a line: first place of each window, the place after it, and whose it is."""
    many = np.maximum(long - SPAN, 0) + 1
    owner = np.repeat(np.arange(len(long)), many)
    starts = np.arange(many.sum()) + np.repeat(np.cumsum(long) - long - np.cumsum(many) + many, many)
    return starts, starts + np.minimum(long, SPAN)[owner], owner


def cut_out(line: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Word numbers at [begin, end) of the line as the columns of a matrix; 0 is none."""
    place = begin + np.arange((end - begin).max())[:, None]
    return np.where(place < end, line[np.minimum(place, len(line) - 1)], 0)


def summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows that go to each of ``n`` places."""
    return np.stack([np.bincount(at, x, n) for x in rows.T], axis=1).astype(rows.dtype)


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)

        def init(*shape):
            return (r.standard_normal(shape) * np.sqrt(1 / shape[0])).astype(np.float32)

        self.p = {"word": 0.1 * r.standard_normal((WORD_ROWS, DIM)).astype(np.float32), "char": 0.1 * r.standard_normal((CHAR_ROWS, DIM)).astype(np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": init(2 * DIM + 1, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"u{d}": init(HIDDEN, 3 * HIDDEN)}
        self.p |= {"a": init(2 * HIDDEN, HIDDEN), "v": init(HIDDEN), "o": init(2 * HIDDEN), "k": np.zeros(1, np.float32)}
        self.shift, self.often, self.odds = 0.0, {}, np.zeros(CHAR_ROWS, np.float32)

    def embed(self, tables) -> np.ndarray:
        w, grams, at = tables
        chars = np.add.reduceat(self.p["char"][grams], at[:-1]) / np.diff(at)[:, None].astype(np.float32)
        return np.hstack([self.p["word"][w], chars, np.maximum.reduceat(self.odds[grams], at[:-1])[:, None]])

    def inputs(self, embedded: np.ndarray) -> dict[str, np.ndarray]:
        return {d: embedded @ self.p[f"x{d}"] + self.p[f"c{d}"] for d in "fb"}

    def scan(self, x: np.ndarray, there: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """x: (time, batch, 3 * HIDDEN) projected inputs; hidden states in time order."""
        u, n = self.p[f"u{d}"], HIDDEN
        h, out = np.zeros((x.shape[1], n), x.dtype), np.empty((*x.shape[:2], n), x.dtype)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            hu = h @ u
            g = 1 / (1 + np.exp(-(x[t, :, : 2 * n] + hu[:, : 2 * n])))
            z, r = g[:, :n], g[:, n:]
            c = np.tanh(x[t, :, 2 * n :] + r * hu[:, 2 * n :])
            new = c + z * (h - c)
            new = np.where(there[t][:, None], new, h)
            if keep is not None:
                keep.append((t, h, z, r, c, hu[:, 2 * n :]))
            h = out[t] = new
        return out

    def states(self, ids: np.ndarray, inputs: dict[str, np.ndarray], keep: dict[str, list] | None = None) -> np.ndarray:
        """ids: (time, batch) word numbers, rows of ``inputs``."""
        return np.concatenate([self.scan(inputs[d][ids], ids > 0, d, keep and keep[d]) for d in "fb"], axis=2)

    def energy(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q = np.tanh(h @ self.p["a"])
        return q, ENERGY * np.tanh(q @ self.p["v"] / ENERGY)

    def logits(self, texts: list[np.ndarray], inputs: dict[str, np.ndarray]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of every window of texts of word numbers, and the windows as ``windows_of`` gives them."""
        line, long = np.concatenate(texts), np.array([len(x) for x in texts])
        first = np.cumsum(long) - long
        many = -(-long // SEGMENT)
        owner = np.repeat(np.arange(len(long)), many)
        core = first[owner] + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * SEGMENT
        last = first[owner] + long[owner]
        begin, end, stop = np.maximum(core - CONTEXT, first[owner]), np.minimum(core + SEGMENT + CONTEXT, last), np.minimum(core + SEGMENT, last)
        weight, value = np.empty(len(line)), np.empty(len(line))
        order = np.argsort(end - begin, kind="stable")
        for at in range(0, len(order), 1024):
            i = order[at : at + 1024]
            h = self.states(cut_out(line, begin[i], end[i]), inputs)
            place = begin[i] + np.arange(len(h))[:, None]
            own = (place >= core[i]) & (place < stop[i])
            weight[place[own]], value[place[own]] = np.exp(self.energy(h)[1])[own], (h @ self.p["o"])[own]
        windows = windows_of(long)
        sums = [np.append(0.0, np.cumsum(x)) for x in (weight * value, weight)]
        top, below = (x[windows[1]] - x[windows[0]] for x in sums)
        return top / below + self.p["k"][0], windows

    def worst(self, texts: list[np.ndarray], inputs: dict[str, np.ndarray]) -> np.ndarray:
        z, (_, _, owner) = self.logits(texts, inputs)
        return np.maximum.reduceat(z, np.searchsorted(owner, np.arange(len(texts))))

    def gradients(self, ids: np.ndarray, inside: np.ndarray, y: np.ndarray, tables) -> dict[str, np.ndarray]:
        """ids: (time, batch) word numbers of windows with their context; ``inside``: what is of the window itself."""
        p, n = self.p, HIDDEN
        used, w = np.unique(ids, return_inverse=True)
        w = w.reshape(ids.shape)
        own = some(tables, used)
        emb = self.embed(own)
        inp, there = self.inputs(emb), ids > 0
        kept = {"f": [], "b": []}
        h = np.concatenate([self.scan(inp[d][w], there, d, kept[d]) for d in "fb"], axis=2)
        q, e = self.energy(h)
        a = np.where(inside, np.exp(e), 0)
        a = (a / a.sum(0)).astype(h.dtype)
        pooled = np.einsum("tbh,tb->bh", h, a)
        dl = ((sigmoid(pooled @ p["o"] + p["k"]) - y) / len(y)).astype(h.dtype)
        g = {"o": pooled.T @ dl, "k": dl.sum(keepdims=True)}
        dp = dl[:, None] * p["o"]
        da = np.einsum("tbh,bh->tb", h, dp)
        de = a * (da - (a * da).sum(0)) * (1 - (e / ENERGY) ** 2)
        dq = de[:, :, None] * p["v"] * (1 - q * q)
        g["v"], g["a"] = np.einsum("tb,tbh->h", de, q), np.einsum("tbi,tbj->ij", h, dq)
        dh = a[:, :, None] * dp + dq @ p["a"].T
        demb = np.zeros_like(emb)
        for s, d in enumerate("fb"):
            u, back = p[f"u{d}"], np.zeros((ids.shape[1], n), h.dtype)
            du, dx = np.zeros_like(u), np.empty((*ids.shape, 3 * n), h.dtype)
            for t, h0, z, r, c, hu in reversed(kept[d]):
                m = there[t][:, None]
                full = back + dh[t, :, s * n : (s + 1) * n]
                dn = np.where(m, full, 0)
                dc = dn * (1 - z) * (1 - c * c)
                dz, dr = dn * (h0 - c) * z * (1 - z), dc * hu * r * (1 - r)
                dx[t] = np.hstack([dz, dr, dc])
                dhu = np.hstack([dz, dr, dc * r])
                du += h0.T @ dhu
                back = np.where(m, dn * z, full) + dhu @ u.T
            sums = summed(w.reshape(-1), dx.reshape(-1, 3 * n), len(used))
            g |= {f"u{d}": du, f"x{d}": emb.T @ sums, f"c{d}": sums.sum(0)}
            demb += sums @ p[f"x{d}"].T
        many = np.diff(own[2])
        g["word"], g["char"] = (own[0], demb[:, :DIM]), (own[1], np.repeat(demb[:, DIM : 2 * DIM] / many[:, None], many, axis=0))
        return g

    def fit(self, texts: list[np.ndarray], y: np.ndarray, tables, epochs: int = 16, batch: int = 128, rate: float = 0.02) -> None:
        """texts: word numbers of each text. Adam; embedding rows are updated where they occur."""
        line, long = np.concatenate(texts), np.array([len(x) for x in texts])
        last = np.cumsum(long)
        m, v, step, order = {}, {}, 0, np.random.default_rng(7)
        for e in range(epochs):
            scores, (starts, ends, owner) = self.logits(texts, self.inputs(self.embed(tables)))
            # the worst window of each stretch of SPAN starts, as neighbours hardly differ; of these each text's worst
            stretch = starts // SPAN
            best = np.lexsort((-scores, stretch, owner))
            best = best[np.append(True, (np.diff(stretch[best]) != 0) | (np.diff(owner[best]) != 0))]
            best = best[np.lexsort((-scores[best], owner[best]))]
            place = np.arange(len(best)) - np.searchsorted(owner[best], owner[best])
            worst = best[place < np.where(y[owner[best]] == 1, 1, WORST)]
            chosen = order.permutation(worst)
            for at in range(0, len(chosen), batch):
                c = chosen[at : at + batch]
                o = owner[c]
                begin = np.maximum(starts[c] - CONTEXT, last[o] - long[o])
                ids = cut_out(line, begin, np.minimum(ends[c] + CONTEXT, last[o]))
                here = begin + np.arange(len(ids))[:, None]
                g, step = self.gradients(ids, (here >= starts[c]) & (here < ends[c]), y[o].astype(np.float32), tables), step + 1
                now = rate * (1 - e / epochs) + 1e-3
                for k, x in g.items():
                    if isinstance(x, tuple):
                        x = summed(*x, len(self.p[k])) * self.often[k][:, None]
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * x
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * x * x
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


class ToxicityModel:
    def __init__(self, network: Network | None):
        self.network, self.vocabulary, self.inputs = network, Vocabulary(), None

    def __getstate__(self):
        return {"network": self.network, "vocabulary": Vocabulary(), "inputs": None}

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The scores of many texts; vectors of words met before are kept."""
        if self.network is None:
            return np.zeros(len(texts))
        if len(self.vocabulary.number) > REMEMBER:
            self.vocabulary, self.inputs = Vocabulary(), None
        v, net = self.vocabulary, self.network
        out = np.zeros(len(texts))
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        there = [i for i, ws in enumerate(words) if ws]
        if not there:
            return out
        if self.inputs is None:
            self.inputs = {d: [x] for d, x in net.inputs(net.embed(v.tables)).items()}
        ids = v.ids([words[i] for i in there])
        if v.tables is not None:
            for d, x in net.inputs(net.embed(v.tables)).items():
                self.inputs[d].append(x)
        if len(self.inputs["f"]) > 1:
            self.inputs = {d: [np.concatenate(x)] for d, x in self.inputs.items()}
        out[there] = sigmoid(net.worst(ids, {d: x[0] for d, x in self.inputs.items()}) + net.shift)
        return out


def log_odds(rows: list[np.ndarray], y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's presence in toxic against clean texts, shrunk towards 0; and which rows occur often enough to learn."""
    n = np.zeros((2, size))
    for x, k in zip(rows, y):
        n[int(k), np.unique(x)] += 1
    share = (n + 0.5) / (np.array([[(y == 0).sum()], [(y == 1).sum()]]) + 1)
    often = n.sum(0) >= OFTEN
    return (np.log(share[1] / share[0]) * (n.sum(0) / (n.sum(0) + 4)) * often).astype(np.float32), often


def train(texts: list[str], y: np.ndarray) -> ToxicityModel:
    if len(set(y.tolist())) < 2:
        return ToxicityModel(None)
    v = Vocabulary()
    ids = v.ids([WORD.findall(t.lower()) or [""] for t in texts])
    tables, net = rows_of(list(v.number)), Network()
    seen = np.arange(len(texts)) % 5 > 0
    fit = [i for i in range(len(texts)) if seen[i]]
    for k, rows in (("word", [tables[0][ids[i]] for i in fit]), ("char", [some(tables, np.unique(ids[i]))[1] for i in fit])):
        net.p[k][:, 0], net.often[k] = log_odds(rows, y[fit], len(net.p[k]))
        net.p[k][~net.often[k]] = 0
    net.odds = net.p["char"][:, 0].copy()
    net.fit([ids[i] for i in fit], y[fit], tables)
    rest = [i for i in range(len(texts)) if not seen[i]]
    inputs = net.inputs(net.embed(tables))
    worst = net.worst([ids[i] for i in rest], inputs)
    net.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - best_cut(worst, y[rest]))
    return ToxicityModel(net)


def best_cut(x: np.ndarray, y: np.ndarray) -> float:
    """The middle of the cuts with the best F1."""
    if len(set(y.tolist())) < 2:
        return 0.0
    cuts = np.unique(x)
    cuts = np.append((cuts[1:] + cuts[:-1]) / 2, 0.0)
    over = x >= cuts[:, None]
    f1 = 2 * over @ (y == 1) / np.maximum(1, over.sum(1) + (y == 1).sum())
    return float(np.median(cuts[f1 >= f1.max() - 1e-9]))


def fit_toxicity_model(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Train on at most ``sample`` distinct texts of each label, chosen by hash."""
    d = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("text").isNotNull())
    rows = hashed_sample(d, "y", sample).collect()
    rows.sort(key=lambda r: (zlib.crc32(r.text.encode("utf-8", "replace")), r.text, r.y))
    return train([r.text for r in rows], np.array([r.y for r in rows]))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """The documents of at most ``sample`` ids of each label, chosen by hash of the id, with their label.

    Chosen before the join, the ids are so few (twice ``sample``) that they are broadcast
    and no text is shuffled.
    """
    ids = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("_id").isNotNull())
    return docs.join(F.broadcast(hashed_sample(ids, "toxic", sample)), docs[id_col] == F.col("_id")).drop("_id")


def score_toxicity(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and, last, score."""
    if "score" in {c.lower() for c in df.columns}:
        raise ValueError("rename the column score first, the prediction adds one")
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for s in texts:
            yield pd.Series(np.concatenate([m.score(s.iloc[i : i + 200].tolist()) for i in range(0, len(s), 200)] or [np.zeros(0)]))

    return df.select("*", score(F.col(text_col)).alias("score"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id"), 3, 1))
    model = fit_toxicity_model(labelled_sample(docs.select("doc_id", "text"), labels))
    return score_toxicity(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
