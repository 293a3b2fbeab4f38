"""Operator 9: secret scans with character Markov models.

Fixed patterns give the base spans (assignments, access keys, long hex runs). Beside
them, every run of ``LEAST_RUN`` or more token characters is scored, less what base
spans cover, by two smoothed character Markov models, one of random strings and one of
ordinary identifiers: the sum of the log-likelihood ratios of its characters. A run
whose sum passes the calibrated threshold is a span of kind ``markov``; being a sum, it
asks less of each character the longer the run is, and no other rule (digits, case)
decides.

The models learn from labelled samples. Random: values of base matches, and generated
strings over usual alphabets. Ordinary: the corpus's own words and tokens outside base
spans, and identifiers put together from its words with digits, dates, counters, paths,
separators and case styles, UUIDs, whose form is public, and rules and alphabets. A fifth
of the words is held out for the threshold. Hex digits alone are no evidence below the
base pattern's length.

Defined cases: null and empty texts have no spans; very long texts are scanned whole;
offsets count code points; rows with a null id keep it; equal texts, so repeated rows,
get equal spans; of base matches that overlap, each kind keeps its own; an empty table
trains on the generated strings alone and gives an empty result; columns beyond those
named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import hashed_sample, table

# The base patterns, in the order of their kinds, and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORD = re.compile(r"[dDtTnNyY][\"']?\x20*[:=]")
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "markov")

#: Characters that a scored run has at least.
LEAST_RUN = 16
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
INDEX = np.full(128, 0, np.int64)
INDEX[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)
SIZE = len(ALPHABET) + 1
#: Documents from which samples are drawn, at most, and from each of them: base values, tokens, letters of a token.
SAMPLE_DOCS, VALUES_EACH, TOKENS_EACH, LONGEST = 5_000, 20, 8, 80
#: Generated strings of each label.
GENERATED = 12_000
#: Share of held-out ordinary strings that may pass for random.
FALSE_SHARE = 0.002


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    found = []
    if ASSIGN_WORD.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def codes(s: str) -> np.ndarray:
    return INDEX[np.minimum(np.frombuffer(s.encode("ascii", "replace"), np.uint8), 127)]


class Markov:
    """Order-2 character model, interpolated with orders 1 and 0."""

    def __init__(self, strings: list[str]):
        three, two, one = np.zeros((SIZE, SIZE, SIZE)), np.zeros((SIZE, SIZE)), np.ones(SIZE) / SIZE
        for s in strings:
            c = np.concatenate([[0, 0], codes(s)])
            np.add.at(three, (c[:-2], c[1:-1], c[2:]), 1)
            np.add.at(two, (c[1:-1], c[2:]), 1)
            np.add.at(one, c[2:], 1)
        p = one / one.sum()
        p = (two + 5 * p) / (two.sum(1, keepdims=True) + 5)
        self.log = np.log((three + 5 * p[None]) / (three.sum(2, keepdims=True) + 5)).astype(np.float32)

    def each(self, s: str) -> np.ndarray:
        c = np.concatenate([[0, 0], codes(s)])
        return self.log[c[:-2], c[1:-1], c[2:]]


class SecretModel:
    """Both models, and the least sum of log-likelihood ratios that makes a run a secret.

    ``unseen`` are ordinary strings of words that ``ordinary`` does not have, and
    ``secret`` random ones: the threshold lets few of the former pass, but never more
    than half of the shortest random ones fail.
    """

    def __init__(self, randoms: list[str], ordinary: list[str], secret: list[str] = (), unseen: list[str] = ()):
        self.random, self.ordinary = Markov(randoms), Markov(ordinary)
        wrong = [self.score(s) for s in unseen if len(s) >= LEAST_RUN]
        right = [self.score(s) for s in secret if len(s) == LEAST_RUN]
        most = float(np.median(right)) if right else np.inf
        self.threshold = min(most, max(0.0, float(np.quantile(wrong, 1 - FALSE_SHARE)) if wrong else 0.0))

    def score(self, s: str) -> float:
        return float((self.random.each(s) - self.ordinary.each(s)).sum())

    def is_secret(self, s: str) -> bool:
        return self.score(s) > self.threshold

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The base spans and those of runs, or of what base spans leave of them, that the models call random."""
        more, k = [], 0
        covered = merged_spans(base)
        for m in RUN.finditer(text):
            at = m.start()
            while k < len(covered) and covered[k][1] <= at:
                k += 1
            i = k
            while i < len(covered) and covered[i][0] < m.end():
                more.append((at, covered[i][0]))
                at = max(at, covered[i][1])
                i += 1
            more.append((at, m.end()))
        more = [(a, 3, b) for a, b in more if b - a >= LEAST_RUN and self.is_secret(text[a:b])]
        return sorted([*base, *more])


def merged_spans(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, _, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def random_strings(n: int, seed: int = 7) -> list[str]:
    """Strings whose characters are drawn independently from an alphabet of usual keys."""
    r = random.Random(seed)
    lower, upper, digits = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
    sets = (lower + upper + digits, lower + upper + digits + "+/", lower + digits, upper + digits, lower + upper + digits + "_-", lower + upper, lower, upper)
    out = []
    for i in range(n):
        s = "".join(r.choices(sets[i % len(sets)], k=r.randint(LEAST_RUN, 64)))
        out.append(s + "=" * (-len(s) % 4) if i % len(sets) == 1 else s)
    return out


def ordinary_strings(words: list[str], n: int, seed: int = 8) -> list[str]:
    """Identifiers, file names, dated names, counters and paths put together from words; UUIDs, rules and alphabets."""
    r = random.Random(seed)
    styles = (str.lower, str.lower, str.lower, str.upper, str.title)

    def number() -> str:
        return r.choice((str(r.randint(0, 99)), f"{r.randint(1, 99999):0{r.randint(2, 9)}d}", str(r.randint(1990, 2035)), f"v{r.randint(0, 20)}"))

    def date(sep: str) -> str:
        return sep.join((str(r.randint(1990, 2035)), f"{r.randint(1, 12):02d}", f"{r.randint(1, 28):02d}"))

    def one() -> str:
        kind = r.random()
        if kind < 0.06:
            made = str(uuid.UUID(int=r.getrandbits(128), version=4))
            return made.upper() if kind < 0.01 else made
        if kind < 0.1:
            return "".join(r.choices(ALPHABET[52:62], k=r.randint(8, 24)))
        if kind < 0.14:  # rules and fillers
            c = r.choice("-=_-=_" + ALPHABET)
            return c * r.randint(LEAST_RUN, 80)
        if kind < 0.16:
            run = r.choice((ALPHABET[:26], ALPHABET[26:52], "01234567890123456789", ALPHABET[:62]))
            return run[r.randint(0, 3) :]
        style, sep = r.choice(styles), r.choice(("_", "-", "/", "", "=", "--"))
        parts = [style(r.choice(words)) for _ in range(r.randint(1, 6))]
        if sep == "" and style is str.lower:
            parts = [parts[0], *map(str.title, parts[1:])]
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            parts.insert(r.randint(0, len(parts)), number())
        if r.random() < 0.25:
            parts.insert(r.choice((0, len(parts))), date(r.choice(("-", "", "_", "/"))))
        if r.random() < 0.1:
            parts.append(f"{r.randint(0, 23):02d}{r.randint(0, 59):02d}{r.randint(0, 59):02d}")
        return sep.join(parts)

    return [one() for _ in range(n)]


# Words of names in programs and files, beside the corpus's own.
PROGRAM_WORDS = (
    "address annual array backup buffer build cache class client code config count customer data date default delete document draft error event field file final flag "
    "format function group handler header id image img index info input internationalization invoice item key label length level line list load local log main manager map max "
    "message meta min mode model module name new node null number object offset old option order output page parent path port prefix process profile project query queue "
    "range raw read record report request result return root row schema screen script search server service session set setting size sort source start state status step "
    "string style summary system table target task temp template test text thread time timestamp title tmp total tree type update upload url user util value version video view width window write "
    "app assets bin blob blog com css docs example git github html http https io java javascript js json lib main master net news org pdf php png py raw src static test tree txt usr var wiki www xml"
).split()


def fit_secret_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> SecretModel:
    """Train on generated strings and a bounded sample: tokens and base values of at most ``sample_docs`` documents, chosen by hash."""
    chosen = hashed_sample(docs.select(F.lit(1).alias("one"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "one", sample_docs)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                t = t or ""
                base = base_spans(t)
                values = [ASSIGN.match(t, a)[2] if k == 0 else t[a:b] for a, k, b in base]
                out += [(1, v) for v in spread(values, VALUES_EACH)]
                covered = merged_spans(base)
                tokens = {m[0] for m in TOKEN.finditer(t) if m.end() - m.start() <= LONGEST and not any(a < m.end() and m.start() < b for a, b in covered)}
                out += [(0, w) for w in spread(sorted(tokens), TOKENS_EACH)]
            yield pd.DataFrame(out, columns=["label", "s"])

    rows = sorted((r.label, r.s) for r in chosen.repartition(16).mapInPandas(pick, "label int, s string").collect())
    values = [s for k, s in rows if k == 1 and len(s) >= LEAST_RUN and not re.fullmatch("[0-9a-f]+", s)]
    own = [s for k, s in rows if k == 0]
    words = sorted({w.lower() for w in own if w.isalpha() and len(w) <= 20})
    mix = random.Random(3)
    mix.shuffle(words)
    held, seen = set(words[: len(words) // 5]), words[len(words) // 5 :] or PROGRAM_WORDS
    plain = ordinary_strings(PROGRAM_WORDS, GENERATED // 3) + ordinary_strings(seen, GENERATED, 9)
    randoms, secret = values + random_strings(GENERATED), random_strings(GENERATED // 4, 11)
    # a corpus token that generated strings make likely random is no sample of an ordinary one
    first = SecretModel(randoms, plain)
    own = [s for s in own if len(s) < LEAST_RUN or not first.is_secret(s)]
    return SecretModel(randoms, [s for s in own if s.lower() not in held] + plain, secret, ordinary_strings(sorted(held), GENERATED // 2, 10) if held else [])


def spread(xs: list[str], most: int) -> list[str]:
    """At most ``most`` of them, at even distances."""
    return [xs[i * len(xs) // most] for i in range(most)] if len(xs) > most else xs


def scan_secrets(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts by kind, digest of the base spans, all spans."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = d.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                base = base_spans(t) if t else []
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                out.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(m.spans(t, base)) if t else ""))
            yield pd.concat([pdf[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])], axis=1)

    kind = dict(d.dtypes)["doc_id"]
    return d.mapInPandas(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs, fit_secret_model(docs))
