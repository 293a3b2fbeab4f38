"""Brute-force versions, held-out figures and defined cases of the training-data operators."""

import math
import random
import re
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import common, components, decontamination, fingerprints, html_text, language, mixing, near_dedup, secrets, token_files, toxicity, urls

LONG = " ".join(f"w{i}" for i in range(60_000))
HOSTILE = [
    (1, None, None, None), (2, "", "en", "a"), (3, "one two three", "en", None), (3, "one two three", "en", None), (4, LONG, "en", "a"),
    (5, LONG + " more", "en", "b"), (None, None, None, None), (None, "no id", "en", "a"), (None, "no id", "en", "a"), (6, "½ ² 12", "en", "b"), (7, "\x00퟿\u0001\u0004 odd", "de", "b"),
]
NAMES = "size key h id row source_size target taken salt times path host rule verdict n_chars fp node tree word_hash".split()


@pytest.fixture(scope="module")
def hostile(spark):
    d = spark.createDataFrame(HOSTILE, "doc_id long, text string, lang string, source string")
    return d.select("*", *[F.lit("mine").alias(n) for n in NAMES])


# --- samples


def test_sample_is_exact_and_the_same_however_rows_lie(spark):
    d = spark.range(300_000).select((F.col("id") % 7).cast("int").alias("label"), F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("x"))
    a = {tuple(r) for r in common.hashed_sample(d, "label", 50).collect()}
    b = {tuple(r) for r in common.hashed_sample(d.repartition(13), "label", 50).collect()}
    assert a == b and all(20 < sum(k == x[0] for x in a) <= 50 for k in range(7))
    few = spark.range(30).select(F.lit(None).cast("string").alias("label"), "id")
    assert common.hashed_sample(few, "label", 50).count() == 30 and common.hashed_sample(few, "label", 10).count() == 10


# --- 1


def test_mix_bounds_and_reruns(spark, hostile):
    rows = [(i, "", "tiny") for i in range(200)] + [(1000, "a b", "tiny")] + [(None, f"w{i} x y", "none") for i in range(300)] + [(2000 + i, "many words " * 20, "big") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    x = mixing.mix(d).toPandas()
    assert x["times"].max() <= 3 and (x.taken <= 3 * x["size"]).all()
    for _, g in x.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
    assert mixing.mixed_documents(d).count() == x["times"].sum()
    again = mixing.mix(d.repartition(5)).toPandas()
    assert sorted(map(tuple, again.fillna(-1).values)) == sorted(map(tuple, x.fillna(-1).values))
    assert mixing.mixed_documents(hostile).columns == hostile.columns and mixing.mix(hostile).count() == hostile.count()


# --- 2


def brute_sets(texts):
    out = []
    for t in texts:
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    return out


def test_groups_equal_those_of_plain_sets(spark):
    r, rows = random.Random(12), []
    for base in range(40):
        ws = [f"b{base}x{i}" if r.random() < 0.5 else r.choice("lorem ipsum dolor sit Amet".split()) for i in range(r.randint(1, 90))]
        for _ in range(r.choice((1, 2, 12))):
            out = [w if r.random() > 0.02 else f"n{r.random()}" for w in ws]
            rows.append((len(rows), " ".join(out)))
    sets = brute_sets([t for _, t in rows])
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().sort_values("doc_id")
    assert got.component_id.tolist() == root and got.n_shingles.tolist() == [len(s) for s in sets] and (got.kept == (got.doc_id == got.component_id)).all()


def test_candidates_are_the_same_in_small_pieces(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, bytes(r.choices(range(256), k=2)) * (2 * near_dedup.VALUES) if i % 3 else b"\7" * (4 * near_dedup.VALUES)) for i in range(500)]
    d = spark.createDataFrame(rows, "node long, sig binary").coalesce(1)
    whole = {tuple(x) for x in near_dedup.candidates(d).collect()}
    batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    keys = np.stack([np.frombuffer(x, ">u4") for _, x in sorted(rows, key=lambda x: (x[1], x[0]))])[:, : near_dedup.DEPTH]
    node = np.array([i for i, _ in sorted(rows, key=lambda x: (x[1], x[0]))])
    tree = np.zeros(len(node), np.int32)
    want = set(zip(*(x.tolist() for x in near_dedup.neighbours(tree, keys, node))))
    cut = set()
    for at in range(0, len(node), 29):
        lo, hi = max(0, at - near_dedup.REGION), min(len(node), at + 29 + near_dedup.REGION)
        cut |= set(zip(*(x.tolist() for x in near_dedup.neighbours(tree[lo:hi], keys[lo:hi], node[lo:hi], at - lo, min(at + 29, len(node)) - lo))))
    monkeypatch.setattr(near_dedup, "HELD", 40)
    small = {tuple(x) for x in near_dedup.candidates(d).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batches)
    assert cut == want and {x for x in whole if x[1] is not None} == {x for x in small if x[1] is not None}


def test_repeated_ids_stay_once_and_rows_without_id_stay(hostile):
    got = near_dedup.first_of_groups(hostile)
    rows = got.select("doc_id", "text").toPandas()
    assert got.columns == hostile.columns and rows.doc_id.isna().sum() == 3
    assert sorted(rows.doc_id.dropna()) == [1, 2, 3, 4, 6, 7]
    with pytest.raises(TypeError):
        near_dedup.near_duplicates(hostile.withColumn("doc_id", F.col("doc_id").cast("string")))


# --- 3


def test_tokens_of_hostile_rows(hostile):
    got = token_files.tokens_of(hostile).toPandas()
    assert len(got) == hostile.count() and got.doc_id.isna().sum() == 3
    got = got.sort_values("start")
    assert (got.start.iloc[1:].to_numpy() == np.cumsum(got.n_tokens.to_numpy())[:-1]).all()


# --- 4


def test_follow_the_leader_equals_plain_loops(monkeypatch):
    monkeypatch.setattr(language, "BUCKETS", 6)
    r = np.random.default_rng(1)
    xs = [(i, (r.random(3) * np.where(i == 5, 0.01, 1)).astype(np.float32)) for i in (np.sort(r.choice(6, 3, replace=False)) for _ in range(30))]
    ys = r.integers(0, 3, 30).tolist()
    w, bias = language.follow_the_leader(xs, ys, 3, epochs=2)
    alpha, beta, l1, l2 = 0.8, 1.0, 0.05, 0.01
    z, n = np.zeros((7, 3)), np.zeros((7, 3))

    def weight(i, k):
        pull = l1 if i < 6 else 0.0
        if abs(z[i, k]) <= pull:
            return 0.0
        return -(z[i, k] - math.copysign(pull, z[i, k])) / ((beta + math.sqrt(n[i, k])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for t in order.permutation(30):
            x = [*zip(xs[t][0], xs[t][1]), (6, 1.0)]
            now = {(i, k): weight(i, k) for i, _ in x for k in range(3)}
            e = [math.exp(sum(now[i, k] * v for i, v in x)) for k in range(3)]
            for i, v in x:
                for k in range(3):
                    g = v * (e[k] / sum(e) - (k == ys[t]))
                    z[i, k] += g - (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / alpha * now[i, k]
                    n[i, k] += g * g
    want = np.array([[weight(i, k) for k in range(3)] for i in range(7)])
    assert np.abs(np.vstack([w, bias]) - want).max() < 1e-3 and (w == 0).any()


def test_language_defined_cases(spark, hostile):
    rows = [(f"{'abcdefghij'[k % 10] * 3}{'klmnopqrst'[k // 10 % 10] * 3}{'uvwxyz'[k // 100] * 4} word{i}", f"l{k:03}") for k in range(230) for i in range(6)]
    m = language.fit_language_model(spark.createDataFrame(rows, "text string, lang string"))
    assert len(m.languages) == 230
    assert [m.predict(t) for t in ("½ ² 12", "①Ⅷ", "", None, " \n")] == [("und", 0.0)] * 5
    assert m.predict("aaakkkuuuu")[0] == "l000" and 0 <= m.predict(LONG)[1] <= 1
    got = language.predict_language(hostile, m)
    assert got.columns == [*hostile.columns, "lang_pred", "score"] and got.count() == hostile.count()
    assert language.predict_language(hostile.limit(0), m).count() == 0
    with pytest.raises(ValueError):
        language.predict_language(hostile.withColumn("Score", F.lit(1)), m)


# --- 5

UNITS = "|".join(decontamination.UNITS)


def brute_words(text, starts):
    """(type or None, word) of each word, by plain matching."""
    t = regex.sub("[\u0001-\u0004]", " ", text or "")
    t = regex.sub(r"(?<=[\p{Ll}\p{N},;] )(?=\p{Lu}\p{Ll})", "\u0001", t)
    t = regex.sub(r"(?<![\p{L}\p{N}])(?=\p{N})", "\u0002", t)
    t = regex.sub("(?<![\\p{L}\\p{N}\u0001\u0002])(?=\\p{Lu}\\p{Ll})", "\u0004", t)
    t = regex.sub(rf"(?i)(?<=\p{{N}})( ?)(?=(?:{UNITS}|[%°])(?![\p{{L}}\p{{N}}]))", " \u0003", t)
    t = regex.sub("(?<=\\p{N})[.,](?=\\p{N})|[^\\p{L}\\p{N}\\s%°\u0001-\u0004]+", "", t)
    out = []
    for w in t.lower().split():
        kind, w = ({"\u0001": "name", "\u0002": "number", "\u0003": "unit", "\u0004": "start"}.get(w[0]), w[1:]) if w[0] < "\u0005" else (None, w)
        if kind in (None, "start") and w in decontamination.NUMBER_WORDS:
            kind = "number"
        if kind == "start":
            kind = "name" if starts else None
        out.append((kind, w))
    return out


def brute_leaks(docs, items):
    got = set()
    for d, text in docs:
        for i, item in items:
            n = len(brute_words(item, False))
            if not n:
                continue
            size, short = min(n, 6), n < 6
            a, b = brute_words(text, short), brute_words(item, short)
            if n == 1 and len(a) != 1:
                continue
            hits = {}
            for p in range(len(b) - size + 1):
                x = b[p : p + size]
                for q in range(len(a) - size + 1):
                    y = a[q : q + size]
                    alike = [k for k, _ in x] == [k for k, _ in y] and all(k or u == v for (k, u), (_, v) in zip(x, y))
                    if alike and sum(k is None for k, _ in x) < (2 if short else 3):
                        alike = x == y
                    if alike:
                        hits.setdefault(q - p, []).append((p, [(u, v) for (k, u), (_, v) in zip(x, y) if k]))
            found = set()
            for ws in hits.values():
                values = {}
                for _, slots in ws:
                    if any(u != v for u, v in slots):
                        for u, v in slots:
                            values.setdefault(u, set()).add(v)
                found |= {p for p, slots in ws if all(u == v for u, v in slots) or all(len(values[u]) < 2 for u, _ in slots)}
            if len(found) >= 8 or found and len(found) / max(n - 5, 1) >= 0.5:
                got.add((d, i))
    return got


def test_leaks_equal_plain_python(spark):
    r = random.Random(6)
    vocabulary = "the a train leaves Berlin Munich Tom Anna has 3 5 10 km hours apples seven of . , and then walks home, Zug".split()
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice((1, 2, 3, 4, 5, 6, 7, 12, 20))))) for i in range(30)] + [(100, "Tom has 3 apples."), (101, "apples")]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.choice((1, 5, 30, 80))))) for i in range(60)]
    for k in range(40):
        text = r.choice(items)[1].split()
        text = [r.choice(("Hugo", "44", w)) if r.random() < 0.2 else w for w in text]
        docs.append((len(docs), " ".join([*r.choices(vocabulary, k=4), *text, "end"])))
    docs += [(500, "Anna has 5 apples."), (501, "apples"), (502, "Well, apples it is"), (503, None), (504, LONG)]
    got = {(x.doc_id, x.item_id) for x in decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_leaks([d for d in docs if d[0] != 504], items)
    assert got == want and {(500, 100), (501, 101)} <= got and (502, 101) not in got and len(got) > 30


def test_leaks_of_hostile_rows(spark, hostile):
    bench = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (None, None), (2, "")], "item_id long, text string")
    got = decontamination.find_leaks(hostile, bench).collect()
    assert [(x.doc_id, x.item_id) for x in got] == [(3, 1)]
    assert decontamination.without_leaks(hostile, bench).columns == hostile.columns and decontamination.without_leaks(hostile, bench).count() == hostile.count() - 2


# --- 6


def plain_states(p, emb):
    """Both directions' states of each word, number by number."""
    sig, n = lambda x: 1 / (1 + math.exp(-x)), toxicity.HIDDEN
    states = {}
    for d in "fb":
        h, out = [0.0] * n, {}
        for t in range(len(emb)) if d == "f" else reversed(range(len(emb))):
            x = emb[t] @ p[f"x{d}"] + p[f"c{d}"]
            u = [sum(h[j] * p[f"u{d}"][j][k] for j in range(n)) for k in range(3 * n)]
            z, r = [sig(x[k] + u[k]) for k in range(n)], [sig(x[n + k] + u[n + k]) for k in range(n)]
            c = [math.tanh(x[2 * n + k] + r[k] * u[2 * n + k]) for k in range(n)]
            out[t] = h = [c[k] + z[k] * (h[k] - c[k]) for k in range(n)]
        states[d] = out
    return [np.array(states["f"][t] + states["b"][t]) for t in range(len(emb))]


def plain_logit(p, rows):
    """Of one window's states."""
    e = [math.exp(toxicity.ENERGY * math.tanh(np.tanh(r @ p["a"]) @ p["v"] / toxicity.ENERGY)) for r in rows]
    return sum(w / sum(e) * r for w, r in zip(e, rows)) @ p["o"] + p["k"][0]


@pytest.fixture
def net():
    n = toxicity.Network(3)
    n.odds = np.random.default_rng(0).standard_normal(toxicity.CHAR_ROWS).astype(np.float32)
    for k in n.p:
        n.p[k] = n.p[k].astype(np.float64)
    return n


def test_every_window_is_scored_as_by_plain_loops(net):
    v, span, context, segment = toxicity.Vocabulary(), toxicity.SPAN, toxicity.CONTEXT, toxicity.SEGMENT
    r = random.Random(1)
    texts = v.ids([[f"word{r.randint(0, 30)}" for _ in range(n)] for n in (30, 3, 1, 2 * segment + 17, span, segment + 1)])
    emb = net.embed(toxicity.rows_of(list(v.number)))
    got, (starts, ends, owner) = net.logits(texts, net.inputs(emb))
    want = []
    for x in texts:
        states = []
        for core in range(0, len(x), segment):
            begin = max(0, core - context)
            states += plain_states(net.p, [emb[i] for i in x[begin : core + segment + context]])[core - begin :][:segment]
        want += [plain_logit(net.p, states[s : s + span]) for s in range(max(1, len(x) - span + 1))]
    assert len(got) == len(want) and np.abs(got - np.array(want)).max() < 1e-6
    assert (net.worst(texts, net.inputs(emb)) == [got[owner == i].max() for i in range(len(texts))]).all()


def test_gradients_equal_differences(net):
    v, r = toxicity.Vocabulary(), np.random.default_rng(2)
    line = np.concatenate(v.ids([[f"w{i % 9}" for i in range(40)], ["bad", "word"], ["w1", "w2", "bad"]]))
    tables = toxicity.rows_of(list(v.number))
    begin, end = np.array([0, 5, 40, 42]), np.array([20, 40, 42, 45])
    first, last = np.array([0, 11, 40, 42]), np.array([14, 23, 42, 45])
    y = np.array([0.0, 1.0, 0.0, 1.0])
    ids = toxicity.cut_out(line, begin, end)
    place = begin + np.arange(len(ids))[:, None]
    g = net.gradients(ids, (place >= first) & (place < last), y, tables)

    def loss():
        emb = net.embed(tables)
        z = [plain_logit(net.p, plain_states(net.p, [emb[i] for i in line[a:b]])[s - a : e - a]) for a, b, s, e in zip(begin, end, first, last)]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    for k, d in g.items():
        if isinstance(d, tuple):
            at = (int(d[0][r.integers(len(d[0]))]), int(r.integers(toxicity.DIM)))
            d = toxicity.summed(*d, len(net.p[k]))
        else:
            at = tuple(int(r.integers(n)) for n in d.shape)
        keep, h = net.p[k][at], 1e-4
        net.p[k][at] = keep + h
        up = loss()
        net.p[k][at] = keep - h
        down = loss()
        net.p[k][at] = keep
        assert abs((up - down) / (2 * h) - d[at]) < 1e-5, k


def test_a_toxic_word_counts_wherever_it_stands():
    r = random.Random(2)
    words = [f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta") for b in range(40)]
    texts = [" ".join([*r.choices(words, k=30), *(["nastyword"] if i % 2 else []), *r.choices(words, k=r.randint(0, 300))]) for i in range(240)]
    m = toxicity.train(texts, np.array([i % 2 for i in range(240)]))
    clean = r.choices(words, k=300)
    assert m.score([" ".join(clean)])[0] < 0.7
    assert all(m.score([" ".join([*clean[:at], "nastyword", *clean[at:]])])[0] >= 0.7 for at in (0, 1, 50, 97, 103, 104, 105, 110, 111, 207, 208, 299, 300))


def test_toxicity_defined_cases(spark, hostile):
    rows = [("plain words here", 0), ("a nasty one", 1), ("odd", 5), (None, 1)] * 30
    m = toxicity.fit_toxicity_model(spark.createDataFrame(rows, "text string, toxic long"))
    got = toxicity.score_toxicity(hostile, m).toPandas()
    assert len(got) == hostile.count() and got.score.between(0, 1).all() and got[got.text.isna()].score.eq(0).all()
    assert toxicity.score_toxicity(hostile.limit(0), m).count() == 0
    with pytest.raises(ValueError):
        toxicity.score_toxicity(hostile.withColumn("SCORE", F.lit(1)), m)
    labels = spark.createDataFrame([(4, 1), (4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    assert sorted((r.doc_id, r.toxic) for r in toxicity.labelled_sample(hostile, labels).select("doc_id", "toxic").collect()) == [(4, 1), (5, 0)]


# --- 7


def test_url_model_equals_plain_counts():
    strings = ["net/a", "net/ab", "org/b?x=1"]

    def chance(before, c):
        seen = [s[i] for s in padded for i in range(5, len(s)) if s[i - len(before) : i] == before]
        lower = chance(before[1:], c) if before else 1 / 128
        if not seen:
            return lower
        kinds = len(set(seen))
        return (seen.count(c) + kinds * lower) / (len(seen) + kinds)

    padded = ["\x02" * 5 + s + "\x03" for s in strings]
    m = urls.CharModel(strings)
    for s in ("net/a", "net/b", "zzz", "", "org/b?x=2"):
        t = "\x02" * 5 + s + "\x03"
        assert abs(m.mean(s) - sum(math.log(chance(t[i - 5 : i], t[i])) for i in range(5, len(t))) / (len(t) - 5)) < 1e-9


def test_verdicts_of_held_out_urls(spark, hostile):
    r = random.Random(2)
    bad, good = ["cheap-pills", "spam-farm", "win-big", "casino-x"], ["garden", "library", "museum", "school"]

    def url(kind, top):
        return f"http://www.{r.choice(bad if kind else good)}{r.randint(0, 99)}.{top}/p{r.randint(0, 999)}{r.choice(['?ref=spam', '#buy']) if kind else r.choice(['', '?page=2'])}"

    rows = [(i, url(1, "net")) for i in range(400)] + [(1000 + i, url(0, "org").replace("org/", "org/fr/")) for i in range(400)] + [(2000 + i, url(i % 2, "edu")) for i in range(400)]
    d = spark.createDataFrame(rows, "page_id long, url string")
    got = urls.judge_urls(d, urls.fit_url_model(d)).where("page_id >= 2000").toPandas()
    right = ((got.verdict == "block") == (got.page_id % 2 == 1)).mean()
    assert right >= 0.95 and got.rule.isna().all()
    odd = spark.createDataFrame([(1, None), (1, None), (None, "http://a.edu/x"), (2, "http://h.edu/" + "x" * 100_000), (3, "://"), (4, "http://")], "page_id long, url string").withColumn("verdict", F.lit("mine")).withColumn("host", F.lit(1))
    got = urls.judge_urls(odd, urls.fit_url_model(d)).toPandas()
    assert len(got) == 6 and got.verdict.isin(["allow", "block"]).all() and set(got.columns) == {"page_id", "host", "path", "rule", "verdict"}
    none = urls.judge_urls(odd, urls.fit_url_model(d.limit(0))).toPandas()
    assert none.verdict.eq("allow").all()


# --- 8


def page(r, i, prose):
    """A page in one of several layouts; what is its article is in <article>."""
    def text(n):
        return " ".join(r.choice(prose) for _ in range(n)).capitalize() + "."

    menu = "".join(f"<li><a href=/{k}>{r.choice(prose)}</a></li>" for k in range(r.randint(3, 9)))
    body = "".join(f"<p>{text(r.randint(2, 60))}</p>" if r.random() < 0.85 else f"<ul><li>{text(3)}</li><li>{text(2)}</li></ul>" for _ in range(r.randint(4, 12)))
    advert = f'<div class="ad">{text(9)}</div>'
    title = text(6)
    return f"<html><head><title>{title}</title></head><body><nav><ul>{menu}</ul></nav>{advert if i % 2 else ''}<article><h1>{title}</h1>{body}</article>{'' if i % 2 else advert}<aside>{text(4)}<ul>{menu}</ul></aside><footer>(c) {text(5)}</footer></body></html>"


def hidden(html):
    """The page without any name of a role."""
    return re.sub(' class="[^"]*"', "", re.sub(r"<(/?)(article|nav|aside|footer)\b", r"<\1div", html))


def test_main_text_with_all_roles_hidden(spark):
    r, prose = random.Random(5), [f"word{k}" for k in range(200)]
    pages = [page(r, i, prose) for i in range(400)]
    m = html_text.fit_block_model(spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages[:200])], "page_id long, url string, html string"))
    tp = fp = fn = 0
    for h in pages[200:]:
        want = [b.inside for b in html_text.blocks_of(h)]
        bs, title = html_text.blocks_of(hidden(h)), html_text.title_of(h)
        assert not any(b.inside or b.stated or b.named or b.far for b in bs)
        kept = m.kept(bs, title)
        tp += sum(k and w for k, w in zip(kept, want))
        fp += sum(k and not w for k, w in zip(kept, want))
        fn += sum(w and not k for k, w in zip(kept, want))
    assert 2 * tp / (2 * tp + fp + fn) >= 0.95


def test_names_and_wrappers_don_t_lose_articles(spark):
    r, prose = random.Random(6), [f"word{k}" for k in range(200)]
    pages = [page(r, i, prose) for i in range(150)]
    m = html_text.fit_block_model(spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages)], "page_id long, url string, html string"))
    s = "Here is a sentence of ordinary words, long enough to be read as prose by anyone who reads it at all, and it goes on."
    three, want = f"<h1>Title</h1><p>{s}</p><p>{s}</p><p>{s}</p>", "\n".join(["Title", s, s, s])
    menu = "<ul>" + "".join(f"<li><a href=x>m{i}</a></li>" for i in range(6)) + "</ul>"
    around = f"<body><nav>{menu}</nav>%s<footer>(c) f</footer></body>"
    for model in (m, html_text.BlockModel()):
        assert model.main_text(around % f'<div class="layout no-sidebar">{three}</div>') == want
        assert model.main_text(around % f'<div class="post comments-open">{three}</div>') == want
        assert model.main_text(f"<body><form><nav>{menu}</nav><article>{three}</article><footer>(c) f</footer></form></body>") == want
        assert model.main_text(f"<body><form><nav>{menu}</nav><div>{three}</div><footer>(c) f</footer></form></body>") == want
        assert model.main_text(around % f"<article><h1>Title</h1><p title=it's>{s}</p><p a='>' b=\">\">{s}</p><p>{s}</p></article>") == want
        assert model.main_text(around % f'<article>{three}</article><div class="comments"><div class="comment"><p>{s}</p></div><div class="comment"><p>{s}</p></div></div>') == want
        row = around % f"<article>{three}<table><tr><td>a 1</td><td>b 2</td></tr></table><p>{s}</p></article>"
        assert model.main_text(row) == f"{want}\na 1\nb 2\n{s}"
    bs = html_text.blocks_of(row.replace("a 1", "<a href=x>a 1</a>"))
    odds = m.log_odds(bs, set()) + [html_text.INSIDE * b.inside for b in bs]
    assert any(k and o < 0 for k, o in zip(m.kept(bs, set()), odds))  # the cut keeps the row's cells
    names = [html_text.INPUTS.index(x) for x in ("named", "named above", "vague", "stated")]
    assert (np.abs(m.weights[names]) < html_text.MOST).all()


def test_cut_turns_a_short_line_and_names_are_no_verdict():
    m, s = html_text.BlockModel(), "Here is a sentence of ordinary words, long enough to be read as prose by anyone."
    line = f"<div><p>{s}</p><p>{s}</p><div>Yes</div><p>{s}</p><p>{s}</p></div>"
    bs = html_text.blocks_of(line)
    assert m.log_odds(bs, set())[2] < 0 and all(m.kept(bs, set()))
    legal = f'<article><h1>A title</h1><p>{s}</p><section class="legal"><p>{s}</p></section><p id="tags">Tags are words.</p><p>{s}</p></article>'
    assert m.main_text(legal) == f"A title\n{s}\n{s}\nTags are words.\n{s}"
    crowd = f'<article><p>{s}</p><p>{s}</p></article><section id="comments">' + f"<p>{s}</p>" * 40 + "</section>"
    assert m.main_text(crowd) == f"{s}\n{s}"
    inner = f'<article><p>{s}</p><aside><p>Aside. {s}</p></aside><div class="ad">Ad. {s}</div><p>{s}</p></article>'
    assert m.main_text(inner) == f"{s}\n{s}"


def test_cut_of_a_long_page_is_quick():
    r = random.Random(1)
    html = "<div>" + "".join(f"<p>{'word ' * r.randint(1, 40)}.</p>" if r.random() < 0.6 else f"<ul><li><a href=x>{'link ' * r.randint(1, 6)}</a></li></ul>" for _ in range(10_000)) + "</div>"
    bs = html_text.blocks_of(html)
    joins = html_text.edges(bs)
    for scale in (8, 2, 0.5):
        odds = [r.gauss(0, scale) for _ in bs]
        began = time.process_time()
        html_text.labels(odds, joins)
        assert time.process_time() - began < 2


def test_cut_with_jumps_is_minimal():
    r = random.Random(19)
    for _ in range(150):
        n = r.randint(1, 9)
        odds = [r.choice((0.0, r.uniform(-3, 3))) for _ in range(n)]
        joins = [(i - 1, i, r.uniform(0, 2)) for i in range(1, n)] + [(a, b, r.uniform(0, 2)) for a in range(n) for b in range(a + 2, n) if r.random() < 0.3]
        cost = lambda k: sum(abs(o) for o, x in zip(odds, k) if (o > 0) != x) + sum(c for a, b, c in joins if k[a] != k[b])  # noqa: E731, B023
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_text.labels(odds, joins)) - best) < 1e-6


def test_pages_of_hostile_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>" + LONG), (2, "u", "<<<>>> < p"), (3, "u", "<article>" * 3000 + "deep"), (4, "u", "&#xZZ; &amp &#0; x")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine")).withColumn("n_chars", F.lit(1))
    got = html_text.extract_text(d, html_text.fit_block_model(d)).toPandas()
    assert len(got) == 6 and (got.n_chars == got.text.str.len()).all()


# --- 9

PATTERNS = [(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, True), (r"AKIA[A-Z0-9]+", 20, False), (r"[0-9a-f]+", 24, False)]


def brute_base(text):
    out = []
    for k, (p, least, group) in enumerate(PATTERNS):
        for m in re.compile(p, re.I | re.A if group else 0).finditer(text or ""):
            if len(m[2] if group else m[0]) >= least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_matching():
    r = random.Random(4)
    pieces = ["password", "PassWd", "secret", "token", "apikey", "API_KEY", '"', "'", " ", "=", ":", "abc", "123456", "AKIA", "AKIAAKIA", "ABCDEFGHIJKLMNOP", "0a" * 12, "ffff", "é", "ſecret", "\n", "-", "."]
    for _ in range(4000):
        t = "".join(r.choices(pieces, k=r.randint(0, 14)))
        assert secrets.base_spans(t) == brute_base(t), t


@pytest.fixture(scope="module")
def secret_model(spark):
    modules = (common, corpus_pipeline, decontamination, fingerprints, html_text, language, mixing, near_dedup, secrets, token_files, toxicity, urls, random, re, math, time)
    prose = [d for m in modules for d in (m.__doc__, *(getattr(f, "__doc__", None) for f in vars(m).values())) if d]
    rows = [(i, x) for i, d in enumerate(prose) for x in d.split("\n\n")]
    return secrets.fit_secret_model(spark.createDataFrame(rows, "doc_id long, text string"))


def test_secrets_and_identifiers_held_out(secret_model):
    m, r = secret_model, random.Random(77)
    random_ = secrets.random_strings(2_000, 1234) + ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=24)) for _ in range(200)]
    unseen = "budget calendar delivery engine festival garden holiday island journey kitchen library mountain notebook orchard painting quarter river station theatre umbrella village weather".split()
    ordinary = [s for s in secrets.ordinary_strings(unseen, 6_000, 4321) if len(s) >= secrets.LEAST_RUN][:3_000]
    caught, wrong = sum(map(m.is_secret, random_)), sum(map(m.is_secret, ordinary))
    assert caught / len(random_) >= 0.95 and caught / (caught + wrong) >= 0.95 and wrong / len(ordinary) <= 0.02
    for s in ("2024-10-11-annual-report-summary", "IMG_20240101_123456_backup", "customer_address_line_2_backup", "ORDER-2024-000123456-INVOICE", "f47ac10b-58cc-4372-a567-0e02b2c3d479", "-" * 40, "internationalization_of_words_here"):
        assert not m.is_secret(s), s


def test_secret_beside_a_base_span(secret_model):
    key = "q8Zx71LmPq0vTz9KdW3yB5nR"
    text = f"é {'0a' * 12}{key} and {key}+{'0f' * 15}"
    base = secrets.base_spans(text)
    got = secret_model.spans(text, base)
    assert [text[a:b] for a, k, b in got if k == 3] == [key, key + "+"] and [s for s in got if s[1] < 3] == base


def test_secrets_of_hostile_rows(hostile, secret_model):
    got = secrets.scan_secrets(hostile, secret_model).toPandas()
    assert len(got) == hostile.count() and got.n_hex.sum() == 0 and got.spans.eq("").all()


# --- 10


def spark_hash(words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=h)
    return h - (1 << 64) if h >> 63 else h


def brute_sketch(text, k=fingerprints.K):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    runs = [ws[i : i + 5] for i in range(max(1, len(ws) - 4))] if ws else []
    return sorted({spark_hash(x) for x in runs})[:k], len({tuple(x) for x in runs})


def test_sketches_equal_plain_python(spark):
    r = random.Random(8)
    texts = ["", None, "one", "one two three four", " ".join(f"w{r.randint(0, 50)}" for _ in range(40)), " ".join(f"w{i}" for i in range(900)), " ".join(f"w{i}" for i in range(450, 1200)), LONG]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x for x in d.select("doc_id", fingerprints.sketch(F.col("text")).alias("fp")).withColumn("n", fingerprints.distinct_count(F.col("fp"))).collect()}
    for i, t in enumerate(texts):
        fp, n = brute_sketch(t)
        assert got[i].fp == fp and (got[i].n == n if n < fingerprints.K else abs(got[i].n / n - 1) < 0.3)
    x = {y.doc_id: y.fp for y in got.values()}
    pairs = [(a, b) for a in x for b in x]
    p = spark.createDataFrame([(a, b, x[a], x[b]) for a, b in pairs], "i long, j long, a array<long>, b array<long>")
    for y in p.select("i", "j", fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprints.containment(F.col("a"), F.col("b")).alias("c")).collect():
        u = sorted({*x[y.i], *x[y.j]})[: fingerprints.K]
        want = sum(h in x[y.i] and h in x[y.j] for h in u) / len(u) if u else 1.0
        assert abs(y.r - want) < 1e-12
        small = y.i < 5 and y.j < 5
        if small and x[y.i]:
            assert abs(y.c - len({*x[y.i]} & {*x[y.j]}) / len(x[y.i])) < 1e-9
        elif not x[y.i]:
            assert y.c == 1.0


def test_edited_texts_equal_plain_python(spark, hostile):
    r = random.Random(9)
    rows = [(i, " ".join(r.choices(["a", "bb", "Ccc", "dé", "\U0001f600"], k=r.randint(0, 60)))) for i in range(60)] + [(100, None), (101, " x "), (102, "y" * 50)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in fingerprints.fingerprint_edits(d).collect()}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        m = len(t) // 4
        assert (got[i].fp, got[i].edited_fp, got[i].next_fp) == tuple(brute_sketch(x)[0] for x in (t, t[: len(t) - m] + nxt[:m], nxt))
    assert fingerprints.fingerprint_edits(hostile).count() == hostile.count()


# --- the pipeline


def test_pipeline_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    import public_tokenizers

    r = random.Random(21)
    said = {"en": "the and of is that with from have this they which would their what about".split(), "de": "der die und das nicht ist ein sich mit auf werden wurde eine durch".split()}
    rows = []
    for i in range(240):
        lang = "de" if i % 3 == 0 else "en"
        rows.append((i, " ".join(r.choice(said[lang]) + r.choice(("", "s", "t", "e")) for _ in range(r.randint(8, 60))), lang, ["s1", "s2", None][i % 3], 0))
    rows += [(300 + i, rows[i][1] + " ende" if len(rows[i][1]) > 250 else rows[i][1].upper(), rows[i][2], "s1", 0) for i in range(30)]
    item = "which would they have from that this and what is about their of with the"
    rows += [(400 + i, f"{rows[50 + i][1]} {item} {rows[90 + i][1]}", "en", "s2", 0) for i in range(5)]
    rows += [(500, None, "en", "s1", 0), (501, "", "en", "s1", 0), (502, "½ 12 !!", None, "s1", 0), (503, rows[4][1], "en", None, 0), (503, rows[4][1], "en", None, 0)]
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).assign(size="mine").to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame([(1, item), (2, None)], columns=["item_id", "text"]).to_parquet(tmp_path / "benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()

    kept = {i: (t, s) for i, t, _, s, _ in rows if t and any(map(str.isalpha, t))}
    sets = dict(zip(kept, brute_sets([t for t, _ in kept.values()])))
    root = {i: i for i in kept}
    for i in kept:
        for j in kept:
            if j < i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if x in (a, b) else x for k, x in root.items()}
    kept = {i: x for i, x in kept.items() if root[i] == i}
    leaks = {d for d, _ in brute_leaks([(i, t) for i, (t, _) in kept.items()], [(1, item)])}
    assert leaks
    documents = pd.DataFrame([(i, t, s) for i, (t, s) in kept.items() if i not in leaks], columns=["doc_id", "text", "source"])  # noqa: F841
    mix = duckdb.sql(mixing.OP1_SQL).df()
    words, taken = mix["size"].to_numpy(), mix.taken.to_numpy()
    want = [i for i, n in zip(mix.doc_id, taken // words) for _ in range(int(n))]
    assert sorted(got.doc_id) == sorted(want)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    long = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, (x, _) in kept.items()}
    got = got.sort_values("start")
    assert got.n_tokens.tolist() == [long[i] for i in got.doc_id] and got.doc_id.is_monotonic_increasing
    assert got.start.tolist() == [0, *np.cumsum(got.n_tokens.to_numpy())[:-1].tolist()]


def test_stages_take_empty_tables_and_odd_columns(spark, hostile, tmp_path):
    pd.DataFrame([(1, "one two three four five six seven")], columns=["item_id", "text"]).to_parquet(tmp_path / "benchmark.parquet")
    for docs in (hostile, hostile.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() >= 0 and (name == "token_files" or out.columns == docs.columns)


@pytest.mark.parametrize("few", [32, 2])
def test_crowd_rows_meet_on_their_rarest_shingles(spark, monkeypatch, few):
    """Every link between components is found, whether groups make pairs or blocks; a common passage alone makes none."""
    monkeypatch.setattr(near_dedup, "FEW", few)
    r = random.Random(3)
    common_words = " ".join(f"licence{i}" for i in range(60))
    rows = []
    for i in range(60):
        own = [f"w{r.randrange(10**6)}" for _ in range(r.choice([4, 8, 12, 20, 30]))]
        rows.append((2 * i, " ".join(own) + " " + common_words))
        cut = r.randrange(12)
        rows.append((2 * i + 1, " ".join(own) + " " + common_words[: len(common_words) - 11 * cut] + (" end" if i % 3 else "")))
    sets = {i: near_dedup.shingle_set(t) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and near_dedup.linked(sets[a], sets[b])}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    crowds = docs.select(F.lit(1).cast("long").alias("crowd"), F.col("doc_id").alias("node"))
    none = spark.createDataFrame([], "node long, root long")
    got = {tuple(x) for x in near_dedup.crowd_links(crowds, docs, "doc_id", "text", none).collect()}
    assert got == want and len(want) > 30


def test_small_tables_are_few_files_and_settled_components_are_left_alone(spark, monkeypatch):
    """However many partitions a shuffle has; more links are worked on between roots only."""
    r = random.Random(5)
    conf = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old, made, put = {k: spark.conf.get(k) for k in conf}, [], components.stash
    monkeypatch.setattr(components, "stash", lambda df, name, *rows: made.append((name, x := put(df, name, *rows), len(x.inputFiles()))) or x)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(40)]
    more = [(r.randrange(600), r.randrange(600)) for _ in range(60)] + [(440, 3)]
    d = lambda x: spark.createDataFrame(x, "a long, b long")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        roots = components.components(d(edges))
        got = {tuple(x) for x in components.joined(roots, d(more)).collect()}
        assert got == {tuple(x) for x in components.components(d(edges + more)).collect()} and len(made) > 8
        assert max(n for _, _, n in made) <= common.LEAST_PARTS
        made.clear()
        assert {tuple(x) for x in components.components(d([(9, 1), (1, 8), (5, 4)])).collect()} == {(9, 1), (8, 1), (5, 4)} and len(made) == 1
        assert components.joined(roots, d([])).count() == roots.count() and components.joined(d([]).toDF("node", "root"), d([(2, 1)])).collect() == [(2, 1)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_texts_that_share_a_passage_make_no_groups(spark):
    r = random.Random(4)
    passage = " ".join(f"licence{i}" for i in range(100))
    rows = [(i, i, " ".join(f"w{r.randrange(10**9)}" for _ in range(r.randrange(30, 60))) + " " + passage) for i in range(400)]
    texts = spark.createDataFrame(rows, "node long, root long, text string")
    keys = near_dedup.rare_keys(texts)
    assert keys.count() > 0 and near_dedup.rare_groups(keys).count() == 0
