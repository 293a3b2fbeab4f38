"""Defined cases and brute-force versions of the training-data operators."""

import hashlib
import pickle
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import components, decontamination, fingerprints, html_text, language, mixing, near_dedup, secrets, token_files, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, h string, id string, text2 string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def words(seed, n):
    r = random.Random(seed)
    return [r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    base = words(1, 200)
    texts = [None, "", "   \n ", "one two", "one  two", "One Two", " ".join(base), " ".join(base), " ".join(base[:196] + words(2, 4)), " ".join(words(3, 20_000)), "a\tb c d \x1c e"]
    rows = [(i, t, "en" if i % 2 else None, [None, "a", "b"][i % 3], None, "x", "y", "z", "w", "v") for i, t in enumerate(texts)]
    rows += [rows[6], (None, "no id", None, "a", None, *"xyzwv"), (None, None, None, None, None, *"xyzwv")]
    return spark.createDataFrame(rows, SCHEMA)


def empty(df):
    return df.limit(0)


def test_mix_defined_cases(docs):
    x = mixing.mix(docs).toPandas()
    assert len(x) == docs.count() and (x["taken"] <= 3 * x["size"]).all() and (x["target"] <= 3 * x["source_size"]).all()
    assert abs(x.drop_duplicates(["source"])["target"].sum() - x["size"].sum()) < 1e-6
    assert mixing.mix(empty(docs)).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def brute_components(rows):
    sets = {i: near_dedup.shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and near_dedup.linked(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates_equal_brute_force(spark, docs):
    r = random.Random(5)
    rows, base = [], [words(s, r.randint(6, 120)) for s in range(60)]
    for i in range(400):
        w = list(r.choice(base))
        for _ in range(r.randint(0, max(1, len(w) // 25))):
            w[r.randrange(len(w))] = "changed" + str(r.randint(0, 999))
        rows.append((i, " ".join(w)))
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    x = near_dedup.near_duplicates(docs).toPandas()
    assert len(x) == docs.count() and x[x.doc_id.isin([6, 7, 8])].component_id.eq(6).all() and x[x.doc_id.isin([3, 4, 5])].component_id.eq(3).all()
    assert x[x.doc_id == 0].kept.all() and x[x.doc_id == 0].n_shingles.iloc[0] == 0
    assert near_dedup.near_duplicates(empty(docs)).count() == 0
    assert near_dedup.first_of_groups(docs).columns == docs.columns


def test_hub_of_many_near_copies_is_one_group(spark):
    r, base = random.Random(8), words(11, 300)
    texts = [" ".join(base)]
    for i in range(2000):
        w = list(base)
        for k in range(8):
            w[r.randrange(10, 290) if k else 20] = f"other{i}x{k}"
        texts.append(" ".join(w))
    sets = [near_dedup.shingle_set(t) for t in texts]
    like = {i for i in range(1, len(sets)) if near_dedup.linked(sets[0], sets[i])}
    assert len(like) > 1500 and not any(near_dedup.linked(sets[a], sets[b]) for a, b in zip(sorted(like), sorted(like)[1:]))
    d = spark.createDataFrame([(i, texts[i]) for i in [0, *sorted(like)]], "doc_id long, text string")
    assert {x.component_id for x in near_dedup.near_duplicates(d).collect()} == {0}


def test_components_go_on_until_nothing_changes(spark, monkeypatch):
    monkeypatch.setattr(components, "ROUNDS", 1, raising=False)
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {(r.node, r.root) for r in components.components(chain).collect()} == {(i, 0) for i in range(1, 41)}


def test_tokens_round_trip(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = token_files.tokens_of(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).orderBy("doc_id").collect()
    start = 0
    for row, (i, text) in zip(got, sorted({(r.doc_id, r.text or "") for r in docs.where("doc_id IS NOT NULL").collect()})):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.tokens_of(docs).count() == docs.count()
    assert token_files.tokens_of(empty(docs)).count() == 0


def test_encoder_on_odd_texts():
    import public_tokenizers

    e = token_files.Encoder.at(public_tokenizers.path("byte_bpe_50k.json"))
    for s in ("it's  a\n\ntest \n x", "a\t\n b", "naïve²5 αβγ aα, b", " <|endoftext|> x", "word<|endoftext|>word", " x \x1c y", "  ", "\n", "don't'll éa", "x   y"):
        assert e.encode(s) == e.whole(s), repr(s)


@pytest.mark.parametrize("bits", [False, True])
def test_planes(bits):
    ids = np.random.default_rng(0).integers(0, 1 << 32, 40_001, np.uint64).astype("<u4")
    assert token_files.unpacked(token_files.packed(ids.tobytes(), bits)) == ids.tobytes()


def test_language(spark, docs):
    de, en = "der die das und ist ein nicht mit", "the and of is a not with that"
    rows = [(i, " ".join(random.Random(i).choices((de if i % 2 else en).split(), k=12)), "de" if i % 2 else "en") for i in range(200)]
    m = language.fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.predict("und das ist nicht der")[0] == "de" and m.predict("that is not the") [0] == "en"
    assert m.predict(None) == ("und", 0.0) and m.predict("12 34 !") == ("und", 0.0)
    assert language.predict_language(docs, m).count() == docs.count()
    none = language.fit_language_model(empty(docs))
    assert none.predict("words") == ("und", 0.0)
    assert language.accepted(docs, m).columns == docs.columns


def test_long_text_grams_are_those_of_the_whole():
    text = "abc déf " * 40
    old, language.PIECE = language.PIECE, 37
    try:
        cut = language.gram_counts(text)
    finally:
        language.PIECE = old
    assert (cut == language.gram_counts(text)).all()


def test_leaks(spark):
    item = "The train leaves Berlin at 10 km per hour and arrives in Munich after 20 hours of steady travel through hills"
    same = "some words before it. " + item + " and some words after it"
    other = same.replace("10", "35").replace("20", "44").replace("Berlin", "Hamburg").replace("Munich", "Dresden")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short")], "item_id long, text string")
    d = spark.createDataFrame([(1, same), (2, other), (3, "nothing here at all"), (4, None), (5, "it is too short")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.exact for r in decontamination.find_leaks(d, bench).collect()}
    assert got == {(1, 1): True, (2, 1): False, (5, 3): True}
    assert [r.doc_id for r in decontamination.without_leaks(d, bench).orderBy("doc_id").collect()] == [3, 4]
    assert decontamination.find_leaks(d, bench.limit(0)).count() == 0 and decontamination.find_leaks(d.limit(0), bench).count() == 0


def test_leaks_with_torn_and_merged_slots(spark):
    twice = "The red lorry took 10 large boxes to the old harbour before noon and then it brought back the other 10 small boxes after a long and quiet rest at home"
    merged = "There are 3 boys and 4 girls in the class who each bring a small lunch to school"
    bench = spark.createDataFrame([(1, twice), (2, merged)], "item_id long, text string")
    d = [(1, twice.replace("other 10", "other 12")), (2, merged.replace("3", "5").replace("4", "5")), (3, "There are 3 boys and nothing else")]
    near = "A cat saw 7 dogs and 7 birds run home"
    d += [(4, near.replace("7 dogs", "8 dogs").replace("7 birds", "9 birds"))]
    bench = bench.unionByName(spark.createDataFrame([(4, near)], "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.exact for r in decontamination.find_leaks(spark.createDataFrame(d, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1): False, (2, 2): False}


def test_toxicity(spark, docs):
    r = random.Random(3)
    rows = []
    for i in range(300):
        w = words(i, r.randint(5, 60))
        if i % 3 == 0:
            w[r.randrange(len(w))] = "nastyword"
        rows.append((" ".join(w), int(i % 3 == 0)))
    m = toxicity.fit_toxicity_model(spark.createDataFrame(rows, "text string, toxic int"))
    s = m.score([t for t, _ in rows])
    assert ((s >= 0.7).astype(int) == np.array([y for _, y in rows])).mean() > 0.95
    assert m.score([None, "", " ; "]).tolist() == [0, 0, 0]
    assert toxicity.score_toxicity(docs, m).count() == docs.count()
    assert toxicity.fit_toxicity_model(spark.createDataFrame([], "text string, toxic int")).score(["x"]).tolist() == [0]


def test_urls(spark):
    rows = [(1, "http://A.Example.NET/en/x?q#f"), (2, "https://b.net/de"), (3, "http://example.com/de/1"), (4, "http://x.org/fr/"), (5, None), (6, "no scheme"), (7, "http://www.net"), (8, "http://notexample.net/en/"), (9, "ftp://q.example.org?x")]
    d = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.judge_urls(d, urls.fit_url_model(d)).collect()}
    assert got == {1: ("a.example.net", "/en/x", "example.net/en/"), 2: ("b.net", "/de", "net/"), 3: ("example.com", "/de/1", "example.com/de/"), 4: ("x.org", "/fr/", "org/fr/"), 5: ("", "", None), 6: ("", "", None), 7: ("www.net", "", None), 8: ("notexample.net", "/en/", "net/"), 9: ("q.example.org", "", None)}
    assert urls.judge_urls(d.limit(0), urls.fit_url_model(d.limit(0))).count() == 0


def test_url_threshold_hears_all_hosts():
    r = random.Random(4)
    allowed = sorted([f"a{i:04}.org/en/list" for i in range(2500)] + [f"z{i:04}.net/{r.choice(['news', 'shop'])}/{r.randint(0, 999)}" for i in range(2500)])
    blocked = sorted([f"a{i:04}.com/xx/casino" for i in range(2500)] + [f"z{i:04}.net/{r.choice(['news', 'bets'])}/{r.randint(0, 999)}" for i in range(2500)])
    m = urls.UrlModel(allowed, blocked)
    scored = [(m.difference(s), y) for y, xs in ((1, allowed[1::2]), (0, blocked[1::2])) for s in xs]
    assert m.threshold == urls.calibrated(scored)


def test_every_decided_url_is_counted_and_calibrates(spark):
    r = random.Random(6)
    rows = [(i, f"http://h{r.randrange(500)}.org/fr/{i}") for i in range(14_000)] + [(i, f"http://h{r.randrange(500)}.net/{i}") for i in range(12_000)]
    d = spark.createDataFrame(rows + rows[:500], "page_id long, url string")
    m = urls.fit_url_model(d)
    half = {x.whole for x in d.select(F.col("url").alias("whole")).distinct().where("pmod(xxhash64(whole), 2) = 0").collect()}
    allow, block = (sorted({u for _, u in some}) for some in (rows[:14_000], rows[14_000:]))
    for kind, xs in ((m.allow, allow), (m.block, block)):
        plain = urls.CharModel([u for u in xs if u in half])
        assert all((getattr(kind, c) == getattr(plain, c)).all() for c in ("counts", "total", "kinds"))
    sent = pickle.dumps(m)
    assert pickle.loads(sent).verdicts(allow[:50] + block[:50]) == m.verdicts(allow[:50] + block[:50]) and len(sent) < 5_000_000
    scored = [(x, y) for y, xs in ((1, allow), (0, block)) for x in m.differences([u for u in xs if u not in half])]
    assert len(scored) > 12_000 and abs(m.threshold - urls.calibrated(scored)) < 1e-9
    few = [(round(r.gauss(y, 1), 3), bool(y)) for y in (0, 1) for _ in range(300)]
    one_each = list({x: (x, y) for x, y in few}.values())
    assert abs(urls.threshold_of(spark.createDataFrame(one_each, "x double, allow boolean")) - urls.calibrated([(x, int(y)) for x, y in one_each])) < 1e-9
    assert urls.threshold_of(spark.createDataFrame([(1.0, True)], "x double, allow boolean")) == 0


def test_whole_urls_are_judged(spark):
    rows = [(i, f"http://h{i % 9}.net/p{i % 7}?{'ad' if i % 2 else 'bid'}={i}#x") for i in range(200)]
    rows += [(1000 + i, f"http://h{i % 9}.org/fr/p{i % 7}?page={i}#x") for i in range(200)]
    m = urls.fit_url_model(spark.createDataFrame(rows, "page_id long, url string"))
    m.threshold = 0.0
    ask = [(1, "http://H.Example.edu/P?page=12#x"), (2, "http://H.Example.edu/P?bid=12#x"), (3, "h.edu/p?bid=12#x"), (4, None), (5, "")]
    d = spark.createDataFrame(ask, "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.verdict) for r in urls.judge_urls(d, m).collect()}
    assert [got[i][2] for i in (1, 2, 3, 4, 5)] == ["allow", "block", "block", "allow", "allow"]
    assert got[1][:2] == ("h.example.edu", "/P") and got[3][:2] == ("", "")
    assert d.select(urls.whole(F.col("url")).alias("u")).first().u == "http://h.example.edu/P?page=12#x"


def test_html(spark):
    html = """<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies on this site.</div>
    <article><h1>A  title</h1><p>First &amp; long paragraph of the text, with words.<p>Second&nbsp;one <a href=y>with a link</a> inside it.<div class="ad">Buy this thing now.</div>
    <p>Third paragraph, again with enough words.</p></article><section id="comments"><p>I do not agree with this text at all.</p></section><footer>Foot</footer><script>var a="<p>no</p>"</script>"""
    d = spark.createDataFrame([(1, "u", html), (2, None, None), (3, "v", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_text(d, html_text.fit_block_model(d)).collect()}
    want = "A title\nFirst & long paragraph of the text, with words.\nSecond one with a link inside it.\nThird paragraph, again with enough words."
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0)}
    assert html_text.extract_text(d.limit(0), html_text.fit_block_model(d.limit(0))).count() == 0


def test_cut_is_minimal():
    r = random.Random(9)
    for _ in range(50):
        n = r.randint(1, 8)
        odds = [r.uniform(-2, 2) for _ in range(n)]
        joins = [(i - 1, i, r.uniform(0, 2)) for i in range(1, n)]
        cost = lambda k: sum(-o if o < 0 and x else o if o > 0 and not x else 0 for o, x in zip(odds, k)) + sum(c for a, b, c in joins if k[a] != k[b])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_text.labels(odds, joins)) - best) < 1e-6


def test_secrets(spark, docs):
    key, rnd = "AKIA" + "ABCDEFGHIJ123456", "q8Zx71LmPq0vTz9KdW3yB5nR"
    text = f'password = "hunter22" TOKEN:abc token:abcdef {key} {"0a" * 12} see {rnd} and internationalization_of_words_here'
    d = spark.createDataFrame([(1, text), (2, None), (3, "plain words only")], "doc_id long, text string")
    m = secrets.fit_secret_model(docs.select("doc_id", "text").unionByName(d))
    got = {r.doc_id: r for r in secrets.scan_secrets(d, m).collect()}
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex) == (2, 1, 1)
    assert "markov" in got[1].spans and got[1].spans.count("markov") == 1 and got[3].spans == ""
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.scan_secrets(docs.limit(0), m).count() == 0


def test_fingerprints(spark, docs):
    rows = [(3, "x" * 9), (1, " ".join(words(1, 50))), (2, None), (5, " ".join(words(1, 50)))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(d).collect()}
    order = sorted((i, t or "") for i, t in rows)
    for k, (i, t) in enumerate(order):
        m, nxt = len(t) // 4, order[(k + 1) % len(order)][1]
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest() and got[i].n_chars == len(t)
    assert got[1].fp == got[5].fp and got[2].fp == []
    x = docs.select(F.lit(1).alias("g"), fingerprints.sketch(F.col("text")).alias("fp"))
    merged = fingerprints.merge_sketches(x, ["g"], "fp").first().fp
    assert merged == sorted({h for r in x.collect() for h in r.fp})[: fingerprints.K]
    assert fingerprints.fingerprint_edits(docs).count() >= docs.distinct().count() and fingerprints.fingerprint_edits(empty(docs)).count() == 0
