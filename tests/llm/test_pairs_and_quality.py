"""Operators 11 to 13 against brute force, held-out labels and hostile rows; their queries by name."""

import hashlib
import random
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyforge.llm import common, hard_negatives, near_dedup, quality, token_alignment

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers

    return tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))


def test_sample_fills_up_with_distinct_rows_beside_copies(spark):
    d = spark.range(1_000_000).select(F.lit("x").alias("label"), F.when(F.col("id") < 1_000, F.col("id")).otherwise(-1).alias("v"))
    got = common.hashed_sample(d, "label", 800)
    assert got.count() == got.distinct().count() == 800


# token alignment

ODD = [" ", "  ", "   ", "\n", "\t", "a", "b", "Th", "ing", "é", "ñ", "½", "　", "\xa0", "\x85", "\x1c", "'s", "'ll", "1", "23", "<|endoftext|>", "</s>", "<0x41>", "▁", ".", "!!", "***", "漢", "🙂", "​", " the", "x" * 600]


def plain_alignment(text, t):
    """(a ids, b ids, groups, links) by loops over whole texts; None without tokens."""
    if not text:
        return None
    a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
    data = (" " + text).encode()
    if not b"".join(t.bytes_a[i] for i in a) == data == b"".join(t.bytes_b[i] for i in b):
        return None
    end_a, end_b = (np.cumsum([len(known[i]) for i in ids]).tolist() for ids, known in ((a, t.bytes_a), (b, t.bytes_b)))
    groups, i, j = [], 0, 0
    for end in sorted({*end_a} & {*end_b}):
        k, m = end_a.index(end) + 1, end_b.index(end) + 1
        groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
        i, j = k, m
    links = [(x, y) for p, x in enumerate(a) for q, y in enumerate(b) if max(end_a[p - 1] if p else 0, end_b[q - 1] if q else 0) < min(end_a[p], end_b[q])]
    return a, b, groups, links


def plain_rows(texts, t):
    found = [plain_alignment(x, t) for x in texts]
    n = {}
    for f in found:
        for pair in set(f[3]) if f else ():
            n[pair] = n.get(pair, 0) + 1
    most = {}
    for (a, _), k in n.items():
        most[a] = max(most.get(a, 0), k)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = f
            best = sum(n[p] == most[p[0]] for p in links)
            out.append((len(a), len(b), len(groups), len(links), best, sum(n[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def odd_texts(seed, n):
    r = random.Random(seed)
    return [None, "", " ", "   ", "▁", "a ▁b", *("".join(r.choice(ODD) for _ in range(r.randint(1, 14))) for _ in range(n))]


@pytest.mark.parametrize("most_pairs", [token_alignment.MOST_PAIRS, 0])
def test_alignment_equals_plain_loops(spark, tokenizers, most_pairs):
    texts = odd_texts(3, 300) * 2 + ["word " * 5_000]
    rows = [(i if i % 7 else None, t, "x", "y") for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, pairs string, n string").repartition(5)
    got = token_alignment.align_tokens(d, tokenizers, most_pairs=most_pairs).collect()
    t = token_alignment.Tokenizers.at(*tokenizers)
    # loops over pairs of tokens are too slow for the long text; a short one has the same pairs
    want = plain_rows([*texts[:-1], "word word "], t)[:-1]
    long = next(r for r in got if r.doc_id == len(texts) - 1)
    assert long.n_a == len(t.a.encode(" " + texts[-1], add_special_tokens=False).ids) and long.n_links == long.n_a + long.n_b - long.n_groups
    have = sorted([tuple(r) for r in got if r.doc_id != len(texts) - 1], key=lambda r: str(r))
    assert have == sorted([(rows[i][0], *w) for i, w in enumerate(want)], key=lambda r: str(r))
    assert token_alignment.align_tokens(d.limit(0), tokenizers, most_pairs=most_pairs).count() == 0


def test_printed_groups_have_the_digest(spark, tokenizers):
    d = spark.createDataFrame([(1, "The quick  brown\nfox"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in token_alignment.align_tokens(d, tokenizers, groups=True).collect()}
    assert hashlib.sha256(got[1].groups.encode()).hexdigest() == got[1].groups_sha256 and got[1].groups.count(";") == got[1].n_groups - 1
    assert (got[2].groups, got[2].groups_sha256) == ("", "")


def test_gallop_is_a_search_in_every_block(monkeypatch):
    r = np.random.default_rng(4)
    monkeypatch.setattr(token_alignment, "BLOCK", 7)
    for n, m in ((0, 5), (1, 1), (40, 4_000), (300, 310)):
        long = np.sort(r.choice(10_000, m, replace=False))
        short = np.sort(r.choice(10_000, n, replace=False).clip(0, long[-1]))
        assert (token_alignment.gallop(short, long) == np.searchsorted(long, short)).all()


def test_units_are_forgotten_and_met_again(spark, tokenizers, monkeypatch):
    texts = odd_texts(8, 400)
    t = token_alignment.Tokenizers.at(*tokenizers)
    units = token_alignment.Units(t)
    monkeypatch.setattr(token_alignment, "REMEMBER", 30)
    for i in range(0, len(texts), 20):
        for text, n in zip(texts[i : i + 20], units.numbers(texts[i : i + 20])):
            want = plain_alignment(text, t)
            assert (n is None) == (want is None)
            if n is not None:
                assert units.counts[n].sum(0).tolist() == [len(x) for x in want]
                assert ";".join(units.groups[k] for k in n) == ";".join(want[2])
    assert len(units.known) < 400


# hard negatives


def plain_negatives(rows, anchor):
    """By sorting all rows for each anchor."""
    r = [(i, k, np.floor(np.array(v, float) * 256)) for i, k, v in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, _, v in r), default=0)
    r = [(i, k, np.append(v, np.zeros(dim - len(v)))) for i, k, v in r]
    out = []
    for n, (i, k, v) in enumerate(r):
        if i is None or not anchor(i):
            continue
        s = [(-int(v @ w), j is None, j, m == k) for x, (j, m, w) in enumerate(r) if x != n]
        s.sort(key=lambda t: (t[0], t[1], t[2] or 0))
        for ps, _, p, _ in [t for t in s if t[3]][:5]:
            fit = [t for t in s if not t[3] and 80 * -ps <= 100 * -t[0] <= 100 * -ps][:5]
            out += [(i, p, rank + 1, t[2], -ps, -t[0]) for rank, t in enumerate(fit)]
    return sorted(out, key=str)


def vectors(seed, n, dim):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)) + 2.5 * r.normal(size=(4, dim))[r.integers(0, 4, n)]
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).tolist()


def negatives_of(d, **more):
    got = hard_negatives.hard_negatives(d, F.col("vec_id") % 10 == 0, **more)
    return sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def test_negatives_equal_sorting_with_copies_ties_and_small_shards(spark, monkeypatch):
    for name, k in {"SEED": 60, "SHARDS": 5, "SHARD": 100, "CLUSTERS": 4, "ROWS": 16, "ANCHORS": 7, "HELD": 50}.items():
        monkeypatch.setattr(hard_negatives, name, k)
    v = vectors(1, 400, 7)
    rows = [(i, i % 3, v[i]) for i in range(400)]
    rows += [(1_000 + i, i % 2, v[7]) for i in range(300)] + [(2_000 + i, 1, v[11]) for i in range(40)]  # one vector holds a third
    rows += [rows[0], rows[0], rows[20], (None, 0, v[5]), (None, 1, v[5]), (40, 2, v[41])]
    d = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, label int, embedding array<float>, q string, cell string").repartition(6)
    assert negatives_of(d) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_cells_are_visited_in_descending_bounds_and_cut_off(spark):
    v = np.array(vectors(2, 3_000, 4))
    q = np.floor(v * 256)
    d = hard_negatives.Directory(hard_negatives.codebook(q[:, :2]), hard_negatives.codebook(q[:, 2:]))
    cell, d1, d2 = d.cell(q)
    found = [type("R", (), {"cell": int(c), "n": int((cell == c).sum()), "d1": d1[cell == c].max(), "d2": d2[cell == c].max()}) for c in np.unique(cell)]
    d.learn(found)
    walked = list(d.walk(d.bounds(q[3])[0]))
    assert [b for b, _ in walked] == sorted((b for b, _ in walked), reverse=True) and {c for _, c in walked} == {*cell.tolist()}
    score = q @ q[3]
    for bound, c in walked:
        assert score[cell == c].max() <= bound
    floor = np.sort(score)[-10]
    seen = {*d.visited(q[3], False, -np.inf, np.inf)} | {*d.visited(q[3], True, floor, np.inf)}
    assert {*cell[score >= floor].tolist()} <= seen and len(seen) < len(walked)


def test_negatives_of_hostile_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.5]), (2, 2, [0.9, 0.4]), (3, 2, [0.8]), (4, None, [1.0, 1.0]), (5, 1, None), (6, 2, [nan, 1.0]), (7, 2, [1.0, None]), (8, 2, [inf, 0.0]),
        (10, 3, []), (20, 1, [-1.0, 0.0]), (30, 2, [0.9, 0.5]), (None, 2, [0.9, 0.5]), (40, 9, [0.1, 0.1]), (9, 1, [0.9, 0.5, 0.0]),
    ]
    d = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert negatives_of(d) == plain_negatives(rows, lambda i: i % 10 == 0)
    assert negatives_of(d.limit(0)) == []
    assert negatives_of(d.where("label IS NULL")) == []
    huge = [(0, 1, [1e30, 3.0]), (1, 1, [1e30, 2.0]), (2, 2, [0.9e30, 1.0])]
    got = negatives_of(spark.createDataFrame(huge, "vec_id long, label int, embedding array<float>"))
    assert [r[:4] for r in got] == [(0, 1, 1, 2)] and 0 < got[0][5] <= got[0][4] < 2**63


# quality


def prose(r, bad):
    ws = ["".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 200))]
    kind = r.randrange(3)
    if not bad:
        return " ".join(ws)
    return " ".join(ws).upper() if kind == 0 else " ".join(w + "###" for w in ws) if kind == 1 else " ".join([ws[0]] * 80)


@pytest.fixture(scope="module")
def quality_model(spark):
    r = random.Random(1)
    rows = [(prose(r, i % 4 == 0), int(i % 4 > 0)) for i in range(600)]
    return quality.fit_quality_model(spark.createDataFrame(rows, "text string, label int"), (150.0, 450.0))


def test_quality_of_held_out_texts(quality_model):
    r = random.Random(2)
    good, bad = ([quality_model.score(prose(r, b)) for _ in range(200)] for b in (False, True))
    assert np.mean(np.array(good) >= quality.THRESHOLD) > 0.95 and np.mean(np.array(bad) < quality.THRESHOLD) > 0.9


def test_difference_equals_sizes_by_hand(quality_model):
    import zstandard

    text = "Some words to squeeze. " * 100
    sizes = []
    for d in (quality_model.good, quality_model.bad):
        z = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append(sum(len(z.compress(text.encode()[i : i + quality.PIECE])) for i in range(0, len(text), quality.PIECE)))
    assert quality_model.inputs(text)[0] == pytest.approx((sizes[1] - sizes[0]) / max(sizes))


def test_curve_is_calibrated():
    r = np.random.default_rng(3)
    x = r.normal(size=(20_000, 2))
    y = (r.random(20_000) < 1 / (1 + np.exp(-(1 + 2 * x[:, 0])))).astype(int)
    w = quality.fit_curve(x, y, np.ones(len(y)))
    assert np.allclose(w, [1, 2, 0], atol=0.1)


def test_quality_of_hostile_rows(spark, quality_model):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "x"), (None, "short", "x"), (3, "word " * 200_000, "x"), (4, "\x00 🙂", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = quality.score_quality(d, quality_model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if not r.text}) == 1
    assert quality.score_quality(d.limit(0), quality_model).count() == 0
    with pytest.raises(ValueError):
        quality.score_quality(d.withColumnRenamed("label", "SCORE"), quality_model)
    none = spark.createDataFrame([], "text string, label int")
    assert quality.fit_quality_model(none, (0.0, 0.0)).score("x") == 0.5
    one = spark.createDataFrame([("good text", 1), ("more", 1), (None, 1), ("none", None)], "text string, label int")
    assert quality.fit_quality_model(one, (0.0, 2.0)).score("x") > 0.999
    few = spark.createDataFrame([("good text", 1), ("BAD!!", 0)], "text string, label int")
    assert 0 <= quality.fit_quality_model(few, (1.0, 1.0)).score("good text") <= 1
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (2, 0), (99, 1), (None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    assert sorted((r.text or "", r.label) for r in quality.labelled_sample(d.select("doc_id", "text"), labels).distinct().collect()) == [("", 0), ("", 0), ("", 1)]
    assert quality.label_shares(labels) == (2.0, 4.0)


# the queries by name


def test_queries_by_name(spark):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    n = duck.sql("select count(*) from documents").fetchall()[0][0]
    q = entry.queries()
    x = q["op11_token_alignment"](spark, DIR)
    assert x.columns[:7] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"] and x.count() == n
    assert dict(x.dtypes)["n_best"] == "bigint"
    y = q["op13_quality"](spark, DIR)
    assert y.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = y.toPandas()
    import zlib

    assert len(rows) == n and (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= 0.3)).all()
    assert dict(q["op12_hard_negatives"](spark, DIR).dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}


def test_a_worker_keeps_no_words_of_earlier_texts():
    near_dedup.shingle_set("a b c d e f")
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for i in range(2000):
        near_dedup.shingle_set(" ".join(f"rare{i}x{j}" for j in range(20)))
    kept = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert kept < 500_000
