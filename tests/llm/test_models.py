"""Whitening, the quality classifier and spelling variants against brute force, with odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from sparkweave.llm import gam, spelling, whitening
from sparkweave.llm import _blocks as B
from sparkweave.llm import queries as LQ

VECTORS = "vec_id long, embedding array<double>, label int, component string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], VECTORS)


def whitening_by_hand(rows, most=32):
    """Plain Python integers and numpy: {(vec_id, component): (deviation, |whitened|)}, explained."""
    x = [(i, [int(np.floor(c * 64)) + 1_000_000 for c in v]) for i, v in rows]
    n, d = len(x), len(x[0][1])
    s = [sum(v[k] for _, v in x) for k in range(d)]
    z = [[n * v[k] - s[k] for k in range(d)] for _, v in x]
    cov = np.array([[sum(r[a] * r[b] for r in z) / n**3 for b in range(d)] for a in range(d)])
    e, p = np.linalg.eigh(cov)
    e, p = e[::-1][:most], p[:, ::-1][:, :most]
    w = (np.array(z, float) / n) @ p / np.sqrt(e)
    return Counter((i, k + 1, sum(c * c for c in r), round(abs(float(w[m, k])), 6)) for m, ((i, _), r) in enumerate(zip(x, z)) for k in range(len(e))), e / np.trace(cov)


def test_whitening(spark):
    rng = random.Random(3)
    good = [(k, [rng.gauss(0, 1 + j) + (j == 2) * k / 20 for j in range(5)]) for k in range(150)]
    good += [(None, good[0][1]), (3, good[3][1]), (3, good[3][1])] + [(900 + k, good[7][1]) for k in range(40)]
    bad = [(500, None), (501, []), (502, [1.0, None, 2.0, 3.0, 4.0]), (503, [float("nan")] * 5), (504, [1.0, float("inf"), 0.0, 0.0, 0.0]), (505, [1.0, 2.0]), (506, [1e300] * 5)]
    got = whitening.whitened(vectors(spark, good + bad).repartition(4)).collect()
    want, share = whitening_by_hand(good)
    assert Counter((r["vec_id"], r["component"], r["deviation"], round(abs(r["whitened"]), 6)) for r in got) == want
    assert {r["n"] for r in got} == {len(good)} and max(r["identity_error"] for r in got) < 1e-8
    for r in got:
        assert abs(r["explained"] - share[r["component"] - 1]) < 1e-9
    assert [c for c in ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error") if c not in got[0]] == []


def test_whitening_large_and_flat(spark):
    """Entries far from the rest stay exact; a constant dimension gives a component without variance."""
    good = [(k, [float(k % 7), 4.0, 1e6 if k == 5 else 0.5]) for k in range(60)]
    got = whitening.whitened(vectors(spark, good)).collect()
    assert len(got) == 180
    x = np.array([[int(np.floor(c * 64)) for c in v] for _, v in good], object)
    z = len(good) * x - x.sum(axis=0)
    for r in got:
        far = int((z[r["vec_id"]] ** 2).sum())
        assert r["deviation"] == (far if far < 2**63 else None)
        assert (r["whitened"] is None) == (r["component"] == 3)
    assert whitening.whitened(vectors(spark, [])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, None)])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = whitening.whitened(vectors(spark, [(1, [1.0, 2.0])])).collect()
    assert [r["whitened"] for r in one] == [None, None] and {r["deviation"] for r in one} == {0}


def test_squares_are_exact():
    rng = np.random.default_rng(1)
    y = np.concatenate([rng.integers(-9, 9, (50, 4)), rng.integers(-(2**59), 2**59, (3, 4))])
    want = [sum(int(r[i]) ** 2 if i == j else (int(r[i]) + int(r[j])) ** 2 for r in y) for i in range(4) for j in range(i, 4)]
    assert whitening.squares(y).tolist() == want


RUN = re.compile("[A-Za-zÀ-ÿ]+")
DOCS = "doc_id long, text string, lang string, word string, n long"


def variants_by_hand(rows, every=97):
    counts = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            counts[w] += 1
    vocab = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    links = {w: [u for u in vocab if u != w and near(w, u)] for w in vocab}
    form = {}
    for w, us in links.items():
        best = min(us, key=lambda u: (-vocab[u], u), default=None)
        form[w] = best if best and vocab[best] >= 2 * vocab[w] else None
    out = Counter()
    for w, n in vocab.items():
        root = w
        while form[root]:
            root = form[root]
        out[w, n, len(links[w]), form[w], vocab.get(form[w]), root] += 1
    return out


def spelled(seed=4):
    rng = random.Random(seed)
    base = ["".join(rng.choice("aeioulnrstéßÿ") for _ in range(rng.randint(5, 12))) for _ in range(40)] + ["étude", "Étude", "aaaaa", "aaaaaa", "naïve", "x" * 300]
    words = []
    for w in base:
        words += [w] * rng.randint(3, 60)
        for _ in range(4):
            k = rng.randrange(len(w))
            u = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("aeiouzé") + w[k:], w[:k] + rng.choice("aeiouzé") + w[k + 1 :]])
            words += [u] * rng.choice([1, 2, 3, 5, 9, 20])
    for k in range(12):  # a chain of forms
        words += ["chain" + "abcdefghijkl"[:k] * (k > 0)] * (3 * 2**min(k, 7))
    rng.shuffle(words)
    cut = [words[k : k + 90] for k in range(0, len(words), 90)]
    texts = [rng.choice([" ", ", ", "1", "-\n"]).join(c) for c in cut]
    texts = [t.upper() if k % 7 == 0 else t for k, t in enumerate(texts)]
    return [*enumerate(texts), (None, texts[0]), (5, texts[5]), (5, texts[5]), (77, None), (78, ""), (79, "çĀ×÷ąb ßßßßß ßßßßß ßßßßß łódka łódka łódka"), (-3, "mixed 中文 Ünder̀ x" * 30)]


def test_spelling_variants(spark):
    rows = spelled()
    docs = spark.createDataFrame([(i, t, "en", "w", 1) for i, t in rows], DOCS).repartition(3)
    for every in (97, 5, 0):
        got = spelling.spelling_variants(docs, drop_every=every)
        assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
        assert Counter(tuple(r) for r in got.collect()) == variants_by_hand(rows, every)
    assert max(len(k[0]) for k in variants_by_hand(rows)) >= 300
    none = spark.createDataFrame([], DOCS)
    assert spelling.spelling_variants(none).count() == 0


def test_filter_passes_agree(spark, monkeypatch):
    """Filters of many segments, one segment a pass: the same pairs."""
    monkeypatch.setattr(spelling, "SEGMENT", 3)
    vocab = spark.createDataFrame([(f"w{a}{b}{c}{d}", 3) for a in "abcdefgh" for b in "abcdef" for c in "abcde" for d in "xyz"], "word string, n long")
    few = {tuple(r) for r in spelling.near_words(vocab, 1 << 30).collect()}
    many = spelling.near_words(vocab, 1)
    assert {tuple(r) for r in many.collect()} == few and many.count() == len(few) == sum(720 * k // 2 for k in (7, 5, 4, 2))


def test_filters_know_all_keys():
    rng = np.random.default_rng(0)
    key = rng.integers(0, 2**64, 20_000, np.uint64)
    shards = spelling.Shards({7: 20_000})
    bits = np.zeros(shards.total * 64, np.uint8)
    block = shards.block(key, np.full(len(key), 7))
    low = B.mix(key)
    for p in range(spelling.PROBES):
        b = spelling._bit(low, p)
        np.bitwise_or.at(bits, block * 64 + (b >> 3), (1 << (b & 7)).astype(np.uint8))
    assert len(spelling.known(bits, block, key)) == len(key)
    other = rng.integers(0, 2**64, 100_000, np.uint64)
    assert len(spelling.known(bits, shards.block(other, np.full(len(other), 7)), other)) < 1000
    assert (shards.block(other, np.full(len(other), 8)) == -1).all()


def test_crc_continues():
    words = [b"", b"a", b"hello", b"x" * 63, b"y" * 64, b"z" * 65, b"long" * 999]
    data = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    before = np.array([zlib.crc32(b"%d:" % k) for k in range(len(words))], np.uint32)
    got = spelling.crc32_of(data, np.cumsum(size) - size, size, before)
    assert got.tolist() == [zlib.crc32(b"%d:" % k + w) for k, w in enumerate(words)]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_classifier_holds_out(spark, sf):
    """Accuracy on rows that the fit never saw, against always saying good."""
    folder = f"{DATA.rsplit('/', 1)[0]}/{sf}"
    got = LQ.op12_additive_model(spark, folder)
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    assert got.count() == docs.count()
    rows = got.filter("held_out").join(labels.filter("quality is not null"), "doc_id").select("score", "predicted", "quality").collect()
    right = np.mean([r["predicted"] == r["quality"] for r in rows])
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    print(sf, len(rows), right, auc)
    assert right > max(0.95, np.mean([r["quality"] for r in rows])) and auc > 0.97
    held = {r["doc_id"] for r in got.filter("held_out").collect()}
    assert held == {r["doc_id"] for r in docs.select("doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}


def test_classifier_odd_rows(spark):
    rows = [(k, " ".join(["word", "Other", "thing,"][m % 3] + str(m * k % 5) for m in range(30)), "en", "w", 1) for k in range(40)]
    rows += [(100 + k, "!! ## " * 20, "en", "w", 1) for k in range(40)] + [(None, "x", "en", "w", 1), (900, None, "en", "w", 1), (901, "", None, "w", 1), (902, "a" * 300_000, "en", "w", 1), (903, "b c\n" * 60_000, "en", "w", 1), (7, "x", "en", "w", 1), (7, "x", "en", "w", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, 1) for k in range(40)] + [(100 + k, 0) for k in range(40)] + [(900, 1), (3, 0), (3, 1), (None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    got = gam.quality_scores(docs, labels)
    out = got.collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows) and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in out)
    by = {r["doc_id"]: r for r in out}
    assert by[20]["score"] > 0.7 > by[120]["score"] and got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert [tuple(r) for r in gam.quality_scores(docs.repartition(5), labels).orderBy("doc_id", "score").collect()] == [tuple(r) for r in got.orderBy("doc_id", "score").collect()]
    assert {r["score"] for r in gam.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert gam.quality_scores(docs.limit(0), labels).count() == 0
    only = gam.quality_scores(docs, labels.filter("quality = 1")).collect()
    assert all(r["score"] > 0.5 for r in only)


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    cuts = [np.unique(np.quantile(x[:, k], np.arange(gam.BINS) / gam.BINS)) for k in range(3)]
    m = gam.fit(x, y, cuts)
    assert m.pairs[0] == (0, 1) and ((m.scores(x) > 0.5) == y).mean() > 0.9  # a cell of the grid lies across the middle
    alone = gam.fit(x, y, cuts, pairs=0)
    assert ((alone.scores(x) > 0.5) == y).mean() < 0.7


def test_feature_counts():
    texts = [b"One two two THREE!! 4,\none two | \xc3\xa9t\xc3\xa9.", b"", b"  \n"]
    f = gam.text_features(B.Block.of(range(3), texts))
    got = {k: v.tolist() for k, v in f.items()}
    assert got["n_words"] == [9, 0, 0] and got["n_doubled"] == [1, 0, 0] and got["n_distinct"] == [7, 0, 0] and got["n_bare"] == [1, 0, 0]
    assert got["n_ends"] == [2, 0, 0] and got["longest"] == [7, 0, 0] and got["n_wide"] == [2, 0, 0] and got["n_digits"] == [1, 0, 0] and got["n_letters"] == [3 + 3 + 3 + 5 + 3 + 3 + 3, 0, 0]
