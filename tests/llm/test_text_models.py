"""Language, quality and toxicity on small fixtures; edge rows have the results that the docstrings state."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.llm import language_id, quality, toxicity
from daybook.llm.text import distinct_words, steps

EN = "the quick brown fox jumps over the lazy dog and the cat sat on the mat with the other animals there".split()
DE = "der schnelle braune fuchs springt ueber den faulen hund und die katze sitzt auf der matte mit den anderen tieren".split()
EDGE = [(900, None, None), (901, "", "en"), (902, "12 34 !!", None), (903, "the the the " * 20000, None), (904, "x\x00y ￿ 𝕏", None)]


def corpus(n=40):
    rng = random.Random(2)
    return [(i, " ".join(rng.choice(EN if i % 2 else DE) for _ in range(60)), "en" if i % 2 else "de") for i in range(n)]


def test_language(spark):
    rows = corpus() + EDGE
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = language_id.fit(docs.where("doc_id < 30"))
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:40])
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"] and got[900].score == 0.0
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_counts_against_plain_loop():
    texts = ["Ab a", "ab"]
    want = {}
    for t in texts:
        padded = t.lower()
        for n in (1, 2, 3):
            for i in range(-1, len(padded) + 1):
                g = "".join(padded[j] if 0 <= j < len(padded) and padded[j].isalpha() else " " for j in range(i, i + n))
                if len(g) == n and (n == 1 and g != " " or n == 2 and g.strip() or n == 3 and g[1] != " "):
                    want[g] = want.get(g, 0) + 1
    got = language_id.count_ngrams(texts)
    inner = {g: c for g, c in want.items() if not g.startswith(" ")}
    assert all(got[g] == c for g, c in inner.items())


@pytest.mark.parametrize("direct", [1 << 22, 0])
def test_language_distance_against_plain_loop(spark, monkeypatch, direct):
    """Out-of-place distances by hand, once with the direct table and once without."""
    monkeypatch.setattr(language_id, "DIRECT", direct)
    rows = corpus() + [(50, "слово и дело " * 9, "ru"), (51, "dies und das и это", None)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), depth=60)
    held = {g for p in model.ranks.values() for g in p}
    first = {g: min(p.get(g, model.depth) for p in model.ranks.values()) for g in held}
    texts = [t for _, t, _ in rows if t]
    got, _ = language_id._Scorer(model).distances(texts)
    for k, t in enumerate(texts):
        padded = f" {t.lower()} "
        counts = {}
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = "".join(c if c.isalpha() else " " for c in padded[i : i + n])
                if g in held and (n == 1 and g != " " or n == 2 and g.strip() or n == 3 and g[1] != " "):
                    counts[g] = counts.get(g, 0) + 1
        mine = sorted(counts, key=lambda g: (-counts[g], first[g], g))[: model.depth]
        for j, name in enumerate(model.languages):
            theirs = model.ranks[name]
            cost = sum(abs(theirs[g] - i) if g in theirs else model.depth for i, g in enumerate(mine))
            assert abs(got[k, j] - cost / (len(mine) * model.depth)) < 1e-9


def test_repeated_rows_and_ties(spark):
    docs, labels = labelled(spark, insult)
    twice = docs.unionAll(docs)
    field = toxicity.fit(docs, labels, label="y")
    vectors = quality.word_vectors(docs)
    net = quality.fit(docs, labels, vectors, label="y")
    model = language_id.fit(docs.withColumn("lang", F.lit("en")))
    for out in (toxicity.score(twice, field), quality.score(twice, vectors, net), language_id.identify(twice, model)):
        rows = {}
        for r in out.collect():
            rows.setdefault(r.doc_id, []).append((r.score, getattr(r, "predicted", None), getattr(r, "lang_pred", None)))
        assert len(rows) == 165 and all(len(x) == 2 and x[0] == x[1] for x in rows.values())


def test_language_without_training(spark):
    docs = spark.createDataFrame(corpus(2), "doc_id long, text string, lang string")
    out = language_id.identify(docs, language_id.fit(docs.where("false"))).collect()
    assert {r.lang_pred for r in out} == {"und"}
    assert language_id.identify(docs.where("false"), language_id.fit(docs)).count() == 0


def labelled(spark, bad):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(160):
        words = [rng.choice(EN) + str(rng.randrange(3)) for _ in range(50)]
        if i % 4 == 0:
            bad(words, rng)
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    docs += [(i, t) for i, t, _ in EDGE]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + [(900, 1), (5, None)], "doc_id long, y int")


def insult(words, rng):
    for k in range(4):
        words.insert(rng.randrange(50), rng.choice(["grobian", "lump", "schuft"]) + ",")


def test_toxicity(spark):
    docs, labels = labelled(spark, insult)
    field = toxicity.fit(docs, labels.where("doc_id % 5 > 0"), label="y")
    rows = {r.doc_id: r for r in toxicity.score(docs, field).collect()}
    held = [i for i in range(160) if i % 5 == 0]
    assert all(rows[i].predicted == int(i % 4 == 0) for i in held)
    assert len(rows) == 165 and all(0 <= r.score <= 1 for r in rows.values())
    text = dict(docs.collect())[0]
    assert {text[s.start : s.end].strip(",") for s in rows[0].spans} <= {"grobian", "lump", "schuft"} and rows[0].spans
    assert rows[900].spans == [] and rows[901].spans == []


def test_field_against_enumeration():
    rng = np.random.default_rng(0)
    field = toxicity.Field(rng.normal(size=toxicity.BUCKETS), rng.normal(size=(2, 2)), np.zeros(5))
    ids, sizes = rng.integers(0, 50, size=(2, 9)), np.array([4, 0, 5])
    got = toxicity.marginals(field, ids, sizes)
    e = toxicity.BIAS + field.emission[ids[0]] + field.emission[ids[1]]
    at = 0
    for n in sizes:
        total, hit = 0.0, np.zeros(n)
        for mask in range(1 << n if n else 0):
            y = [(mask >> k) & 1 for k in range(n)]
            w = np.exp(sum(e[at + k] * y[k] for k in range(n)) + field.transition[0, y[0]] + sum(field.transition[y[k - 1], y[k]] for k in range(1, n)))
            total += w
            hit += w * np.array(y)
        if n:
            assert np.allclose(got[at : at + n], hit / total)
        at += n


@pytest.mark.parametrize("keep", ["doc_id < 0", "y = 1"])
def test_one_class_or_none(spark, keep):
    docs, labels = labelled(spark, insult)
    share = {"doc_id < 0": 0.0, "y = 1": 1.0}[keep]
    out = toxicity.score(docs, toxicity.fit(docs, labels.where(keep), label="y")).collect()
    assert {r.score for r in out} == {share}


def shout(words, rng):
    words[:] = [w.upper() + "!!" for w in words]


def test_quality(spark):
    docs, labels = labelled(spark, shout)
    vectors = quality.word_vectors(docs)
    net = quality.fit(docs, labels.where("doc_id % 5 > 0"), vectors, label="y")
    rows = {r.doc_id: r for r in quality.score(docs, vectors, net).collect()}
    assert len(rows) == 165 and all(0 <= r.score <= 1 for r in rows.values())
    assert sum(rows[i].predicted == int(i % 4 == 0) for i in range(0, 160, 5)) >= 31
    none = quality.fit(docs, labels.where("false"), vectors, label="y")
    assert none.probability(np.zeros((2, 69))).tolist() == [0.5, 0.5]


def test_distinct_words_are_those_of_split():
    texts = ["a b  a", "", " \t\n", "x\u2003y\x1cz\x85w\u00a0v", "one"]
    words, at, sizes = distinct_words(texts)
    assert [words[i] for i in at] == [w for t in texts for w in t.split()] and sizes.tolist() == [len(t.split()) for t in texts]


def test_steps_cover_rows():
    cut = list(steps(np.array([5, 5, 100, 1, 1]), 10))
    assert [i for s in cut for i in range(s.start, s.stop)] == [0, 1, 2, 3, 4]


def test_word_vectors_and_pooling_against_plain_loops(spark):
    texts = ["The cat, the CAT; a dog 12!", "", None, "one", "dog cat dog cat  über Straße", "x" * 90 + "!!! " + "Ab" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    where, sign = quality._index_vectors()
    table = quality.Buckets()
    told = {w: int(v) for t in texts if t for w, v in zip(t.split(), table.of(t.split()), strict=True)}
    want = np.zeros((quality.BUCKETS, quality.DIM))
    for t in texts:
        words = [(told[w] >> 32, told[w] & 0xFFFFFFFF) for w in (t or "").split()]
        for i, mine in enumerate(words):
            for j in (i - 1, i + 1):
                if 0 <= j < len(words):
                    for a in mine:
                        for b in words[j]:
                            for k in range(quality.NONZERO):
                                want[a, where[b, k]] += sign[b, k]
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    want = np.where(norm > 0, want / np.maximum(norm, 1e-9), 0)
    vectors = quality.word_vectors(docs)
    assert np.allclose(vectors, want, atol=1e-6)
    got = quality.pool([t or "" for t in texts], vectors, quality.Buckets())
    for row, t in zip(got, texts, strict=True):
        words = [(told[w] >> 32, told[w] & 0xFFFFFFFF) for w in (t or "").split()]
        n = max(1, len(words))
        means = [sum((vectors[w[k]].astype(float) for w in words), np.zeros(quality.DIM)) / n for k in (0, 1)]
        near = sum(float(vectors[a[0]] @ vectors[b[0]]) for a, b in zip(words, words[1:], strict=False)) / n
        assert np.allclose(row, [*means[0], *means[1], np.linalg.norm(means[0]), np.linalg.norm(means[1]), near, len({w[0] for w in words}) / n, np.log1p(len(words))], atol=1e-5)


def test_shapes_of_whole_words():
    """Runs of letters of a case and of digits count once, however long the word; marks count each."""
    of = lambda *w: [int(x) & 0xFFFFFFFF for x in quality.Buckets().of(list(w))]
    a, b, c, d, e, f = of("Th,", "Xxxxx,", "x" * 200 + "A", "y" * 70 + "B", "a1b22c333d4444e5!", "z9z9z9z9z9!")
    assert a == b and c == d and e == f and len({a, c, e}) == 3


def test_network_fits_and_is_calibrated():
    rng = np.random.default_rng(0)
    x = np.zeros((6000, 69))
    x[:, :4] = rng.normal(size=(6000, 4))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float)
    net = quality.train(x[:5000], y[:5000])
    p = net.probability(x[5000:])
    linear = np.mean((x[5000:, 2] > 0) == (y[5000:] == 1))
    assert np.mean((p >= 0.5) == (y[5000:] == 1)) > linear + 0.05 and abs(p.mean() - y[5000:].mean()) < 0.05
    sharp = quality._cross_entropy(net.logits(x[5000:]), y[5000:])
    assert quality._cross_entropy(net.logits(x[5000:]) / net.temperature, y[5000:]) <= sharp + 0.01


def test_toxic_words_are_counted_by_document(spark):
    rows = [(i, "good good fine" if i % 2 else "bad, Bad! fine " + ("rare" if i == 0 else "")) for i in range(400)]
    found = spark.createDataFrame([(t, 1 - i % 2) for i, t in rows], "text string, __y int").repartition(3)
    assert toxicity.lexicon(found, 200, 200, "text") == {"bad"}
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").withColumn("__y", 1 - F.col("doc_id") % 2).withColumn("__y", F.col("__y").cast("int"))
    parts = toxicity.pieces(docs, {"bad"}, "doc_id", "text", 7)
    assert len(parts) == 14 and sum(m.sum() for _, m in parts) == 14 and all(i.shape == (2, len(m)) for i, m in parts)
