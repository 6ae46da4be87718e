"""Fitted operators: samples, classifier and language model against plain versions, and their awkward inputs."""

import math
import random
import time

import numpy as np
import pytest
import zstandard

from oscilla.llm import language, quality
from oscilla.llm.samples import bounded_sample
from tests.llm.test_operators import LOW, WORD, say


def grams(text):
    """The n-grams of a text as they are, without hashing."""
    data = text.encode()
    words = WORD.findall(text.translate(LOW))
    out = {("b", data[i : i + k]) for k in (1, 2, 3) for i in range(len(data) - k + 1)}
    out |= {("w", *words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)}
    out |= {("same", k) for k in range(2, 9) for i in range(len(words) - k + 1) if len(set(words[i : i + k])) == 1}
    return out


def plain_margins(train, labels, texts, cost):
    """Naive Bayes support vectors on exact n-grams: the dual by many passes of projected coordinate steps on the Gram matrix."""
    rows = [grams(t) for t in train]
    vocabulary = {g: k for k, g in enumerate(sorted(set().union(*rows), key=repr))}
    dense = lambda sets: np.array([[float(g in s) for g in vocabulary] for s in sets])
    x, y = dense(rows), np.where(np.array(labels) == 1, 1.0, -1.0)
    pos, neg = 1 + x[y > 0].sum(axis=0), 1 + x[y < 0].sum(axis=0)
    # n-grams outside the training rows count once on each side in the sums
    rest = (1 << quality.BITS) - len(vocabulary)
    ratio = np.log(pos / (pos.sum() + rest)) - np.log(neg / (neg.sum() + rest))
    scaled = lambda m, sets: m * ratio / np.sqrt([[len(s) + 1] for s in sets])
    v = scaled(x, rows)
    q = (v @ v.T + 1) * np.outer(y, y)
    alpha = np.zeros(len(y))
    for _ in range(3000):
        for i in range(len(y)):
            alpha[i] = min(max(alpha[i] - (q[i] @ alpha - 1) / q[i, i], 0.0), cost)
    weight, bias = (alpha * y) @ v, float(alpha @ y)
    sets = [grams(t) for t in texts]
    return scaled(dense(sets), sets) @ weight + bias


def test_classifier_against_plain_version():
    rng = random.Random(3)
    good = lambda: say(rng, rng.randint(3, 25))
    bad = lambda: rng.choice((lambda: " ".join(x + "#" for x in say(rng, 8).split()), lambda: say(rng, 1) + f" {say(rng, 1)}" * 1 + (" " + say(rng, 1)) * 6))()
    texts, labels = zip(*((good(), 1) if rng.random() < 0.6 else (bad(), 0) for _ in range(80)), strict=True)
    xs = [quality.indicators(t) for t in texts]
    assert all(len(x) == len(grams(t)) or abs(len(x) - len(grams(t))) <= 2 for x, t in zip(xs, texts, strict=True))  # but for collisions
    model = quality.fit_rows(xs, np.array(labels), 0.6, epochs=3000)
    fitted_on = [k for k in range(80) if k % 4 != 3]
    new = [good() for _ in range(20)] + [bad() for _ in range(20)]
    want = plain_margins([texts[k] for k in fitted_on], [labels[k] for k in fitted_on], new, 1.0)
    got = np.array([model.margin(quality.indicators(t)) for t in new])
    assert np.abs(got - want).max() < 0.05 * np.abs(want).max()


def test_long_texts_have_the_same_indicators(monkeypatch):
    t = say(random.Random(4), 30_000)
    whole = quality.indicators(t)
    monkeypatch.setattr(quality, "_SHORT", 1 << 30)
    assert (quality.indicators(t) == whole).all()
    monkeypatch.setattr(quality, "_BYTES", 5000)
    assert (quality.indicators(t) == whole).all()


def test_sample_of_repeated_and_null_keys(spark):
    rows = [(None, None, "a")] * 500 + [(1, "same", "a")] * 500 + [(k, "x", "a") for k in range(3000)] + [(k, None, "b") for k in range(9)] + [(5, "x", None)]
    d = spark.createDataFrame(rows, "id long, text string, by string")
    got = bounded_sample(d, "by", ["id", "text"], 300).distinct().collect()
    n = {c: sum(r.by == c for r in got) for c in ("a", "b", None)}
    assert 200 < n["a"] < 400 and n["b"] == 9 and n[None] == 0


def test_classifier_with_a_hundred_thousand_rows_of_one_id(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, say(rng, 30) if i % 2 else say(rng, 10) + " ###") for i in range(200)] + [(3, say(rng, 12))]
    d = spark.createDataFrame(rows, "doc_id long, text string").union(spark.range(100_000).selectExpr("7L AS doc_id", f"'{say(rng, 9)}' AS text"))
    lab = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(7, 1), (7, 0), (None, 1), (8, None)], "doc_id long, quality int")
    seen = []
    real = quality.fit_rows
    monkeypatch.setattr(quality, "fit_rows", lambda xs, y, share, **k: seen.append((len(xs), sum(map(len, xs)))) or real(xs, y, share, **k))
    model = quality.fit(d, lab)
    assert seen[0][0] <= 200  # one row for each id
    monkeypatch.setattr(quality, "SAMPLE", 8000)
    quality.fit(d, lab)
    assert seen[1][1] < 12_000 < seen[0][1]
    clash = d.limit(50).selectExpr("*", "1 AS score", "2 AS held_out", "3 AS predicted", "4 AS quality", "5 AS mark")
    assert quality.scores(clash, model).columns == ["doc_id", "held_out", "score", "predicted"]
    assert quality.accepted(clash, model).columns == clash.columns


def language_rows(rng, langs, n, words):
    made = {k: ["".join(rng.choices("abcdefghijkl", k=rng.randint(3, 9))) for _ in range(60)] for k in langs}
    return [(i, " ".join(rng.choices(made[lang], k=words(lang))), lang) for i, lang in enumerate(rng.choices(langs, k=n))]


def test_language_against_plain_compression(spark):
    rng = random.Random(6)
    rows = language_rows(rng, ["aa", "bb", "cc"], 150, lambda _: rng.randint(1, 900))
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    each = []
    for _, data in model:
        each.append(zstandard.ZstdCompressor(level=language.LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)))
    for at_once in (64, 2):
        c = language.Compressor(model, at_once=at_once)
        got = c.predict_all([t for _, t, _ in rows])
        for (_, t, _), (name, score, margin) in zip(rows, got, strict=True):
            data = " ".join("".join(x if x.isalpha() else " " for x in t.lower()).split()).encode()
            sizes = [sum(len(z.compress(data[i : i + language.BLOCK])) for i in range(0, len(data), language.BLOCK)) for z in each]
            assert name == model[sizes.index(min(sizes))][0]
            assert math.isclose(score, 1 / sum(math.exp(max(-60.0, (min(sizes) - s) / 2)) for s in sizes)) and 0 <= margin <= 1


def test_language_with_long_texts_only(spark):
    rng = random.Random(7)
    rows = language_rows(rng, ["aa", "long"], 60, lambda x: 40 if x == "aa" else 4000)
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = dict(language.fit(d))
    assert len(model["long"]) == language.DICTIONARY and 1000 < len(model["aa"]) < language.DICTIONARY
    got = {r.doc_id: r.lang_pred for r in language.predict(d, list(model.items())).collect()}
    assert np.mean([got[i] == x for i, _, x in rows]) > 0.95


def test_a_thousand_languages(spark, monkeypatch):
    rng = random.Random(8)
    langs = [f"l{k}" for k in range(1000)]
    rows = language_rows(rng, langs, 2000, lambda _: 30) + [(i, "12", "l3") for i in (9_000, 9_001)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS margin", "2 AS score", "3 AS place")
    model = language.fit(d)
    learned = {x for i, _, x in rows if language.zlib.crc32(str(i).encode()) % 4 != 2}
    assert {name for name, _ in model} == learned and all(data for _, data in model)
    some = d.where("doc_id < 60 OR doc_id >= 9000")
    got = {r.doc_id: r.lang_pred for r in language.predict(some, model).collect()}
    assert got[9_000] == "und" and np.mean([got[i] == x for i, _, x in rows[:60]]) > 0.5
    monkeypatch.setattr(language, "MODEL_BYTES", 10_000)
    with pytest.raises(ValueError):
        language.fit(d)


def test_language_of_repeated_rows_and_very_long_texts(spark):
    rng = random.Random(9)
    rows = language_rows(rng, ["aa", "bb"], 80, lambda _: 50)
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    d = d.union(spark.range(100_000).selectExpr("5L AS doc_id", f"'{rows[5][1]}' AS text", "'aa' AS lang"))
    model = language.fit(d)
    assert all(len(data) > 1000 for _, data in model)
    began = time.perf_counter()
    whole = language.Compressor(model).predict_all([(rows[0][1] + " ") * 10_000, None, "", "1 2", "é"])
    assert time.perf_counter() - began < 30
    assert whole[0][0] == rows[0][2] and [x[0] for x in whole[1:4]] == ["und"] * 3 and whole[4][0] in ("aa", "bb")
