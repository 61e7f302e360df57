"""The classifier against a plain version: loops over characters, n-grams and weights."""

import collections
import math
import random

import numpy as np
import pytest

from shutterlake.llm import lang_id

M32 = 0xFFFFFFFF


def plain_grams(text):
    c = [ord(x.lower()) if x.isalpha() and len(x.lower()) == 1 else ord(x) if x.isalpha() else 32 for x in text]
    out = []
    for n in range(3):
        for i in range(len(c) - n):
            run = c[i : i + n + 1]
            if any(x != 32 for x in run):
                h = 0
                for x in run:
                    h = h * 0x01000193 & M32 ^ x
                h = (h + 0x9E3779B9 * (n + 1) & M32) * 0x85EBCA6B & M32
                h = (h ^ h >> 13) * 0xC2B2AE35 & M32
                out.append(h >> 15)
    return out


def plain_softmax(z):
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def plain_fit(texts, labels, seed=0):
    """weight of (feature, language), bias and idf by FTRL with L1 and L2, as published, one number at a time."""
    names = sorted(set(labels))
    order = np.random.default_rng(seed).permutation(len(texts)).tolist()
    train = order[len(texts) // 5 :]
    tf = [collections.Counter(plain_grams(t)) for t in texts]
    df = collections.Counter(f for i in train for f in tf[i])
    idf = lambda f: math.log((1 + len(train)) / (1 + df[f])) + 1
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(key):
        if abs(z[key]) <= lang_id.L1:
            return 0.0
        return -(z[key] - math.copysign(lang_id.L1, z[key])) / ((lang_id.BETA + math.sqrt(n[key])) / lang_id.ALPHA + lang_id.L2)

    rng = np.random.default_rng(seed + 1)
    for _ in range(lang_id.EPOCHS):
        for i in rng.permutation(train).tolist():
            size = max(1, sum(tf[i].values()))
            v = {f: k / size * idf(f) * lang_id.SCALE for f, k in tf[i].items()} | {"bias": 1.0}
            w = {(f, k): weight((f, k)) for f in v for k in range(len(names))}
            p = plain_softmax([sum(x * w[f, k] for f, x in v.items()) for k in range(len(names))])
            for f, x in v.items():
                for k, name in enumerate(names):
                    g = x * (p[k] - (labels[i] == name))
                    z[f, k] += g - (math.sqrt(n[f, k] + g * g) - math.sqrt(n[f, k])) / lang_id.ALPHA * w[f, k]
                    n[f, k] += g * g
    return names, weight, idf, {f for t in tf for f in t}


TEXTS = {
    "de": "Der schnelle Fuchs springt über den Zaun und läuft weiter durch die Straßen der alten Stadt",
    "en": "The quick fox jumps over the fence and runs away through the streets of the old town",
    "fr": "Le renard rapide saute par dessus la clôture et court à travers les rues de la vieille ville",
}


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(3)
    rows = [(" ".join(rng.choices(t.split(), k=rng.randint(2, 9))) + rng.choice(["", " 12!", "\n", " İ ß"]), lang) for lang, t in TEXTS.items() for _ in range(14)]
    rng.shuffle(rows)
    return [t for t, _ in rows], [lang for _, lang in rows]


def test_grams_against_loops():
    texts = ["", "a", " ", "Ab c1d", "Ünï İx ß", "漢字 \U0001f600 z", "  x  "]
    feature, doc, letters = lang_id.grams(texts)
    for i, t in enumerate(texts):
        assert sorted(feature[doc == i].tolist()) == sorted(plain_grams(t))
        assert letters[i] == sum(c.isalpha() for c in t)


def test_weights_and_probabilities_against_loops(sample):
    texts, labels = sample
    names, weight, idf, seen = plain_fit(texts, labels)
    model = lang_id.fit(texts, labels)
    assert model.languages == names
    for f in seen:
        assert np.allclose(model.weights[f], [weight((f, k)) * idf(f) * lang_id.SCALE for k in range(len(names))], atol=1e-4)
    assert np.allclose(model.bias, [weight(("bias", k)) for k in range(len(names))], atol=1e-6)
    for t in [*texts, "the streets", "les rues"]:
        tf = collections.Counter(plain_grams(t))
        size = sum(tf.values())
        z = [sum(n / size * idf(f) * lang_id.SCALE * weight((f, k)) for f, n in tf.items()) + weight(("bias", k)) for k in range(len(names))]
        p = plain_softmax([x / model.temperature for x in z])
        (got,), (score,) = model.predict([t])
        assert abs(score - max(p)) < 1e-4 and p[names.index(got)] > max(p) - 1e-4


def test_temperature_is_the_best_on_the_held_fifth(sample):
    texts, labels = sample
    model = lang_id.fit(texts, labels)
    held = np.random.default_rng(0).permutation(len(texts))[: len(texts) // 5]

    def loss(t):
        total = 0.0
        for i in held:
            p = plain_softmax((model.logits([texts[i]])[0][0] / t).tolist())
            total -= math.log(max(p[model.languages.index(labels[i])], 1e-12))
        return total

    assert all(loss(model.temperature) <= loss(t) + 1e-9 for t in np.geomspace(0.05, 20, 60))


def test_many_languages_share_the_sample(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "SAMPLE_ALL", 40)
    seen = {}
    monkeypatch.setattr(lang_id, "fit", lambda texts, labels: seen.update(n=collections.Counter(labels)))
    rows = [(f"text {lang} {i}", f"l{lang}") for lang in range(20) for i in range(90)]
    lang_id.train(spark.createDataFrame(rows, "text string, lang string"))
    assert len(seen["n"]) == 20 and set(seen["n"].values()) == {2}


def test_awkward_rows(spark):
    rows = [(None, "en", 1.0), ("", "en", 1.0), ("123 !!", "de", 2.0), ("the " * 50_000, None, 1.0), ("the fox", "en", 1.0), ("the fox", "en", 1.0)]
    docs = spark.createDataFrame(rows, "text string, lang string, lang_score double")
    model = lang_id.fit([TEXTS["en"], TEXTS["de"]], ["en", "de"])
    got = lang_id.predict(docs, model)
    assert got.columns == ["text", "lang", "lang_pred", "lang_score"]
    done = [(r["text"] and r["text"][:3], r["lang_pred"], 0 <= r["lang_score"] <= 1) for r in got.collect()]
    assert sorted(done, key=str) == sorted([(None, "und", True), ("", "und", True), ("123", "und", True), *[("the", "en", True)] * 3], key=str)
