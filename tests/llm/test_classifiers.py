import math
import pickle

import numpy as np
from chronomesh.llm import language, quality
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.1"


def joined(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels


def test_language_held_out_accuracy(spark):
    docs, _ = joined(spark)
    found = language.op4_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 1000 and right > 0.97


def test_language_edges(spark):
    texts = [("le chat de la maison", "fr"), ("the cat of the house", "en"), (None, "fr"), ("", "en"), ("12 34 .", "en"), ("the cat", None)] * 20
    docs = spark.createDataFrame([(i, t, lang, 0) for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string, grams int")
    model = language.fit(docs)
    assert model.languages == ["en", "fr"]
    rows = language.predicted(docs, model).collect()
    assert len(rows) == 120 and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.text in (None, "", "12 34 .")} == {"und"}
    assert {r.lang_pred for r in rows if r.text == "le chat de la maison"} == {"fr"}
    nothing = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.predicted(docs, nothing).collect()} == {"und"}


def plain_grams(text):
    """Presence of each hashed n-gram, byte by byte."""
    raw, m = text.encode().lower(), 0xFFFFFFFF
    out, codes = set(raw), list(raw)
    for _ in range(2):
        codes = [(a * 0x01000193 + b * 0x9E3779B1) & m for a, b in zip(codes, codes[1:], strict=False)]
        codes = [c ^ c >> 15 for c in codes]
        out |= {(c * 0x85EBCA77 & m) >> (32 - language.BITS) for c in codes}
    return out


def test_language_equals_brute_force():
    """The kernel, the landmarks and the regression from their definitions."""
    rng = np.random.default_rng(2)
    words = {"aa": "le chat de la maison est noir sur une table avec des fleurs".split(), "bb": "the cat of that house is black on this table with some flowers".split(), "cc": "der hund aus dem haus ist schwarz auf einem tisch mit vielen blumen".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang], n))
    labels = [lang for _ in range(15) for lang in words]
    texts = [text(lang, 8) for lang in labels]
    model = language.KernelModel(language.packed(texts), labels, landmarks=4)
    sets = [plain_grams(t) for t in texts]
    marks = [sets[i] for lang in sorted(words) for i in [k for k, x in enumerate(labels) if x == lang][:4]]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    k = np.array([[kernel(s, m) for m in marks] for s in sets])
    inner = np.array([[kernel(a, b) for b in marks] for a in marks])
    signs = np.array([[1.0 if x == lang else -1.0 for lang in sorted(words)] for x in labels])
    weights = np.linalg.solve(k.T @ k + language.RIDGE * len(texts) * inner + 1e-9 * np.eye(len(marks)), k.T @ signs)
    asked = [text(lang, n) for lang in words for n in (3, 20, 500)] + ["chat the hund"]
    found, scores = model.predict(asked)
    for t, lang, score in zip(asked, found, scores, strict=True):
        values = np.array([kernel(plain_grams(t), m) for m in marks]) @ weights
        assert lang == sorted(words)[int(values.argmax())] and abs(score - min(1, max(0, (1 + values.max()) / 2))) < 1e-3


def test_many_languages_long_texts_and_clashing_names(spark):
    rows = [(i * 100 + k, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * (3 + k), f"l{i:03}") for i in range(90) for k in range(4)] + [(99_999, "aa " * 700_000, None)]
    docs = spark.createDataFrame([(*r, "own", 7.0) for r in rows], "doc_id long, text string, lang string, Lang_pred string, score double")
    model = language.fit(docs)
    assert model.languages == sorted({r[2] for r in rows[:-1]}) and len(model.languages) == 90
    found = language.predicted(docs, model)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = {r.doc_id: r for r in found.select("doc_id", "lang", "lang_pred", "score").collect()}
    assert len(got) == len(rows) and got[99_999].lang_pred == "l000" and all(0 <= r.score <= 1 for r in got.values())
    assert len(language.fit(docs, sample=90).languages) == 90
    assert language.predicted(docs.limit(0), model).count() == 0


def test_a_thousand_languages():
    """The model's size is bounded, and rare languages are still told apart."""
    rng = np.random.default_rng(1)
    words = {f"l{i:04}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for i in range(1_000)}
    labels = [lang for _ in range(6) for lang in words]
    model = language.KernelModel(language.packed([" ".join(rng.choice(words[x], 10)) for x in labels]), labels)
    assert len(model.packed) == language.ALL_LANDMARKS and len(np.unique(model.of)) == 1_000
    assert len(pickle.dumps(model)) < 20 << 20
    asked = list(words)[::25]
    assert sum(a == b for a, b in zip(asked, model.predict([" ".join(words[x]) for x in asked])[0], strict=True)) >= 38


def test_scores_do_not_depend_on_the_texts_beside(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(256).collect()]
    labels = [("aa", "bb", "cc")[i % 3] for i in range(120)]
    model = language.KernelModel(language.packed([t or "x" for t in texts[:120]]), labels)
    alone = [model.predict([t]) for t in texts]
    assert model.predict(texts) == ([x[0][0] for x in alone], [x[1][0] for x in alone])
    weights = np.random.default_rng(1).normal(size=quality.FEATURES)
    assert quality.scores(texts, weights) == [quality.scores([t], weights)[0] for t in texts]


def plain_features(text, stats):
    """The features of a text, from their definition."""
    out = [0.0] * quality.FEATURES
    out[0] = 1.0
    if not text:
        return out
    for j, s in enumerate(stats):
        out[1 + 16 * j + min(15, int(s * 16))] = 1.0
    shape = [97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 32 if b in (9, 11, 12, 13) else b for b in text.encode()]
    m, seen = 0xFFFFFFFF, {}
    for a, b, c, d in zip(shape, shape[1:], shape[2:], shape[3:], strict=False):
        code = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D + d * 0x27D4EB2F) & m
        code ^= code >> 15
        place = quality.GRAMS_AT + ((code * 0x2C1B3C6D & m) >> 8) % (quality.FEATURES - quality.GRAMS_AT)
        seen[place] = seen.get(place, 0) + 1
    for place, n in seen.items():
        out[place] += math.sqrt(n / (len(shape) - 3))
    return out


def plain_posteriors(said, rounds=50):
    """Expectation and maximisation voter by voter."""
    good = [0.05 if quality.BAD in row else 0.95 for row in said]
    for _ in range(rounds):
        rates = []
        for weights in (good, [1 - g for g in good]):
            own = []
            for j in range(len(said[0])):
                hits = [0.1 + sum(w for w, row in zip(weights, said, strict=True) if row[j] == v) for v in (0, 1, 2)]
                own.append([h / sum(hits) for h in hits])
            rates.append(own)
        share = (sum(good) + 1) / (len(good) + 2)
        new = []
        for row in said:
            log = math.log(share / (1 - share)) + sum(math.log(rates[0][j][v] / rates[1][j][v]) for j, v in enumerate(row))
            new.append(1 / (1 + math.exp(-max(-30, min(30, log)))))
        good = new
    return good


def test_quality_equals_brute_force():
    """Features, posteriors and the trained weights, from their definitions."""
    rng = np.random.default_rng(3)
    words = "some plain words about a small garden with many trees and birds".split()
    texts = [" ".join(rng.choice(words, 40)) + "." for _ in range(25)] + ["$$$ %% @@ !!" * 9, "BUY NOW " * 20, "1234 5678 " * 20, "word " * 60, "a\tb  c   d" * 10, "é" * 30, "ab", ""]
    stats = [quality.statistics(t) for t in texts]
    x = [plain_features(t, s) for t, s in zip(texts, stats, strict=True)]
    assert np.allclose([quality.features(t, s) for t, s in zip(texts, stats, strict=True)], x, atol=1e-6)
    said = quality.votes(np.array(stats), np.array([quality.sentence_ends(t) for t in texts]))
    good = plain_posteriors(said.tolist())
    assert np.allclose(quality.posteriors(said)[0], good, atol=1e-9)
    used = [j for j in range(quality.FEATURES) if any(row[j] for row in x)]
    w, m, v = dict.fromkeys(used, 0.0), dict.fromkeys(used, 0.0), dict.fromkeys(used, 0.0)
    for t in range(1, 41):
        off = [1 / (1 + math.exp(-sum(w[j] * row[j] for j in used))) - g for row, g in zip(x, good, strict=True)]
        for j in used:
            g = sum(o * row[j] for o, row in zip(off, x, strict=True)) / len(x) + 1e-4 * w[j]
            m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
        for j in used:
            w[j] -= 0.1 * (m[j] / (1 - 0.9**t)) / (math.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    found = quality.train(np.array(x), np.array(good), rounds=40)
    assert np.allclose(found[used], [w[j] for j in used], atol=1e-6)
    assert np.allclose(quality.scores(texts, found), [1 / (1 + math.exp(-sum(w[j] * row[j] for j in used))) for row in x], atol=1e-6)


def test_quality_keeps_whole_tables(spark):
    docs = spark.createDataFrame([(1, "A plain line of prose.", 0.1, "x"), (2, None, 0.2, "y"), (3, "é" * 1_000_000, 0.3, "z")], "doc_id long, text string, Quality_Score double, draw string")
    found = quality.scored(docs, quality.fit(docs))
    assert found.columns == ["doc_id", "text", "draw", "quality_score"] and found.count() == 3
    assert quality.scored(docs.limit(0), quality.fit(docs)).count() == 0


def test_grams_are_presence():
    assert (language.grams("abc" * 5) == language.grams("abc" * 900)).all() and language.grams("").sum() == 0


def test_quality_against_labels(spark):
    docs, labels = joined(spark)
    found = quality.op6_quality(spark, DATA).join(labels, "doc_id")
    good, bad = (found.where(f"quality = {q}").agg(F.avg(F.col("keep").cast("int"))).first()[0] for q in (1, 0))
    assert good > 0.99 and bad < 0.05


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "word " * 30_000, 1), (4, "A short line of prose.", 1), (4, "A short line of prose.", 1)], "doc_id long, text string, votes int")
    rows = quality.scored(docs, quality.fit(docs)).collect()
    assert len(rows) == 5 and all(0 <= r.quality_score <= 1 for r in rows) and rows[3] == rows[4]
    assert quality.fit(docs.limit(0)).tolist() == [0.0] * quality.FEATURES


def test_expectation_maximisation_finds_the_rates():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.8
    said = np.full((4000, 4), quality.NOTHING)
    for j, right in enumerate((0.95, 0.9, 0.85)):
        hit = rng.random(4000) < right
        said[:, j] = np.where(truth == hit, quality.GOOD, quality.BAD)
    good, rates = quality.posteriors(said)
    assert ((good > 0.5) == truth).mean() > 0.94 and abs(rates[0][0][quality.GOOD] - 0.95) < 0.03
