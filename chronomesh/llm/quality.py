"""Quality classifier without labels: heuristic voters, their accuracies, and a linear scorer.

Each voter looks at statistics of a text and says good, bad or nothing. Expectation-maximisation
on the votes of a bounded sample estimates how often each voter says what of a good and of a bad
text, and with it how likely each sampled text is good. These posteriors train a
logistic scorer on hashed features: runs of four character shapes, and the statistics in steps.

The sample has `sample` texts chosen by hash (SAMPLE unless given); votes and features, 4 KB a text, are
made where texts lie, and only they are moved. Null and empty texts have no
feature but the constant one, whose weight is that of an average text, and are judged by it. Texts of
any length are taken whole. Equal texts get equal scores. If the sample is empty, every score is 0.5 and
all are kept. A column of a table that has the name of the score is replaced.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, small_batches, table, without

SAMPLE, FEATURES, KEEP = 2_000, 2_048, 0.5
#: Feature 0 is constant; statistics in steps have the features after it.
STEPS, NAMES = 16, ("symbols", "repeats", "upper", "variety", "digits", "spaces")
GRAMS_AT = 1 + STEPS * len(NAMES)
GOOD, BAD, NOTHING = 0, 1, 2

#: Shape of each byte: letters and bytes of longer characters are alike, as are digits and spaces.
SHAPE = np.arange(256, dtype=np.uint32)
SHAPE[ord("a") : ord("z") + 1] = SHAPE[128:] = ord("a")
SHAPE[ord("A") : ord("Z") + 1] = ord("A")
SHAPE[ord("0") : ord("9") + 1] = ord("0")
SHAPE[[9, 11, 12, 13]] = 32

#: A voter says bad from the second bound on (below it, where less is worse), and nothing before.
VOTERS = {"symbols": 0.09, "repeats": 0.30, "upper": 0.50, "variety": -0.30, "digits": 0.65, "spaces": 0.50}
#: Where all statistics stay within these bounds, the voter for plain prose says good.
PROSE = {"symbols": 0.05, "repeats": 0.20, "upper": 0.30, "variety": -0.40, "digits": 0.60, "spaces": 0.40}


def statistics(text: str) -> np.ndarray:
    """Shares: symbols of visible bytes, equal neighbours of words, capitals of letters, different words, digits, spaces."""
    raw = text.encode()
    counts = np.bincount(SHAPE[np.frombuffer(raw, np.uint8)], minlength=256)
    letters, spaces, digits = counts[97] + counts[65], counts[32] + counts[10], counts[48]
    visible = max(1, len(raw) - spaces)
    plain = letters + digits + counts[[ord(c) for c in ".,;:'-()\""]].sum()
    words = text.split()
    near = sum(map(eq, words, words[1:])) / max(1, len(words) - 1)
    expected = len(words) ** 0.8 or 1  # long texts repeat their words
    variety = min(1.0, len(set(words)) / expected)
    return np.array([1 - min(1.0, plain / visible), near, counts[65] / max(1, letters), variety, digits / visible, spaces / max(1, len(raw))])


def votes(stats: np.ndarray, sentences: np.ndarray) -> np.ndarray:
    """A column for each voter: one for each statistic, one for prose, one for sentence ends."""
    out = np.full((len(stats), len(NAMES) + 2), NOTHING)
    prose = np.ones(len(stats), bool)
    for j, name in enumerate(NAMES):
        sign = -1 if VOTERS[name] < 0 else 1
        out[sign * stats[:, j] >= VOTERS[name], j] = BAD
        prose &= sign * stats[:, j] <= PROSE[name]
    out[prose, -2] = GOOD
    out[(sentences >= 0.02) & (sentences <= 0.4), -1] = GOOD
    return out


def sentence_ends(text: str) -> float:
    """Share of words that end a sentence."""
    words = text.split()
    return sum(w.endswith((".", "?")) for w in words) / max(1, len(words))


def features(text: str, stats: np.ndarray) -> np.ndarray:
    out = np.zeros(FEATURES, np.float32)
    out[0] = 1
    if not text:
        return out
    out[1 + STEPS * np.arange(len(NAMES)) + np.minimum(STEPS - 1, (stats * STEPS).astype(int))] = 1
    shape = SHAPE[np.frombuffer(text.encode(), np.uint8)]
    if len(shape) > 3:
        code = shape[:-3] * np.uint32(0x9E3779B1) + shape[1:-2] * np.uint32(0x85EBCA77) + shape[2:-1] * np.uint32(0xC2B2AE3D) + shape[3:] * np.uint32(0x27D4EB2F)
        code ^= code >> np.uint32(15)
        place = GRAMS_AT + (code * np.uint32(0x2C1B3C6D) >> np.uint32(8)) % np.uint32(FEATURES - GRAMS_AT)
        seen = np.bincount(place, minlength=FEATURES)
        out += np.sqrt(seen / len(code)).astype(np.float32)
    return out


def posteriors(said: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each text is good; and P(says good, bad, nothing | class) of each voter.

    Silence counts as well: a voter that is silent on most good texts says something by it.
    """
    good = np.where((said == BAD).any(axis=1), 0.05, 0.95)
    one_hot = np.stack([said == v for v in (GOOD, BAD, NOTHING)], axis=2).astype(float)
    for _ in range(rounds):
        rates = []
        for weight in (good, 1 - good):
            hits = np.einsum("i,ijv->jv", weight, one_hot) + 0.1
            rates.append(hits / hits.sum(axis=1, keepdims=True))
        share = (good.sum() + 1) / (len(good) + 2)
        log = np.einsum("ijv,jv->i", one_hot, np.log(rates[0]) - np.log(rates[1])) + np.log(share / (1 - share))
        good = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return good, np.array(rates)


def train(x: np.ndarray, target: np.ndarray, rounds: int = 300, rate: float = 0.1, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by Adam's steps."""
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - target) / len(target) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """Weights of the hashed features."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col, text_col).alias("draw")).where("text is not null and text <> ''")

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            stats = [statistics(t) for t in texts]
            said = [votes(s[None], np.array([sentence_ends(t)]))[0].tolist() for t, s in zip(texts, stats, strict=True)]
            seen = [features(t, s).astype("<f2").tobytes() for t, s in zip(texts, stats, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(said, pa.list_(pa.int32())), pa.array(seen, pa.binary())], ["draw", "tie", "votes", "x"])

    total = docs.count()
    share = min(1.0, (1.5 * sample + 10) / max(1, total))  # so that the few rows that are drawn are all that is worked on
    drawn = rows.where(F.pmod("draw", F.lit(1 << 30)) < int(share * (1 << 30))).withColumn("tie", F.xxhash64("text"))
    got = map_arrow(drawn, run, "draw long, tie long, votes array<int>, x binary").orderBy("draw", "tie").limit(sample).collect()
    if not got:
        return np.zeros(FEATURES)
    good, _ = posteriors(np.array([r["votes"] for r in got]))
    return train(np.stack([np.frombuffer(r["x"], "<f2").astype(float) for r in got]), good)


def scores(texts: list[str | None], weights: np.ndarray) -> list[float]:
    x = np.stack([features(t or "", statistics(t or "")) for t in texts]) if texts else np.zeros((0, FEATURES))
    return (1 / (1 + np.exp(-np.clip((x * weights).sum(axis=1), -30, 30)))).tolist()  # summed in one order, whatever the batch


def scored(docs: DataFrame, weights: np.ndarray, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """docs with one column more, the score."""
    small_batches(docs.sparkSession)
    docs = without(docs, score_col)
    at = docs.columns.index(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{score_col}` double"])

    def run(batches):
        for batch in batches:
            found = scores(batch.column(at).to_pylist(), weights)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, score_col])

    return map_arrow(docs, run, schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", "quality_score", (F.col("quality_score") >= KEEP).alias("keep"))
