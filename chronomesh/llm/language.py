"""Language identification by string kernels with Nystroem landmarks.

Two texts are as alike as the share of byte n-grams (n = 1 to 3, hashed to BUCKETS) that occur
in both: k(x, y) = |X & Y| / sqrt(|X| |Y|), presence only, all orders blended. Kernel ridge
regression, one language against the rest, is fitted on a bounded sample through a few landmark
texts, at most ALL_LANDMARKS in all, and a batch of texts is scored by matrix products. The first has whole numbers and the
second is summed in one order for each text alone, so a text's score does not depend on the texts beside it.

The sample has at most `per_language` labelled texts of each language and `sample` in all, shared evenly
where there are many languages, chosen by hash; every language that has a label is learned, though with more than ALL_LANDMARKS of them some
have no landmark of their own. Texts become n-gram sets of 4 KB where they lie, and only sets are moved. The driver needs some 0.5 GB at most; the
model that is sent has packed landmarks, 7 MB at most, and a weight of each for each language. Labels, ids and sources are never
inputs of a prediction. Null texts and texts without a letter are `und` with score 0; texts of any
length are taken whole. Equal texts get equal predictions. If nothing can be learned, all texts are
`und`. Columns of a table that have the names of the result are replaced.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, small_batches, table, without

BITS = 15
BUCKETS = 1 << BITS
#: Bounds of the labelled sample, in all and of each language, landmarks of each language, and the ridge.
SAMPLE, PER_LANGUAGE, LANDMARKS, RIDGE = 25_600, 400, 40, 1e-3
#: Landmarks in all; sets that are unpacked at once.
ALL_LANDMARKS, UNPACKED = 1_600, 512
UNKNOWN = "und"
#: A text is strange if less of its n-grams are its language's than this share of what 95% of the sample reach.
STRANGE = 0.75


def grams(text: str) -> np.ndarray:
    """Presence of each hashed n-gram."""
    out = np.zeros(BUCKETS, bool)
    codes = np.frombuffer(text.encode().lower(), np.uint8).astype(np.uint32)
    out[codes] = True
    for _ in range(2):
        if len(codes) < 2:
            break
        codes = codes[:-1] * np.uint32(0x01000193) + codes[1:] * np.uint32(0x9E3779B1)
        codes ^= codes >> np.uint32(15)
        out[(codes * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)] = True
    return out


def packed(texts: list[str]) -> np.ndarray:
    """Their n-gram sets, a row of bits each."""
    return np.stack([np.packbits(grams(t)) for t in texts])


def unpacked(sets: np.ndarray) -> np.ndarray:
    return np.unpackbits(sets, axis=1).astype(bool)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class KernelModel:
    """Landmarks, restricted to the n-grams that they have, and a weight of each for each language. Sets are rows of packed bits."""

    def __init__(self, sets: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, most: int = ALL_LANDMARKS):
        self.languages, place = np.unique(np.array(labels, str), return_inverse=True)
        self.languages = self.languages.tolist()
        if not labels:
            return
        turn = np.zeros(len(labels), int)  # a set's number among those of its language
        by_language = np.argsort(place, kind="stable")
        turn[by_language] = np.arange(len(labels)) - np.searchsorted(place[by_language], place[by_language])
        chosen = np.lexsort((np.arange(len(labels)), place, turn))  # first sets of all languages, then second ones
        chosen = np.sort(chosen[: min(most, int((turn < landmarks).sum()))])
        chosen = chosen[np.argsort(place[chosen], kind="stable")]
        self.packed, self.of = sets[chosen], place[chosen]
        k = self.kernel(sets).astype(float)
        sums = np.zeros((len(chosen), len(self.languages)))
        np.add.at(sums.T, place, k)
        inner = self.kernel(sets[chosen]).astype(float)
        left = k.T @ k + ridge * len(labels) * inner + 1e-9 * np.eye(len(chosen))
        self.weights = np.ascontiguousarray(np.linalg.solve(left, 2 * sums - k.sum(axis=0)[:, None]).T.astype(np.float32))
        own = np.zeros(len(sets), int)
        own[chosen] = 1  # a landmark is held against the others
        self.least = STRANGE * float(np.quantile(self.known(sets, place, own), 0.05))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("columns", "marks", "sizes", "count")}

    @cached_property
    def columns(self) -> np.ndarray:
        return np.flatnonzero(unpacked(np.bitwise_or.reduce(self.packed, axis=0)[None])[0])

    @cached_property
    def marks(self) -> np.ndarray:
        return unpacked(self.packed)[:, self.columns].astype(np.float32)

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.maximum(unpacked(self.packed).sum(axis=1), 1).astype(np.float32)

    @cached_property
    def count(self) -> dict[int, np.ndarray]:
        """How many landmarks of a language have each n-gram."""
        return {int(i): (self.marks[self.of == i] > 0).sum(axis=0).astype(np.uint16) for i in np.unique(self.of)}

    def kernel(self, sets: np.ndarray) -> np.ndarray:
        out = np.empty((len(sets), len(self.packed)), np.float32)
        for at in range(0, len(sets), UNPACKED):
            some = unpacked(sets[at : at + UNPACKED])
            own = np.maximum(some.sum(axis=1), 1).astype(np.float32)
            out[at : at + UNPACKED] = (some[:, self.columns].astype(np.float32) @ self.marks.T) / np.sqrt(own[:, None] * self.sizes)
        return out

    def known(self, sets: np.ndarray, place: np.ndarray, own: np.ndarray | int = 0) -> np.ndarray:
        """Share of each set's n-grams that over `own` landmarks of its language have."""
        least, none = np.broadcast_to(own, len(sets)), np.zeros(len(self.columns), np.uint16)
        out = np.empty(len(sets))
        for i, (x, p, n) in enumerate(zip(sets, place.tolist(), least.tolist(), strict=True)):
            one = unpacked(x[None])[0]
            out[i] = np.count_nonzero(one[self.columns] & (self.count.get(p, none) > n)) / max(1, one.sum())
        return out

    def predict(self, texts: list[str | None], strict: bool = False) -> tuple[list[str], list[float]]:
        """Languages and scores; if strict, texts in none of the languages are unknown."""
        found, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        if some:
            sets = packed([texts[i] for i in some])
            near = self.kernel(sets)
            values = np.stack([(near * w).sum(axis=1) for w in self.weights], axis=1)
            best = values.argmax(axis=1)
            stays = self.known(sets, best) >= self.least if strict else np.ones(len(some), bool)
            for i, b, v, s in zip(some, best.tolist(), np.clip((1 + values.max(axis=1)) / 2, 0, 1).tolist(), stays.tolist(), strict=True):
                if s:
                    found[i], scores[i] = self.languages[b], v
        return found, scores


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that nothing is learned from; rows without an id are not in it."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, per_language: int = PER_LANGUAGE) -> KernelModel:
    """Learn from texts with a language that are not held out."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy("lang").limit(sample + 1).collect()}
    if len(counts) > sample:
        raise ValueError(f"more than {sample} languages: give a larger sample")
    if not counts:
        return KernelModel(np.zeros((0, BUCKETS // 8), np.uint8), [])
    each = min(per_language, sample // len(counts))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    shares = rows.sparkSession.createDataFrame([(lang, int(min(1.0, (1.5 * each + 10) / n) * (1 << 30))) for lang, n in counts.items()], "lang string, share long")
    drawn = rows.join(F.broadcast(shares), "lang").select("lang", "text", draw.alias("draw"), F.xxhash64("text").alias("tie"), "share").where("draw < share").drop("share")

    def run(batches):
        for batch in batches:
            sets = [x.tobytes() for x in packed(batch.column(1).to_pylist())] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(sets, pa.binary())], ["lang", "draw", "tie", "grams"])

    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "tie"))
    taken = map_arrow(drawn, run, "lang string, draw long, tie long, grams binary").withColumn("place", place).where(F.col("place") <= each)
    got = sorted(taken.collect(), key=lambda r: (r["draw"], r["tie"], r["lang"]))
    sets = np.frombuffer(b"".join(bytes(r["grams"]) for r in got), np.uint8).reshape(-1, BUCKETS // 8)
    return KernelModel(sets, [r["lang"] for r in got])


def predicted(docs: DataFrame, model: KernelModel, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", strict: bool = False) -> DataFrame:
    """docs with two columns more, the language and its score."""
    small_batches(docs.sparkSession)
    docs = without(docs, lang_col, score_col)
    at = docs.columns.index(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{lang_col}` string, `{score_col}` double"])

    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found, scores = sent.value.predict(batch.column(at).to_pylist(), strict)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, lang_col, score_col])

    return map_arrow(docs, run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    small_batches(spark)
    found = predicted(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
