"""Document fingerprints by a randomised edit embedding.

A shared random walk reads a text letter by letter: at each step it writes the letter it stands at and, by a bit that
the step and the letter share for all texts, goes on or stays. Texts that differ in a few edits fall into step again,
so their writings differ in few places: edit distance becomes Hamming distance. Of each of WALKS writings a
fingerprint keeps a hexadecimal digit at CELLS places, and likeness is the share of equal digits.

Places are spread over the whole writing, however long: a cell has a random order of all places and takes
the first of those that the writing has, so that texts of about one length are read at the same places.
The bits of a walk repeat after PERIOD steps and are shared by letters whose code points are equal modulo LETTERS.

Classes of near copies: bands of sampled digits deal fingerprints to cells, where all pairs are held against the
least likeness block by block; a cell gives a spanning forest of its links. Equal fingerprints are one
from the start.

A text is never cut. Null and empty texts have a fingerprint of EMPTY signs, which is like no other text's. Equal texts
have equal fingerprints, repeated rows stay, an empty table gives an empty result, and further columns are ignored.
Rows without an id come last in the order of ids; rows of one id are in the order of a hash of their texts,
and pass through one task one by one. A text needs about 40 bytes a letter while it is read.
"""

from __future__ import annotations

import hashlib
from functools import cached_property, lru_cache
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, settle, small_batches, table
from .components import components
from .simhash import Forest, spread_join

WALKS, CELLS = 4, 64
#: Steps after which a walk's bits repeat; letters it tells apart.
PERIOD, LETTERS = 512, 64
EMPTY = "-"
#: Bands of near copies, digits of a band, and the least likeness.
BANDS, DIGITS, LIKE = 24, 6, 0.75
#: Fingerprints of one block of a cell.
BLOCK = 2_048
#: Texts that go side by side at least, and letters of them at most; letters of texts that are held at once, but for one text.
FEW, ROOM, HELD = 8, 1 << 19, 1 << 20
#: Parts of the order of ids, at most.
MOST_PARTS = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed scatter of 64-bit numbers."""
    x = x.astype(np.uint64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(by)
    return x ^ x >> np.uint64(31)


class Walks:
    """Tables of all walks. A state is (walk * PERIOD + step) * LETTERS, so that a state and a letter are a place in a table of states."""

    def __init__(self):
        bits = mix(np.arange(WALKS * PERIOD * LETTERS, dtype=np.uint64)).reshape(WALKS, PERIOD, LETTERS) >> np.uint64(63)
        self.after = np.empty((WALKS, PERIOD, LETTERS), np.int64)
        for walk in range(WALKS):
            for letter in range(LETTERS):
                on = np.flatnonzero(bits[walk, :, letter])
                step = (np.append(on, on[0])[np.searchsorted(on, np.arange(PERIOD))] + 1) % PERIOD
                self.after[walk, :, letter] = (walk * PERIOD + step) * LETTERS
        self.after = self.after.ravel()
        self.places = self.orders()

    @staticmethod
    def orders(most: int = 96) -> np.ndarray:
        """Places of each cell that come before all smaller ones in its order, ascending; the last below a length is the cell's for it."""
        n = WALKS * CELLS
        u = (mix(np.arange(n * most, dtype=np.uint64) + np.uint64(1 << 40)) >> np.uint64(11)).astype(float).reshape(n, most) / 2**53
        out, now = np.zeros((n, most + 1), np.int64), np.zeros(n)
        for i in range(most):
            now = np.minimum(np.floor((now + 1) / np.maximum(u[:, i], 1e-9)), 2.0**60)
            out[:, i + 1] = now
        return out.reshape(WALKS, CELLS, -1)

    @cached_property
    def lists(self) -> list[list]:
        """The same table for one text alone: each state is a list of the state after each letter and, last, its own number."""
        states = [[] for _ in range(WALKS * PERIOD)]
        for i, (state, row) in enumerate(zip(states, (self.after // LETTERS).reshape(-1, LETTERS).tolist(), strict=True)):
            state += [states[x] for x in row]
            state.append(i * LETTERS)
        return states

    def read(self, letters: list[np.ndarray], starts: list[np.ndarray]) -> list[np.ndarray]:
        """For each text the states, a row a walk, in which the walks come to each letter, and leave the last. Texts of about one length go side by side."""
        out: list[np.ndarray] = [None] * len(letters)
        sizes = np.array([len(x) for x in letters], np.int64)
        group: list[int] = []

        def close():
            if len(group) >= FEW:
                for i, x in zip(group, self.side_by_side([letters[i] for i in group], [starts[i] for i in group]), strict=True):
                    out[i] = x
            for i in group if len(group) < FEW else ():
                own = letters[i].tobytes()
                out[i] = np.stack([np.fromiter(map(itemgetter(LETTERS), accumulate(own, getitem, initial=self.lists[s // LETTERS])), np.int64, len(own) + 1) for s in starts[i].tolist()])
            group.clear()

        for i in np.argsort(-sizes, kind="stable").tolist():
            if group and (2 * sizes[i] + 64 < sizes[group[0]] or sizes[group[0]] * (len(group) + 1) > ROOM):
                close()
            group.append(i)
        close()
        return out

    def side_by_side(self, letters: list[np.ndarray], starts: list[np.ndarray]) -> list[np.ndarray]:
        n, most = len(letters), max(map(len, letters))
        grid = np.zeros((n, most), np.int64)
        for row, own in zip(grid, letters, strict=True):
            row[: len(own)] = own
        grid = np.tile(grid.T, WALKS)
        out = np.empty((most + 1, WALKS * n), np.int64)
        out[0] = np.stack(starts, axis=1).ravel()
        at, after = np.empty(WALKS * n, np.int64), self.after
        for now, then, own in zip(out, out[1:], grid, strict=False):
            np.add(now, own, out=at)
            after.take(at, out=then, mode="clip")
        lanes = np.ascontiguousarray(out.T).reshape(WALKS, n, most + 1)
        return [lanes[:, i, : len(own) + 1] for i, own in enumerate(letters)]

    def digits(self, points: np.ndarray, states: np.ndarray) -> str:
        stays = np.diff(states) // LETTERS % PERIOD
        stays[stays == 0] = PERIOD
        ends = np.cumsum(stays, axis=1)
        count = (self.places < ends[:, -1, None, None]).sum(axis=2)
        place = np.take_along_axis(self.places, count[:, :, None] - 1, axis=2)[:, :, 0]
        letter = np.stack([points[np.searchsorted(own, at, "right")] for own, at in zip(ends, place, strict=True)]).astype(np.uint64)
        walk = np.arange(WALKS, dtype=np.uint64)[:, None] << np.uint64(32)
        found = mix(mix(letter + walk) + place.astype(np.uint64)) >> np.uint64(60)
        return found.astype(np.uint8).tobytes().hex()[1::2]


@lru_cache(maxsize=1)
def walks() -> Walks:
    return Walks()


class Readings:
    """Texts, the states of all walks on them, and their fingerprints: CELLS digits of each walk."""

    def __init__(self, texts: list[str | None]):
        self.texts = [t or "" for t in texts]
        points = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in self.texts]
        first = np.arange(WALKS, dtype=np.int64) * PERIOD * LETTERS
        self.states = walks().read([(p & (LETTERS - 1)).astype(np.uint8) for p in points], [first] * len(points))
        self.prints = [walks().digits(p, s) if len(p) else EMPTY * (WALKS * CELLS) for p, s in zip(points, self.states, strict=True)]

    def edited(self, then: list[str]) -> list[tuple[str, str]]:
        """Each text with its last half replaced by the first letters of another, and its fingerprint. The walks don't read the first half again."""
        halves = [len(t) // 2 for t in self.texts]
        texts = [t[: len(t) - h] + other[:h] for t, h, other in zip(self.texts, halves, then, strict=True)]
        heads = [len(t) - h for t, h in zip(self.texts, halves, strict=True)]
        points = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in texts]
        tails = walks().read([(p[n:] & (LETTERS - 1)).astype(np.uint8) for p, n in zip(points, heads, strict=True)], [s[:, n] for s, n in zip(self.states, heads, strict=True)])
        return [
            (t, walks().digits(p, np.concatenate([s[:, :n], tail], axis=1)) if t else own)
            for t, p, s, n, tail, own in zip(texts, points, self.states, heads, tails, self.prints, strict=True)
        ]


def likeness(a: str, b: str) -> float:
    """Share of equal digits, 0 to 1."""
    return float(np.mean(np.frombuffer(a.encode(), np.uint8) == np.frombuffer(b.encode(), np.uint8)))


def held_at_once(rows: list, text_of=lambda row: row):
    """Runs of rows whose texts have HELD letters together, or of one row."""
    own, size = [], 0
    for row in rows:
        n = len(text_of(row) or "")
        if own and size + n > HELD:
            yield own
            own, size = [], 0
        own.append(row)
        size += n
    if own:
        yield own


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for own in held_at_once(batch.column(1).to_pylist()) for x in Readings(own).prints], pa.string())], ["doc_id", "fingerprint"])

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, "doc_id long, fingerprint string")


def near_links(prints: DataFrame, like: float = LIKE, bands: int = BANDS, digits: int = DIGITS) -> DataFrame:
    """(u, v): edges between rows (node, fingerprint) of different fingerprints with the components that all links found by bands have.

    Two fingerprints of likeness s share a band with probability 1 - (1 - s^digits)^bands.
    """
    at = np.stack([np.random.default_rng(b).choice(WALKS * CELLS, digits, replace=False) for b in range(bands)]).tolist()
    keys = F.array(*(F.xxhash64(F.lit(b), *(F.substring("fingerprint", i + 1, 1) for i in own)) for b, own in enumerate(at)))
    keyed = prints.select("node", "fingerprint", F.explode(keys).alias("key"))
    sizes = keyed.groupBy("key").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    dealt = (
        keyed.join(sizes.select("key", "blocks").hint("merge"), "key")
        .withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "fingerprint", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))
    )

    def links(nodes, codes):
        forest, rows = Forest(len(nodes)), np.stack([np.frombuffer(c.encode(), np.uint8) for c in codes])
        least = int(np.ceil(like * rows.shape[1] - 1e-9))
        for i in range(len(nodes) - 1):
            rest = i + 1 + np.flatnonzero(forest.root[i + 1 :] != forest.root[i])
            near = rest[(rows[rest] == rows[i]).sum(axis=1) >= least]
            forest.merge(np.full(len(near), i), near)
        moved = np.flatnonzero(forest.root != np.arange(len(nodes)))
        return [nodes[i] for i in moved], [nodes[i] for i in forest.root[moved]]

    def run(batches):
        cell, nodes, codes = None, [], []
        for batch in batches:
            out = [[], []]
            for node, code, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != cell:
                    for side, x in zip(out, links(nodes, codes) if len(nodes) > 1 else ((), ()), strict=True):
                        side += x
                    cell, nodes, codes = own, [], []
                nodes.append(node)
                codes.append(code)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["u", "v"])
        if len(nodes) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links(nodes, codes)], ["u", "v"])

    return map_arrow(dealt.repartition("cell").sortWithinPartitions("cell"), run, "u long, v long", rows=1 << 12)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: float = LIKE) -> DataFrame:
    """(doc_id, fingerprint, class_id) of each row: the smallest doc_id that its fingerprint reaches by links of the least likeness."""
    prints = settle(fingerprints(docs, id_col, text_col))
    different = settle(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    found = components(near_links(different.select("node", "fingerprint"), like))
    ends = found.join(different, "node").groupBy("root").agg(F.min("least").alias("far"))
    far = found.join(ends, "root").select("node", "far")
    named = settle(different.join(far, "node", "left").select("fingerprint", "n", F.coalesce("far", "least").alias("class_id")))
    return spread_join(prints, named, "fingerprint").select("doc_id", "fingerprint", "class_id")


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (part, border, doc_id, text), dealt and sorted so that each is followed by the next document, descending ids.

    Ids are cut into parts by their percentiles, MOST_PARTS of them at most. The last row of a part is followed by a copy of the first
    of the next part, its border; after the last part comes the first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    n = max(1, min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_PARTS))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 10 * n))).first()[0]
    bounds = np.unique(np.array(cuts or [], np.int64))

    def part_of(null, ids):
        return np.where(null, 0, 1 + np.searchsorted(bounds, ids, "left"))

    @F.pandas_udf("int")
    def part(null, ids):
        import pandas as pd

        return pd.Series(part_of(null.to_numpy(), ids.to_numpy()).astype(np.int32))

    null, ids = F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0))
    parted = rows.withColumn("part", part(null, ids))
    # One row a part: its first, and so the border of the part before it.
    first = sorted(((r["part"], r["first"]) for r in rows.select(part(null, ids).alias("part"), F.struct("doc_id", "h").alias("row")).groupBy("part").agg(F.max("row").alias("first")).collect()), reverse=True)
    if not first:
        return parted.select("part", F.lit(False).alias("border"), "doc_id", "text")
    before = [first[-1][0], *(p for p, _ in first)]
    borders = spark.createDataFrame([(p, r["doc_id"], r["h"], b) for (p, r), b in zip(first, before, strict=False)], "part int, first_id long, first_h long, goes_to int")
    met = parted.join(F.broadcast(borders), "part", "left").withColumn("opens", F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")))
    own, copy = F.struct("part", F.lit(False).alias("border")), F.struct(F.col("goes_to").alias("part"), F.lit(True).alias("border"))
    placed = met.select("doc_id", "text", "h", F.explode(F.when(F.col("opens"), F.array(own, copy)).otherwise(F.array(own))).alias("to"))
    order = ("part", "border", F.desc_nulls_last("doc_id"), F.desc("h"))
    return placed.select("to.part", "to.border", "doc_id", "text", "h").repartition("part").sortWithinPartitions(*order).drop("h")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row: its text, and the text with its last half
    replaced by the first letters of the next document."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    kinds = (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64())

    def run(batches):
        waits = None  # (id, text) of the row whose next document is still to come
        for batch in batches:
            met = []
            for border, doc_id, text in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if waits is not None:
                    met.append((*waits, text or ""))
                waits = None if border else (doc_id, text or "")
            out = []
            for own in held_at_once(met, lambda row: row[1]):
                ids, texts, then = zip(*own, strict=True)
                found = Readings(texts)
                # A row's next document is mostly the row after it.
                new = Readings([t for t, after in zip(then, [*texts[1:], None], strict=True) if t is not after])
                late = iter(new.prints)
                prints = [p if t is after else next(late) for t, after, p in zip(then, [*texts[1:], None], [*found.prints[1:], ""], strict=True)]
                for doc_id, text, own_print, (edited, print_), next_print in zip(ids, texts, found.prints, found.edited(then), prints, strict=True):
                    out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own_print, print_, likeness(own_print, print_), likeness(own_print, next_print)))
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return map_arrow(beside_next(docs, id_col, text_col), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op11_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
