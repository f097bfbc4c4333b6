"""SimHash near-duplicate detection with a Gray-order hierarchical index.

A text's fingerprint has a bit set where over half of its shingles' XXH64 values have it.
Fingerprints link when few bits differ. Equal fingerprints are first reduced to one. With
the 64 bits cut into `radius + n` parts, two fingerprints within the radius agree on n
parts at least, so those that share the values of n parts meet in one cell; n is one, and grows with the
number of fingerprints so that cells do not. A cell is indexed as
a tree: its codes are sorted by Gray rank, every node keeps the bits that all codes below it share, and
two nodes whose shared bits already differ too often are dropped with all below them.
A cell gives a spanning forest of its links, not the links, so its output is linear in its
codes. Cells over CELL codes are cut into blocks, and each pair of blocks is a cell.

Null and empty texts have fingerprint zero and link like any other. Equal texts, repeated
rows and ties give equal fingerprints and one component. Rows without an id get a component
but never name one. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, settle, small_batches, table
from .components import components

SEED = 42
BITS = 64
#: Codes in one block of a cell, children of a node, and pairs held at once.
CELL, FAN, PAIRS = 16_384, 16, 1 << 21
#: Fingerprints of a cell on average, beyond which keys get more bits; keys that may be counted in a broadcast table.
MEAN_CELL, MOST_KEYS = 4_096, 1 << 16
#: Fingerprints with a share of the rows of one in so many or more, at most HOT of them, are joined by broadcast.
HOT = 1_000


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 of each run of `words` words, repeats included; of all words if there are fewer."""
    found = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not found:
        return []
    line, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return [digest(line, SEED)]
    ends = list(accumulate(len(w) + 1 for w in found))
    return [digest(line[a : b - 1], SEED) for a, b in zip([0, *ends], ends[words - 1 :], strict=False)]


#: The eight bits of each byte, one in each byte of a word.
SPREAD = np.array([sum((b >> i & 1) << 8 * i for i in range(8)) for b in range(256)], np.uint64)


def majority_bits(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A bit of each group of hashes, `sizes` of them in a row, is set where over half of them have it."""
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    parts = -(-sizes // 255)  # so that sums fit their bytes
    part_of = np.concatenate([[0], np.cumsum(parts)[:-1]])
    starts = np.repeat(first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(part_of, parts))
    sums = np.add.reduceat(SPREAD[flat.astype("<u8").view(np.uint8).reshape(-1, 8)], starts, axis=0)
    counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, BITS), part_of, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(texts: list[str | None], words: int) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    hashes = [shingle_hashes(t, words) for t in texts]
    some = [i for i, h in enumerate(hashes) if h]
    if some:
        sizes = np.array([len(hashes[i]) for i in some])
        flat = np.fromiter((x for i in some for x in hashes[i]), np.uint64, sizes.sum())
        out[some] = majority_bits(flat, sizes)
    return out


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp) of each row; fp holds the 64 bits as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = fingerprints(batch.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_order(codes: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Places of codes, of one word each or a row of words, by cell and Gray rank."""
    ranks, odd = [], np.zeros(len(codes), np.uint64)
    for word in codes.reshape(len(codes), -1).T:
        ranks.append(gray_rank(word) ^ (np.uint64(0) - odd))  # an odd number of bits before a word turns its rank round
        odd = odd ^ (np.bitwise_count(word).astype(np.uint64) & np.uint64(1))
    return np.lexsort((*ranks[::-1], cell))


def bits_of(codes: np.ndarray) -> np.ndarray:
    """How many bits of each code, of one word or a row of words, are set."""
    count = np.bitwise_count(codes)
    return count if codes.ndim == 1 else count.sum(axis=1, dtype=np.int64)


class Forest:
    """Sets of 0..n-1 that are merged by arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                return
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root != (up := self.root[self.root])).any():
                self.root = up


def tree(codes: np.ndarray, cell: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Levels of the index over codes sorted by cell and Gray rank, leaves first.

    A level has, of each node: first child, number of children, cell, shared bits (mask), their values.
    """
    n = len(codes)
    full = np.full(codes.shape, ~np.uint64(0))
    levels = [(np.arange(n), np.ones(n, np.int64), cell, full, codes)]
    while len(levels[-1][2]) > len(np.unique(levels[-1][2])):
        _, _, own, mask, value = levels[-1]
        size = len(own)
        new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        within = np.arange(size) - np.repeat(new, np.diff(np.r_[new, size]))
        first = np.flatnonzero(within % FAN == 0)
        ones, any_one = np.bitwise_and.reduceat(value, first, axis=0), np.bitwise_or.reduceat(value, first, axis=0)
        shared = np.bitwise_and.reduceat(mask, first, axis=0) & ~(ones ^ any_one)
        levels.append((first, np.diff(np.r_[first, size]), own[first], shared, ones & shared))
    return levels


def children(level, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a child of a and a child of b; of a node with itself each pair once."""
    first, count = level[0], level[1]
    ca, cb = count[a], count[b]
    total = ca * cb
    at = np.repeat(np.arange(len(a)), total)
    k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    x, y = first[a][at] + k // cb[at], first[b][at] + k % cb[at]
    keep = (a[at] != b[at]) | (x <= y)
    return x[keep], y[keep]


def tree_pairs(levels: list[tuple[np.ndarray, ...]], radius: int, most: int = PAIRS, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of codes in one cell that differ in `radius` bits at most, each code with itself among them, some `most` at once.

    Nodes whose shared bits differ more often are dropped with all below them. wanted tells pairs of codes that are of use, before their bits are counted.
    """
    top = len(levels) - 1
    roots = np.arange(len(levels[top][0]))
    todo = [(top, roots, roots)]
    while todo:
        depth, a, b = todo.pop()
        if depth == 0:
            yield a, b
            continue
        weight = levels[depth][1][a] * levels[depth][1][b]
        if len(a) > 1 and weight.sum() > most:
            cut = min(max(1, int(np.searchsorted(np.cumsum(weight), most))), len(a) - 1)
            todo += [(depth, a[cut:], b[cut:]), (depth, a[:cut], b[:cut])]
            continue
        x, y = children(levels[depth], a, b)
        if depth == 1 and wanted is not None:
            some = wanted(x, y)
            x, y = x[some], y[some]
        mask, value = levels[depth - 1][3:]
        near = bits_of((value[x] ^ value[y]) & mask[x] & mask[y]) <= radius
        if near.any():
            todo.append((depth - 1, x[near], y[near]))


def link_codes(codes: np.ndarray, cell: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest, as (code, root code), of the links inside cells."""
    order = gray_order(codes, cell)
    codes, cell = codes[order], cell[order]
    unique, number = np.unique(codes, return_inverse=True)
    forest = Forest(len(unique))
    for a, b in tree_pairs(tree(codes, cell), radius):
        off = a != b
        forest.merge(number[a[off]], number[b[off]])
    moved = np.flatnonzero(forest.root != np.arange(len(unique)))
    return unique[moved], unique[forest.root[moved]]


def part_masks(radius: int, same: int = 1) -> list[int]:
    """Masks, as signed longs, of every choice of `same` parts of radius + same parts of the 64 bits."""
    n = radius + same
    cuts = [BITS * i // n for i in range(n + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in (sum(c) for c in combinations(parts, same))]


def parts_for(codes: int, radius: int) -> int:
    """Parts that must agree so that cells hold MEAN_CELL fingerprints on average at most, three if that is not enough."""
    return next((same for same in (1, 2) if codes <= MEAN_CELL << BITS * same // (radius + same)), 3)


def fingerprint_links(codes: DataFrame, radius: int = 4, same: int | None = None) -> DataFrame:
    """(u, v): edges between distinct fingerprints (column fp) with the components that all links have.

    The counts of keys are broadcast only if there are MOST_KEYS keys at most, 40,960 at radius 4 and one part.
    """
    masks = part_masks(radius, parts_for(codes.count(), radius) if same is None else same)
    parts = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks))))
    keyed = codes.select("fp", parts.alias("key")).select("fp", "key.part", "key.bits")
    blocks = keyed.groupBy("part", "bits").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / CELL).cast("int"))
    few = len(masks) << max((m & (1 << BITS) - 1).bit_count() for m in masks) <= MOST_KEYS
    dealt = (
        keyed.join(F.broadcast(blocks) if few else blocks.hint("merge"), ["part", "bits"])
        .withColumn("own", F.pmod(F.xxhash64("fp", "part"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("fp", F.xxhash64("part", "bits", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))
    )

    def run(batches):
        held, size = [], 0

        def links(codes, cell):
            u, v = link_codes(codes.view(np.uint64), cell, radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size < 8 * CELL:
                continue
            codes, cell = (np.concatenate(x) for x in zip(*held, strict=True))
            if cut := int(np.searchsorted(cell, cell[-1])):  # the last cell may go on
                yield links(codes[:cut], cell[:cut])
            held, size = [(codes[cut:], cell[cut:])], len(codes) - cut
        if size:
            yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return map_arrow(dealt.repartition("cell").sortWithinPartitions("cell"), run, "u long, v long", rows=1 << 20)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of each row: the smallest doc_id that its fingerprint reaches by links."""
    return assign(settle(simhash(docs, id_col, text_col, words)), radius)


def assign(prints: DataFrame, radius: int, same: int | None = None) -> DataFrame:
    """Components of a settled table (doc_id, fp)."""
    codes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = components(fingerprint_links(codes.select("fp"), radius, same))
    named = found.join(codes.withColumnRenamed("fp", "node"), "node")
    least = named.groupBy("root").agg(F.min("least").alias("far"))
    far = found.join(least, "root").select(F.col("node").alias("fp"), "far")
    # Written, so that both sides of the last join are plain shuffles.
    whole = settle(codes.join(far, "fp", "left").select("fp", "n", F.coalesce("far", "least").alias("component_id")))
    return spread_join(prints, whole, "fp").select("doc_id", "fp", "component_id")


def spread_join(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """rows joined to values (key, n, ...), n being how many rows a key has: keys with very many rows don't meet in one task.

    They are the keys with one in HOT of the rows or more, so there are HOT at most, and go by broadcast.
    """
    total = rows.count()
    hot = values.where(F.col("n") * HOT >= total).where(F.col("n") > 1)
    met = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return met.unionByName(rest.join(values.where((F.col("n") * HOT < total) | (F.col("n") == 1)), key)).drop("n")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
