"""Near copies: texts whose sets of shingles have a given Jaccard similarity at least.

Fingerprints propose pairs, and the exact similarity of the two sets decides. Texts with one set of
shingles are reduced to one before all else. Of a set are kept its size, a SimHash fingerprint of
WORDS * 64 bits over its different shingles, and BANDS keys, each of MINIMA min-wise
samples of the set. Two sets of similarity s share a key with probability s ** MINIMA, and sets
that share few shingles hardly ever do, however many there are, which bands of SimHash bits
can't give at similarity 0.8. Sets that share a key are a cell. A cell's fingerprints are searched by the tree
of `simhash`, in Gray order: whole branches whose shared bits already differ too often are dropped.

1. Within a cell, fingerprints give a spanning forest of near pairs. Each set keeps two pairs of
   all its cells at most, which are checked exactly. So a large group of copies costs little more than its size.
2. In cells that still hold several groups, sets that are near one of another group bring
   their shingles along, and all such pairs are checked in the cell's task, nearest first,
   until no near pair of two groups is unchecked. Only links leave the task.

Cells over CELL sets are cut: in step 1 into blocks, and in step 2 the sets of the largest group go into
blocks that all others meet, so that work grows with the square of the others only.

Texts without words are copies of each other and of no other text. Equal texts and repeated
rows are in one group. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, map_arrow, settle, small_batches
from .components import components
from .simhash import Forest, bits_of, gray_order, majority_bits, spread_join, tree, tree_pairs

#: Pairs at similarity 0.8 share a key with probability 1 - (1 - 0.8 ** 4) ** 16 = 0.9998.
WORDS, BANDS, MINIMA = 4, 16, 4
#: Standard deviations by which the bits of a pair may exceed what is expected; sets below FEW shingles are not judged by bits.
SLACK, FEW = 6, 48
#: Sets in one block of a cell.
CELL = 4_096
#: Cells up to this many sets are compared side by side, and pairs that are compared at once.
SMALL_CELL, PART = 48, 1 << 18

#: Base of the hash of a run of bytes, a polynomial modulo 2 ** 64 that is mixed afterwards.
BASE = 0x9E3779B97F4A7C15 | 1
WORD = (1 << 64) - 1


def most_bits(similarity: float) -> int:
    """Differing bits of texts that are so similar, and SLACK standard deviations more, as the exact similarity decides later."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(64 * WORDS * share + SLACK * math.sqrt(64 * WORDS * share * (1 - share)))


def mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Another 64 bits from each hash."""
    h = (h ^ np.uint64(0x9E3779B97F4A7C15 * (word + 1) & WORD)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


class Powers:
    """Powers of BASE and of its inverse modulo 2 ** 64, as many as the longest text has asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 16)
            factors = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
            for f in factors:
                f[0] = 1
            self.up, self.down = (np.cumprod(f, dtype=np.uint64) for f in factors)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The different runs of `words` words, all words if there are fewer, as sorted hashes."""
    line = b" ".join((text or "").encode().lower().split())  # bytes: A-Z only, and the six ASCII spaces
    if not line:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(line, np.uint8)
    up, down = POWERS.of(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    spaces = np.flatnonzero(data == 32)
    first, last = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(data)]])
    n = max(1, len(first) - words + 1)
    first, last = first[:n], last[-n:]
    return np.unique(mixed((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64), 0))


def set_name(own: np.ndarray) -> int:
    """64 bits that name a set, as a signed long."""
    return xxhash.xxh3_64_intdigest(own.astype("<u8").tobytes()) - (1 << 63)


def starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, int)


def set_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """WORDS times 64 bits of each set, a bit set where over half of its shingles have it."""
    out = np.zeros((len(sets), WORDS), np.uint64)
    some = [i for i, h in enumerate(sets) if len(h)]
    if some:
        sizes, flat = np.array([len(sets[i]) for i in some]), np.concatenate([sets[i] for i in some])
        for word in range(WORDS):
            out[some, word] = majority_bits(mixed(flat, word + 1), sizes)
    return out


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS keys of each set, of MINIMA samples each; a sample is the least of the set's hashes under one of many orders."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    some = [i for i, h in enumerate(sets) if len(h)]
    if some:
        flat, at = np.concatenate([sets[i] for i in some]), starts(np.array([len(sets[i]) for i in some]))
        for band in range(BANDS):
            key = np.full(len(some), band, np.uint64)
            for i in range(MINIMA):
                factor = np.uint64(xxhash.xxh64_intdigest(b"sample", seed=band * MINIMA + i) | 1)
                key = mixed(key ^ np.minimum.reduceat(flat * factor >> np.uint64(16), at), band)
            out[some, band] = key
    return out


def near_prints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, t1, t2, node, size, code, keys) of each row; node names the set of shingles, t1 and t2 name the text."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch.column(3).to_pylist()]
            codes, keys = set_fingerprints(sets), set_keys(sets).view(np.int64)
            columns = [
                pa.array([set_name(s) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array([c.tobytes() for c in codes], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["doc_id", "t1", "t2", "node", "size", "code", "keys"])

    return map_arrow(named(docs, id_col, text_col), run, "doc_id long, t1 long, t2 long, node long, size int, code binary, keys array<long>")


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t1, t2, text) with two longs that name the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))


def sets_of(docs: DataFrame, id_col: str, text_col: str, words: int, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted nodes (node, first), once each; first is a row (doc_id, t1, t2) that has the set."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, words).astype("<u8").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    rows = wanted.select("node", F.col("first.t1").alias("t1"), F.col("first.t2").alias("t2"), F.col("first.doc_id").alias("id"))
    met = named(docs, id_col, text_col).join(rows.hint("merge"), ["t1", "t2"]).where(F.col("doc_id").eqNullSafe(F.col("id")))
    return map_arrow(met.select("node", "text"), run, "node long, shingles binary").dropDuplicates(["node"])


def common(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Elements that each of the others, sorted and not empty, has in common with x."""
    flat, sizes = np.concatenate(others), np.array([len(y) for y in others])
    at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
    return np.add.reduceat((x[at] == flat).astype(np.int64), starts(sizes))


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets have at least this Jaccard similarity."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                both = int(common(x, [y])[0])
                keep.append(both / (len(x) + len(y) - both) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    one, other = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"of_{n}")).hint("merge") for n in ("u", "v"))
    return map_arrow(pairs.join(one, "u").join(other, "v").select("u", "v", "of_u", "of_v"), run, "u long, v long")


def span(forest: Forest, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of the pairs that join two sets of the forest, earlier pairs first."""
    used, at = [], np.arange(len(a))
    while len(at):
        x, y = forest.root[a[at]], forest.root[b[at]]
        at, x, y = at[x != y], x[x != y], y[x != y]
        if not len(at):
            break
        high, first = np.unique(np.maximum(x, y), return_index=True)
        used.append(at[first])
        forest.root[high] = np.minimum(x, y)[first]  # each points lower, so there is no ring
        while (forest.root != (up := forest.root[forest.root])).any():
            forest.root = up
    return np.concatenate(used) if used else np.zeros(0, int)


def cells(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and size of each run of one cell."""
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, int)
    return first, np.diff(np.r_[first, len(cell)])


def pairs_in(cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one cell, in parts; rows are sorted by cell."""
    first, size = cells(cell)
    small = np.flatnonzero((size > 1) & (size <= SMALL_CELL))
    for n in np.unique(size[small]).tolist():
        x, y = np.triu_indices(n, 1)
        own = first[small[size[small] == n]]
        step = max(1, PART // len(x))
        for at in range(0, len(own), step):
            yield (own[at : at + step, None] + x).ravel(), (own[at : at + step, None] + y).ravel()
    for f, n in zip(first[size > SMALL_CELL].tolist(), size[size > SMALL_CELL].tolist(), strict=True):
        step = max(1, PART // n)
        for at in range(0, n, step):
            x = np.arange(at, min(n, at + step))
            y = np.arange(at + 1, n)
            a, b = np.repeat(x, len(y)), np.tile(y, len(x))
            yield f + a[a < b], f + b[a < b]


class Judge:
    """Which pairs of rows may be as similar as `similarity`, by their sizes and fingerprints."""

    def __init__(self, codes: np.ndarray, size: np.ndarray, similarity: float):
        self.codes, self.size, self.similarity, self.radius = codes, size.astype(np.int64), similarity, most_bits(similarity)

    def near(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that may be, nearest first, and their differing bits."""
        low, high = np.minimum(self.size[a], self.size[b]), np.maximum(self.size[a], self.size[b])
        fits = low / np.maximum(high, 1) >= self.similarity
        a, b, high = a[fits], b[fits], high[fits]
        bits = bits_of(self.codes[a] ^ self.codes[b])
        order = np.argsort(bits, kind="stable")
        order = order[(bits[order] <= self.radius) | (high[order] < FEW)]
        return a[order], b[order], bits[order]


def met_in(judge: Judge, cell: np.ndarray, apart) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (a, b) of rows of one cell, a < b, that are apart and may be near by their bits, in parts; rows are sorted by cell.

    Pairs of sets below FEW shingles, which bits don't tell, are all met; all others are sought in the tree.
    """
    few = judge.size < FEW
    small = np.flatnonzero(few)
    for a, b in pairs_in(cell[small]):
        a, b = small[a], small[b]
        keep = apart(a, b)
        yield a[keep], b[keep]
    order = gray_order(judge.codes, cell)

    def wanted(x, y):
        a, b = order[x], order[y]
        return (a != b) & ~(few[a] & few[b]) & apart(a, b)

    for x, y in tree_pairs(tree(judge.codes[order], cell[order]), judge.radius, PART, wanted):
        off = x != y  # of cells of one row
        a, b = order[x[off]], order[y[off]]
        yield np.minimum(a, b), np.maximum(a, b)


def cell_forest(judge: Judge, cell: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spanning forest of the near pairs inside cells, as rows and bits: pairs with a cell's first row, then the nearest ones."""
    forest, out = Forest(int(number.max()) + 1 if len(number) else 0), []
    first, size = cells(cell)
    apart = lambda a, b: forest.root[number[a]] != forest.root[number[b]]
    for a, b in chain([(np.repeat(first, size), np.arange(len(cell)))], met_in(judge, cell, apart)):
        off = apart(a, b)
        a, b, bits = judge.near(a[off], b[off])
        used = span(forest, number[a], number[b])
        out.append((a[used], b[used], bits[used]))
    return tuple(np.concatenate([np.zeros(0, int), *x]) for x in zip(*out, strict=True))


def strangers(judge: Judge, cell: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Rows that are near a row of another label in their cell."""
    found = np.zeros(len(cell), bool)
    for a, b in met_in(judge, cell, lambda a, b: label[a] != label[b]):
        a, b, _ = judge.near(a, b)
        found[a] = found[b] = True
    return np.flatnonzero(found)


def exact_links(judge: Judge, cell: np.ndarray, label: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that link labels: of all near pairs in cells, those as similar as asked, until labels are one."""
    number, left, right = np.unique(label, return_inverse=True)[1], [], []
    forest = Forest(int(number.max()) + 1 if len(number) else 0)
    for a, b in met_in(judge, cell, lambda a, b: forest.root[number[a]] != forest.root[number[b]]):
        a, b, _ = judge.near(a, b)
        order = np.argsort(a, kind="stable")  # by row, its nearest first
        a, b = a[order], b[order]
        for x, own in zip(*by_row(a, b), strict=True):
            for at in range(0, len(own), 64):
                now = own[at : at + 64]
                now = now[forest.root[number[now]] != forest.root[number[x]]]
                if not len(now):
                    continue
                both = common(sets[x], [sets[i] for i in now])
                fine = now[both / (len(sets[x]) + judge.size[now] - both) >= judge.similarity]
                used = fine[span(forest, np.full(len(fine), number[x]), number[fine])]
                left += [x] * len(used)
                right += used.tolist()
    return np.array(left, int), np.array(right, int)


def by_row(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Each different value of a, which is sorted, and its values of b."""
    first, _ = cells(a)
    return a[first].tolist(), np.split(b, first[1:]) if len(first) else []


def whole_cells(rows: DataFrame, names: list[str], do, schema: str, most: int, batch_rows: int = 1 << 14) -> DataFrame:
    """do(columns) over runs of complete cells; the last of `names` is the cell, and some `most` rows are held at once."""

    def run(batches):
        held, size = [], 0

        def joined():
            return [np.concatenate([h[i] for h in held]) for i in range(len(names))]

        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size < most:
                continue
            part = joined()
            if cut := int(np.flatnonzero(part[-1] == part[-1][-1])[0]):  # the last cell may go on
                yield from do([x[:cut] for x in part])
            held, size = [[x[cut:] for x in part]], len(part[0]) - cut
        if size:
            yield from do(joined())

    dealt = rows.select(*names).repartition("cell").sortWithinPartitions("cell", "node")
    return map_arrow(dealt, run, schema, rows=batch_rows)


def words_of(code: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(code.tolist()), "<u8").reshape(-1, WORDS)


def proposed(met: DataFrame, codes: DataFrame, similarity: float, most: int) -> DataFrame:
    """(u, v) of sets that may be similar: of the forests of all cells, two pairs of each v at most."""

    def do(part):
        node, size, code, cell = part
        a, b, bits = cell_forest(Judge(words_of(code), size, similarity), cell, np.unique(node, return_inverse=True)[1])
        u, v = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(bits, pa.int64())], ["u", "v", "bits"])

    blocks = F.ceil(F.col("n") / most)
    rows = met.join(codes.select("node", "size", "code"), "node").withColumn("cell", F.xxhash64("key", F.pmod(F.xxhash64("node", "key"), blocks)))
    edges = whole_cells(rows, ["node", "size", "code", "cell"], do, "u long, v long, bits long", 4 * most)
    best = edges.groupBy("v").agg(F.min("u").alias("least"), F.min(F.struct("bits", "u")).alias("near"))
    return best.select(F.explode(F.array_distinct(F.array("least", "near.u"))).alias("u"), "v")


def unsettled(met: DataFrame, codes: DataFrame, most: int) -> DataFrame:
    """(node, label, size, code, cell) of the cells that hold several labels, cut where they are large.

    Of a large cell, sets of the largest label go to one block each, unless the others need several; the others meet
    all blocks of it and of themselves.
    """
    rows = met.select("key", "node").join(codes.select("node", "label"), "node")
    kinds = rows.groupBy("key", "label").count().groupBy("key")
    several = kinds.agg(F.sum("count").alias("n"), F.max(F.struct("count", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    rows = rows.join(several.select("key", "n", "top"), "key").withColumn("main", F.col("label") == F.col("top.label"))
    number = lambda n: F.greatest(F.lit(1), F.ceil(n / most)).cast("int")
    rows = rows.withColumns({"large": F.col("n") > most, "mains": number(F.col("top.count")), "rests": number(F.col("n") - F.col("top.count"))})
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", "key"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    place = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    with_main = F.when(F.col("main"), F.transform(upto(F.col("rests")), lambda j: place(1, F.col("own"), j))).otherwise(F.transform(upto(F.col("mains")), lambda i: place(1, i, F.col("own"))))
    with_rest = F.transform(upto(F.col("rests")), lambda j: place(2, F.least("own", j), F.greatest("own", j)))
    places = F.when(~F.col("large"), F.array(place(0, F.lit(0), F.lit(0)))).when(F.col("main"), with_main).otherwise(F.concat(with_main, with_rest))
    dealt = rows.select("key", "node", "label", F.explode(places).alias("at"))
    dealt = dealt.select("node", "label", F.xxhash64("key", "at.kind", "at.i", "at.j").alias("cell"))
    return dealt.join(codes.select("node", "size", "code"), "node")


def near_strangers(rows: DataFrame, similarity: float, most: int) -> DataFrame:
    """(node, label, size, code, cell) of the rows that are near one of another label in their cell."""

    def do(part):
        node, label, size, code, cell = part
        at = strangers(Judge(words_of(code), size, similarity), cell, label)
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[at]), pa.array(label[at]), pa.array(size[at], pa.int32()), pa.array(code[at].tolist(), pa.binary()), pa.array(cell[at])], ["node", "label", "size", "code", "cell"]
        )

    return whole_cells(rows, ["node", "label", "size", "code", "cell"], do, "node long, label long, size int, code binary, cell long", 4 * most)


def checked(rows: DataFrame, sets: DataFrame, similarity: float, most: int) -> DataFrame:
    """(u, v): links between labels of near_strangers' rows, by the exact similarity."""

    def do(part):
        node, label, size, code, shingles, cell = part
        a, b = exact_links(Judge(words_of(code), size, similarity), cell, label, [np.frombuffer(s, "<u8") for s in shingles])
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], ["u", "v"])

    names = ["node", "label", "size", "code", "shingles", "cell"]
    return whole_cells(rows.join(sets.hint("merge"), "node"), names, do, "u long, v long", most, batch_rows=256)


def label_of(codes: DataFrame, links: DataFrame) -> DataFrame:
    """codes with the root of each node's component as its label."""
    found = components(links).withColumnRenamed("root", "far")
    return codes.join(found.hint("merge"), "node", "left").withColumn("label", F.coalesce("far", "node")).drop("far")


def grouped(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, most: int) -> tuple[DataFrame, DataFrame]:
    """Prints of all rows, and (node, least, first, label): label is the same for all sets of a group."""
    prints = settle(near_prints(docs, id_col, text_col, words))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "t1", "t2"))
    codes = settle(prints.groupBy("node").agg(F.first("size").alias("size"), F.first("code").alias("code"), F.first("keys").alias("keys"), first.alias("first"), F.min("doc_id").alias("least"), F.count("*").alias("n")))
    keyed = codes.where("size > 0").select("node", F.explode("keys").alias("key"))
    met = settle(keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1"))
    some = settle(codes.select("node", "size", "code", "first").join(met.select("node").distinct().hint("merge"), "node", "left_semi"))
    tried = settle(proposed(met, some, similarity, most))
    pairs = tried.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = settle(alike(tried, sets_of(docs, id_col, text_col, words, some.join(pairs, "node", "left_semi")), similarity))
    left = settle(near_strangers(unsettled(met, settle(pointed(some, links)), most), similarity, most))
    more = checked(left, sets_of(docs, id_col, text_col, words, some.join(left.select("node").distinct(), "node", "left_semi")), similarity, most)
    return prints, settle(label_of(codes.select("node", "least", "first", "n"), settle(links.unionByName(more))))


def pointed(codes: DataFrame, links: DataFrame) -> DataFrame:
    """codes with a label that sets share only if links join them: each set points to its least neighbour, and to where that points, twice."""
    up = links.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("to"))
    for _ in range(2):
        far = up.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        up = up.join(far.hint("merge"), "to", "left").select("node", F.coalesce("beyond", "to").alias("to"))
    return codes.join(up.hint("merge"), "node", "left").withColumn("label", F.coalesce("to", "node")).drop("to")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, most: int = CELL) -> DataFrame:
    """(doc_id, component_id) of each row: the smallest doc_id of its group of near copies."""
    prints, found = grouped(docs, id_col, text_col, words, similarity, most)
    firsts = found.groupBy("label").agg(F.min("least").alias("component_id"))
    whole = settle(found.join(firsts, "label").select("node", "n", "component_id"))
    return spread_join(prints.select("doc_id", "node"), whole, "node").select("doc_id", "component_id")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, most: int = CELL) -> DataFrame:
    """One row of each group of near copies: the one of least id, then by a hash of its text; rows without an id only where there are no others.

    Rows are told apart by id and text, not by id alone, so different documents with one id are documents of their own.
    """
    prints, found = grouped(docs, id_col, text_col, words, similarity, most)
    kept = found.groupBy("label").agg(F.min("first").alias("f")).select("f.doc_id", "f.t1", "f.t2")
    names = [free_name(docs, n) for n in ("id_of", "t1", "t2")]
    times = prints.groupBy("doc_id", "t1", "t2").count()
    same = (times.doc_id.eqNullSafe(kept.doc_id)) & (times.t1 == kept.t1) & (times.t2 == kept.t2)
    kept = settle(times.join(kept, same, "left_semi").toDF(*names, free_name(docs, "times")))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = [F.col(id_col).cast("long"), F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    rows = docs.withColumns({f"{n}_": c for n, c in zip(names, own, strict=True)})
    once, often = (kept.where(F.col(kept.columns[3]) == 1), kept.where(F.col(kept.columns[3]) > 1))
    on = lambda k: F.col(f"{names[0]}_").eqNullSafe(F.col(names[0])) & (F.col(f"{names[1]}_") == F.col(names[1])) & (F.col(f"{names[2]}_") == F.col(names[2]))
    # The kept rows grow with the documents, so they are not to be broadcast at any size.
    met = [rows.join(k.hint("merge"), on(k), "left_semi") for k in (once, often)]
    return met[0].unionByName(met[1].dropDuplicates([f"{n}_" for n in names])).select(*docs.columns)
