"""Best-fit packing of token sequences by linear grouping.

Documents become pieces of at most `capacity` tokens, and the pieces of each length are counted.
From the counts alone, a table with a few entries a length, the driver plans the sequences:

1. Large pieces, sorted by length, are cut into at most GROUPS groups of equal cardinality, and
   each length is rounded up to the largest of its group, so that few sizes are left.
2. Configurations of the rounded sizes are chosen one after another: the largest size left,
   with the multiset of sizes that fills its sequence most, as often as the counts allow. If large pieces are longer than a third of a
   sequence, a configuration has two of them at most, and taking the fullest partner of the largest size needs as few sequences as can be.
3. Each place of a configuration takes actual pieces of its group, which are no longer, the shortest ones of all its groups
   together, so that what rounding wastes becomes rooms that can be used.
4. Small pieces go, longest first, where the least room that suffices is left.

This is done for each bound of small pieces in SMALL, and the plan of fewest sequences counts.

Pieces are then dealt by their rank within their length, which needs no piece to know another.
The plan's size depends on the lengths and groups alone, not on the number of pieces.

Null and empty texts are a document of the end token alone. Equal and repeated rows are packed
one by one. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytebpe import encoder
from .common import map_arrow, settle, small_batches, table

CAPACITY, END_ID = 1024, 2
#: Groups of equal cardinality; the largest length that counts as small, of which the better is taken.
GROUPS, SMALL = 256, (480, 192)
#: Parts in which the pieces of a length are ranked.
RANKED = 64

#: Pieces of one length: length, first rank, number, first sequence, place in it.
Segment = tuple[int, int, int, int, int]


class Shelf:
    """Sequences with the same room left, in batches (first sequence, number)."""

    def __init__(self, capacity: int):
        self.capacity, self.used, self.segments = capacity, 0, []
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.ranks: dict[int, int] = defaultdict(int)

    def open(self, n: int) -> int:
        self.used += n
        return self.used - n

    def put(self, length: int, n: int, first: int, place: int) -> None:
        self.segments.append((length, self.ranks[length], n, first, place))
        self.ranks[length] += n

    def leave(self, first: int, n: int, room: int) -> None:
        if room and n:
            self.room[room].append((first, n))

    def best_fit(self, lengths: list[tuple[int, int]]) -> None:
        """Place (length, number) pairs, longest first."""
        for length, number in sorted(lengths, reverse=True):
            while number:
                room = min((r for r in self.room if r >= length), default=None)
                if room is None:
                    each = self.capacity // length
                    n, take = (number // each, each) if number >= each else (1, number)
                    first = self.open(n)
                    for i in range(take):
                        self.put(length, n, first, i * length)
                    self.leave(first, n, self.capacity - take * length)
                    number -= n * take
                    continue
                first, n = self.room[room].pop()
                if not self.room[room]:
                    del self.room[room]
                take = min(n, number)
                self.put(length, take, first, self.capacity - room)
                self.leave(first, take, room - length)
                self.leave(first + take, n - take, room)
                number -= take


def fullest(sizes: list[int], left: dict[int, int], room: int) -> list[int]:
    """The multiset of sizes, each as often as it is left at most, whose sum comes closest to room."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for size in sizes:
        most = min(left[size], room // size)
        take = 1
        while most:
            take = min(take, most)
            steps.append((size, take, reach))
            reach |= reach << (size * take) & mask
            most -= take
            take *= 2
            if reach >> room & 1:
                most = 0
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for size, take, before in reversed(steps):
        if not before >> total & 1:
            out += [size] * take
            total -= size * take
    return out


def linear_grouping(counts: dict[int, int], capacity: int, groups: int, small: int) -> Shelf:
    shelf = Shelf(capacity)
    large = sorted(((n, c) for n, c in counts.items() if n > small), reverse=True)
    each = max(1, -(-sum(c for _, c in large) // groups))
    stock: dict[int, list[list[int]]] = defaultdict(list)  # rounded size: [length, number], longest first
    space, size = 0, 0
    for length, number in large:
        while number:
            if not space:
                space, size = each, length
            take = min(space, number)
            stock[size].append([length, take])
            space, number = space - take, number - take
    left = {size: sum(n for _, n in own) for size, own in stock.items()}
    while left:
        sizes = sorted(left, reverse=True)
        head = sizes[0]
        left[head] -= 1
        pattern = [head, *fullest([s for s in sizes if s <= capacity - head], left, capacity - head)]
        left[head] += 1
        times = min(left[s] // pattern.count(s) for s in set(pattern))
        for s in pattern:
            left[s] -= times
            if not left[s]:
                del left[s]
        first = shelf.open(times)
        places = []
        for s in pattern:  # actual pieces for each place of the configuration
            need, own = times, []
            while need:
                run = stock[s][-1]
                take = min(run[1], need)
                own.append((run[0], take))
                run[1] -= take
                need -= take
                if not run[1]:
                    stock[s].pop()
            places.append(own)
        for number, lengths in together(places):
            at = 0
            for length in lengths:
                shelf.put(length, number, first, at)
                at += length
            shelf.leave(first, number, capacity - at)
            first += number
    shelf.best_fit([(n, c) for n, c in counts.items() if n <= small])
    return shelf


def together(places: list[list[tuple[int, int]]]) -> Iterator[tuple[int, list[int]]]:
    """Cut parallel runs where any of them changes."""
    runs = [[list(r) for r in reversed(p)] for p in places]
    while runs[0]:
        number = min(r[-1][1] for r in runs)
        yield number, [r[-1][0] for r in runs]
        for r in runs:
            r[-1][1] -= number
            if not r[-1][1]:
                r.pop()


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: tuple[int, ...] = SMALL) -> tuple[int, list[Segment]]:
    """Number of sequences, and where the pieces of each length go by rank."""
    counts = {n: c for n, c in counts.items() if c and n < capacity}
    shelf = min((linear_grouping(counts, capacity, groups, n) for n in small), key=lambda shelf: shelf.used)
    return shelf.used, shelf.segments


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece; only the first may be short."""
    edges = [0, *range(total % capacity or min(total, capacity), total + 1, capacity)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def token_pieces(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        for batch in batches:
            row, rest = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder(path).encode(text or "") + end
                for piece, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    row.append(i)
                    rest.append((piece, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*rest, strict=True) if rest else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    pieces = map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return pieces.withColumn("row", F.monotonically_increasing_id())


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, groups: int = GROUPS, small: tuple[int, ...] = SMALL) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece.

    The driver gets the number of pieces of each length in each of RANKED parts, at most
    capacity * RANKED rows, whatever the input.
    """
    small_batches(docs.sparkSession)
    pieces = settle(token_pieces(docs, path, id_col, text_col, capacity, end_id))  # row numbers stay as they are written
    part = F.pmod("row", F.lit(RANKED)).cast("int").alias("part")
    numbers = {(r["length"], r["part"]): r["count"] for r in pieces.where(F.col("length") < capacity).groupBy("length", part).count().collect()}
    base, counts = {}, defaultdict(int)
    for (length, own), n in sorted(numbers.items()):
        base[length, own] = counts[length]
        counts[length] += n
    used, segments = plan(counts, capacity, groups, small)
    shift = 44  # of a length beside a rank
    keys = np.array(sorted((s[0] << shift) + s[1] for s in segments), np.int64)
    order = sorted(segments, key=lambda s: (s[0], s[1]))
    first, place = np.array([s[3] for s in order], np.int64), np.array([s[4] for s in order], np.int64)
    start_of = np.zeros((capacity, RANKED), np.int64)
    for (length, own), n in base.items():
        start_of[length, own] = n
    ranked = pieces.where(F.col("length") < capacity).withColumn("rank", F.row_number().over(Window.partitionBy("length", part).orderBy("row")) - 1)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def deal(batches):
        for batch in batches:
            length, row, rank = (batch.column(i).to_numpy() for i in (3, 5, 6))
            key = (length << shift) + start_of[length, row % RANKED] + rank
            at = np.searchsorted(keys, key, "right") - 1
            sequence = first[at] + key - keys[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(place[at])], [*names, "sequence_id", "offset"])

    short = map_arrow(ranked.select(*names, "row", F.col("rank").cast("long")), deal, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", rows=1 << 16)
    full = pieces.where(F.col("length") == capacity).select(*names, (F.col("row") + used).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.unionByName(full)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
