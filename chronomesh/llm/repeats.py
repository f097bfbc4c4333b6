"""Exact repeated passages by depth-limited radix passes over suffixes.

Every suffix is ordered only through its first `depth` bytes, most significant digits first,
and a group of equal suffixes holds the copies of a repeated window. Suffixes that stand alone
after a pass leave it, so passes get small quickly:

1. A suffix is named by its anchor, the ANCHOR-byte string of least hash inside its window.
   Equal windows have equal anchors at equal places. Suffixes next to each other share their
   anchor, so one row stands for such a run; runs whose anchor occurs once are done.
2. Among runs with one anchor, the whole stretch that a run's windows cover is the next digit.
   Equal stretches repeat with all their windows. One of each different stretch goes on.
3. The windows of those stretches are sorted by their bytes, DIGIT at a time from the most
   significant on, until all `depth` bytes are used; groups of two windows or more are repeats.

Each digit of pass 1 and 2 is a 64-bit hash, so equal runs agree on 128 bits. Equal texts meet
before the first pass, and only one of them takes part. An anchor with more than HOT different
stretches is not brought to one task: its windows are counted by their own hashes instead.

Null texts count as empty, texts shorter than `depth` lose nothing, equal texts of at least
`depth` bytes lose everything. Rows that repeat are copies. Matches never cross rows. An
empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, small_batches, table

DEPTH = 200
ANCHOR = 64
#: Bytes of a digit of the third pass, and windows that a task sorts at once.
DIGIT, WINDOWS_AT_ONCE = 8, 1 << 18
#: Different stretches of one anchor, and rows of one anchor, that a task holds at once.
HOT, HELD = 4_096, 1 << 19

SEED_A, SEED_B = 0x9E3779B1, 0x85EBCA77


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """32-bit hash of each `width`-byte string, by doubling."""
    block, size, out, done = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(SEED_A), 1, None, 0
    while True:
        if width & 1:
            if out is None:
                out = block
            else:
                n = min(len(out), len(block) - done)
                out = out[:n] * np.uint32(SEED_B) + block[done : done + n]
                out ^= out >> np.uint32(15)
            done += size
        width >>= 1
        if not width:
            return out
        block = block[:-size] * np.uint32(SEED_B) + block[size:]
        block ^= block >> np.uint32(15)
        size *= 2


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values, size = np.minimum(values[:-size], values[size:]), size * 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def runs(raw: bytes, depth: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last start of each run of windows; a window's anchor is the leftmost of least hash."""
    data = np.frombuffer(raw, np.uint8)
    code = rolling(data, anchor) * np.uint32(0xC2B2AE3D)
    both = (code.astype(np.uint64) << np.uint64(32)) | np.arange(len(code), dtype=np.uint64)
    place = (window_min(both, depth - anchor + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return place[first], first, np.r_[first[1:], len(place)] - 1


def signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def text_key(text: Column | None = None) -> list[Column]:
    """128 bits that name a text, as two longs."""
    text = F.col("text") if text is None else text
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """(t1, t2, text, copies): texts reduced before the shuffle."""
    return docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select(*text_key(), "text").groupBy("t1", "t2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))


def anchor_rows(texts: DataFrame, depth: int, anchor: int) -> DataFrame:
    """One row for each run of windows: its anchor's hash, its stretch's hash, its text and place.

    Stretches that occur more than once in a batch are known to repeat: all their runs are
    `done`, with a key of their own that spreads them, and one row goes on for the group. So a
    stretch that is everywhere sends a row a batch to its anchor's task, not a row a copy.
    """

    def run(batches):
        one, whole = xxhash.xxh64_intdigest, xxhash.xxh3_64_intdigest
        for batch in batches:
            k, c, row, lo, hi, at = [], [], [], [], [], []
            for i, raw in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                places, firsts, lasts = (x.tolist() for x in runs(raw, depth, anchor))
                k += [one(raw[p : p + anchor]) for p in places]
                c += [whole(raw[a : b + depth], p - a) for p, a, b in zip(places, firsts, lasts, strict=True)]
                row += [i] * len(places)
                lo, hi, at = lo + firsts, hi + lasts, at + places
            k, c = np.array(k, np.uint64), np.array(c, np.uint64)
            order = np.lexsort((c, k))
            new = np.flatnonzero(np.r_[True, (k[order][1:] != k[order][:-1]) | (c[order][1:] != c[order][:-1])]) if len(k) else np.zeros(0, int)
            copies = np.diff(np.r_[new, len(k)])
            done = order[np.repeat(copies > 1, copies)]
            take = np.concatenate([order[new], done])
            spread = k[take]
            spread[len(new) :] = c[done] ^ (np.arange(len(done), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            row = pa.array(np.array(row, np.int64)[take])
            yield pa.RecordBatch.from_arrays(
                [pa.array(spread.view(np.int64)), pa.array(c[take].view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), *(pa.array(np.array(x, np.int32)[take]) for x in (lo, hi, at)), pa.array(np.arange(len(take)) >= len(new))],
                ["k", "c", "t1", "t2", "lo", "hi", "place", "done"],
            )

    long_enough = texts.where(F.octet_length("text") >= depth).select("t1", "t2", "text", "copies")  # all columns, so that the shuffle of texts is one with the others
    return map_arrow(long_enough, run, "k long, c long, t1 long, t2 long, lo int, hi int, place int, done boolean")


REPEATED, BYTES, WINDOWS = 0, 1, 2  # a run all of whose windows repeat; one to go on by its bytes; one to go on by its windows' hashes


def marked(k: np.ndarray, c: np.ndarray, hot: bool, most: int = HOT) -> list[tuple[np.ndarray, int]]:
    """Rows, sorted by k and c, that repeat or go on."""
    n = len(k)
    new_key = np.r_[True, k[1:] != k[:-1]]
    first = np.flatnonzero(new_key | np.r_[True, c[1:] != c[:-1]])
    copies = np.diff(np.r_[first, n])
    key_of = np.cumsum(new_key[first]) - 1
    kinds = np.bincount(key_of)[key_of]
    lone = copies == 1
    out = [(np.flatnonzero(np.repeat(~lone, copies)), REPEATED)]
    out.append((first[(kinds > 1) & (kinds <= most)] if not hot else first[:0], BYTES))
    out.append((first[kinds > most] if not hot else first, WINDOWS))
    return out


def mark_runs(rows: DataFrame, most: int = HOT, held_rows: int = HELD) -> DataFrame:
    """Passes 1 and 2: rows that repeat as a whole, and one of each stretch that goes on."""
    names = ["k", "t1", "t2", "lo", "hi", "place"]

    def run(batches):
        held, hot_key = None, None

        def tell(columns, hot):
            for rows, kind in marked(columns[0], columns[1], hot, most):
                if len(rows):
                    own = [columns[i][rows] for i in (0, 2, 3, 4, 5, 6)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, own), pa.array(np.full(len(rows), kind, np.int32))], [*names, "kind"])

        for batch in batches:
            known = batch.filter(batch.column(7))
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column(0), *known.columns[2:7], pa.array(np.full(known.num_rows, REPEATED, np.int32))], [*names, "kind"])
            batch = batch.filter(pc.invert(batch.column(7)))
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:7]]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            k = held[0]
            cut = int(np.flatnonzero(k == k[-1])[0])  # the last anchor's rows may go on
            if cut:
                head = held[0][:cut]
                inside = int(np.count_nonzero(head == hot_key)) if hot_key is not None else 0  # sorted, so they come first
                if inside:
                    yield from tell([x[:inside] for x in held], True)
                if cut > inside:
                    yield from tell([x[inside:cut] for x in held], False)
                held = [x[cut:] for x in held]
                if hot_key is not None and held[0][0] != hot_key:
                    hot_key = None
            if len(held[0]) > held_rows:
                hot_key = held[0][0]
                last = int(np.flatnonzero(held[1] == held[1][-1])[0])
                yield from tell(held, True)  # one row of the last stretch stays, so that later copies meet it
                held = [x[last : last + 1] for x in held]
        if held and len(held[0]):
            yield from tell(held, hot_key is not None and held[0][0] == hot_key)

    return map_arrow(rows.repartition("k").sortWithinPartitions("k", "c"), run, "k long, t1 long, t2 long, lo int, hi int, place int, kind int", rows=1 << 16)


def stretches(marks: DataFrame, texts: DataFrame, depth: int) -> DataFrame:
    """The bytes of each run that goes on, once, though pieces of an anchor may tell of it more than once."""
    wanted = marks.where(F.col("kind") > REPEATED).groupBy("t1", "t2").agg(F.collect_set(F.struct("k", "lo", "hi", "place", "kind")).alias("wanted"))

    def run(batches):
        for batch in batches:
            cells, data, row = [], [], []
            for i, (raw, own) in enumerate(zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                cells += own
                data += [raw[w["lo"] : w["hi"] + depth] for w in own]
                row += [i] * len(own)
            row = pa.array(row, pa.int32())
            fields = [pa.array([w[n] for w in cells], t) for n, t in (("k", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("place", pa.int32()), ("kind", pa.int32()))]
            yield pa.RecordBatch.from_arrays([fields[0], batch.column(0).take(row), batch.column(1).take(row), *fields[1:], pa.array(data, pa.binary())], ["k", "t1", "t2", "lo", "hi", "place", "kind", "data"])

    joined = texts.join(wanted, ["t1", "t2"])
    return map_arrow(joined, run, "k long, t1 long, t2 long, lo int, hi int, place int, kind int, data binary", rows=64)


def radix_repeats(group: np.ndarray, at: np.ndarray, raw: np.ndarray, depth: int) -> np.ndarray:
    """Indices of the windows raw[at : at + depth] that equal another window of their group.

    Passes over digits of DIGIT bytes, the most significant first: windows of one group and digit are a group of the next pass, and those that are alone leave.
    """
    words = np.zeros(len(raw), np.uint64)
    padded = np.concatenate([raw, np.zeros(DIGIT, np.uint8)]).astype(np.uint64)
    for i in range(DIGIT):
        words = words << np.uint64(8) | padded[i : i + len(raw)]
    alive = np.arange(len(at))

    def parted(alive, group, digit):
        order = np.lexsort((digit, group)) if digit is not None else np.argsort(group, kind="stable")
        new = group[order][1:] != group[order][:-1]
        if digit is not None:
            new |= digit[order][1:] != digit[order][:-1]
        first = np.flatnonzero(np.r_[True, new]) if len(order) else np.zeros(0, int)
        size = np.diff(np.r_[first, len(order)])
        name = np.repeat(np.arange(len(first)), size)
        keep = np.repeat(size > 1, size)
        return alive[order[keep]], name[keep]

    alive, group = parted(alive, group, None)
    for done in range(0, depth, DIGIT):
        width = min(DIGIT, depth - done)
        alive, group = parted(alive, group, words[at[alive] + done] >> np.uint64(8 * (DIGIT - width)))
    return alive


SPANS = "t1 long, t2 long, start int, end int"


def stretch_spans(k: np.ndarray, lo: np.ndarray, hi: np.ndarray, place: np.ndarray, data: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each repeated span of stretches; those of one key k share an anchor.

    Equal windows have it at equal places, so the place of the anchor in a window is the first digit.
    """
    number = (hi - lo + 1).astype(np.int64)
    row = np.repeat(np.arange(len(k)), number)
    offset = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    begin = np.concatenate([[0], np.cumsum([len(d) for d in data])[:-1]]) if len(data) else np.zeros(0, np.int64)
    start = lo[row] + offset
    group = np.unique(k, return_inverse=True)[1][row] * (depth + 1) + (place[row] - start)
    hits = np.sort(radix_repeats(group, begin[row] + offset, np.frombuffer(b"".join(data), np.uint8), depth))  # by row and start
    r, s = row[hits], start[hits]
    first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (s[1:] - s[:-1] > depth)]) if len(hits) else np.zeros(0, int)
    last = np.r_[first[1:], len(hits)][: len(first)] - 1
    return r[first], s[first], s[last] + depth


def resolve_bytes(found: DataFrame, depth: int, windows: int = WINDOWS_AT_ONCE) -> DataFrame:
    """Pass 3 over stretches that share an anchor."""

    def run(batches):
        held, size = [], 0

        def joined():
            columns = [np.concatenate(x) for x in zip(*(h[:6] for h in held), strict=True)]
            return [*columns, [d for h in held for d in h[6]]]

        def spans(part):
            k, t1, t2, lo, hi, place, data = part
            r, start, end = stretch_spans(k, lo, hi, place, data, depth)
            return pa.RecordBatch.from_arrays([pa.array(t1[r]), pa.array(t2[r]), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["t1", "t2", "start", "end"])

        for batch in batches:
            own = [*(c.to_numpy() for c in batch.columns[:6]), batch.column(6).to_pylist()]
            held.append(own)
            size += int((own[4] - own[3] + 1).sum())
            if size < windows:
                continue
            part = joined()
            if cut := int(np.flatnonzero(part[0] == part[0][-1])[0]):  # the last key may go on
                yield spans([x[:cut] for x in part])
            held = [[x[cut:] for x in part]]
            size = int((held[0][4] - held[0][3] + 1).sum())
        if size:
            yield spans(joined())

    rows = found.where(F.col("kind") == BYTES).select("k", "t1", "t2", "lo", "hi", "place", "data")
    return map_arrow(rows.repartition("k").sortWithinPartitions("k"), run, SPANS, rows=1024)


def resolve_windows(found: DataFrame, depth: int) -> DataFrame:
    """The same for anchors with very many stretches: windows are counted by 128 bits of hash."""

    def run(batches):
        for batch in batches:
            h1, h2, row, start = [], [], [], []
            for i, (lo, hi, data) in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)):
                for s in range(hi - lo + 1):
                    both = xxhash.xxh3_128_intdigest(data[s : s + depth])
                    h1.append(both >> 64), h2.append(both & (1 << 64) - 1)
                row += [i] * (hi - lo + 1)
                start += range(lo, hi + 1)
            row = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([signed(h1), signed(h2), batch.column(0).take(row), batch.column(1).take(row), pa.array(start, pa.int32())], ["h1", "h2", "t1", "t2", "start"])

    rows = found.where(F.col("kind") == WINDOWS).select("t1", "t2", "lo", "hi", "data")
    windows = map_arrow(rows, run, "h1 long, h2 long, t1 long, t2 long, start int", rows=1024)
    twice = windows.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    return windows.join(twice, ["h1", "h2"]).select("t1", "t2", "start", (F.col("start") + depth).alias("end"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_spans(docs: DataFrame, text_col: str = "text", depth: int = DEPTH, anchor: int = ANCHOR, most: int = HOT, held_rows: int = HELD) -> DataFrame:
    """(t1, t2, text, copies, spans) of each different text; spans are to be merged."""
    small_batches(docs.sparkSession)
    texts = distinct_texts(docs, text_col)
    marks = mark_runs(anchor_rows(texts, depth, anchor), most, held_rows)
    found = stretches(marks, texts, depth)
    whole = marks.where(F.col("kind") == REPEATED).select("t1", "t2", F.col("lo").alias("start"), (F.col("hi") + depth).alias("end"))
    spans = whole.unionByName(resolve_bytes(found, depth)).unionByName(resolve_windows(found, depth))
    return texts.join(spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "end")).alias("spans")), ["t1", "t2"], "left")


def removals(raw: bytes, copies: int, spans: list[dict] | None, depth: int) -> list[tuple[int, int]]:
    return [(0, len(raw))] if copies > 1 and len(raw) >= depth else merged(spans or [])


def kept(raw: bytes, cuts: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for cut in cuts for x in cut), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def whole_characters(raw: bytes, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The cuts without characters that they hold in part only."""
    out = []
    for a, b in cuts:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b < len(raw) and a < b and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def cut_texts(rows: DataFrame, found: DataFrame, key: tuple[str, str], text_col: str, depth: int = DEPTH) -> DataFrame:
    """rows, which have a key but no text, with their texts without repeats, whole characters only.

    Texts stay where repeated_spans has put them and the rows come there. Texts that are
    removed whole are emptied before, so that copies of a large one are not made.
    """
    whole = (F.col("copies") > 1) & (F.octet_length("text") >= depth)
    slim = found.select(F.col("t1").alias(key[0]), F.col("t2").alias(key[1]), F.struct(F.when(whole, "").otherwise(F.col("text")).alias("text"), F.when(~whole, F.col("spans")).alias("spans")).alias(text_col))
    joined = rows.join(slim, list(key)).drop(*key)
    at = joined.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in joined.schema)

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column(at).to_pylist():
                raw = x["text"].encode()
                out.append(kept(raw, whole_characters(raw, merged(x["spans"] or []))).decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return map_arrow(joined, run, schema)


def repeat_digests(found: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(t1, t2, n_bytes, n_removed, n_spans, kept_sha256) of each different text."""

    def run(batches):
        for batch in batches:
            rows = []
            for raw, copies, spans in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                cuts = removals(raw, copies, spans, depth)
                rows.append((len(raw), sum(b - a for a, b in cuts), len(cuts), hashlib.sha256(kept(raw, cuts)).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["t1", "t2", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_arrow(found.select("t1", "t2", "text", "copies", "spans"), run, "t1 long, t2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select("doc_id", *text_key())


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return with_key(docs).join(repeat_digests(repeated_spans(docs)), ["t1", "t2"]).drop("t1", "t2")
