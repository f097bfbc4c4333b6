"""SentencePiece encoding and decoding by suffix-array matching, for BPE models.

The different units of a batch of texts, words with the space before them, are concatenated and
indexed by a suffix array as deep as the longest piece. Binary search finds the range of
suffixes that begin with each piece, which gives all edges (start, end, piece) at once. Edges are
sorted by end and relaxed: an edge wins its end if the piece before its start and its own piece
stay apart under the model's merges, and of all edges to an end at most one does. A sequence is the BPE encoding
exactly if all its neighbours stay apart, so the winners are the library's ids.

No piece holds a space after another character, so units don't depend on each other; a model
that has such a piece is encoded in whole texts. Nothing but merges of pairs is kept from one batch
to the next. Characters without a piece become byte pieces, or the unknown id if the model has none.
A batch is indexed in parts of some INDEXED characters, but a unit is not cut, so a task
needs about 200 bytes for each character of the longest run without a space.

Null and empty texts have no ids. Equal texts have equal ids, repeated rows stay, an empty table
gives an empty result, and further columns are ignored. The sign for a space, U+2581, is decoded as a
space, so texts that hold it are the only ones that don't come back.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, small_batches, table

SPACE = "▁"
#: Pairs of pieces that a worker keeps; characters of units that are indexed at once; texts of a batch.
KEPT_PAIRS, INDEXED, TEXTS = 2_000_000, 1 << 19, 1_024


class Pieces:
    def __init__(self, path: str, dummy_prefix: bool = True):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dummy_prefix, self.size = dummy_prefix, len(model)
        self.id_of: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id: dict[int, int] = {}
        self.data: list[bytes] = []
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.data.append(bytes([int(piece[3:5], 16)]))
                continue
            normal = not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
            self.data.append(piece.replace(SPACE, " ").encode() if normal else b"")
            if normal:
                self.id_of[piece], self.score[piece] = i, model.get_score(i)
        self.unknown = model.unk_id()
        self.by_unit = not any(a != SPACE and b == SPACE for p in self.id_of for a, b in zip(p, p[1:], strict=False))
        self.usable = [p for p in self.id_of if self.merged(p) == [p]]
        self.length = np.ones(self.size, np.int64)
        self.text = [""] * self.size
        for p in self.usable:
            self.length[self.id_of[p]], self.text[self.id_of[p]] = len(p), p
        self.depth = max(map(len, self.usable), default=1)
        self.alphabet = sorted({c for p in self.usable for c in p})
        self.pairs, self.answers = np.array([-1], np.int64), np.array([True])  # pairs of pieces in order, and whether they stay two
        self.recent: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """BPE itself on a short string: the best pair first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)):
                s = score.get(a + b)
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two pieces in a row stay two; ids from self.size up are characters without a piece."""
        out = np.ones(len(left), bool)
        both = np.flatnonzero((left < self.size) & (right < self.size))
        keys, back = np.unique(left[both] * self.size + right[both], return_inverse=True)
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        answers, known = self.answers[at], self.pairs[at] == keys
        for i in np.flatnonzero(~known).tolist():
            key = int(keys[i])
            answer = self.recent.get(key)
            if answer is None:
                a, b = self.text[key // self.size], self.text[key % self.size]
                answer = self.recent[key] = self.merged(a + b) == [a, b]
            answers[i] = answer
        out[both] = answers[back]
        return out

    def remember(self) -> None:
        """Sort the pairs of late into those that are looked up side by side."""
        if len(self.pairs) + len(self.recent) > KEPT_PAIRS:
            self.pairs, self.answers = np.array([-1], np.int64), np.array([True])
        pairs = np.concatenate([self.pairs, np.array(list(self.recent), np.int64)])
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.answers = pairs[order], np.concatenate([self.answers, np.array(list(self.recent.values()), bool)])[order]
        self.recent = {}

    def edges(self, codes: np.ndarray, n_symbols: int, symbol: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece of every occurrence of a piece in codes, by a suffix array; code 0 ends a unit."""
        wide = 1 if n_symbols < 255 else 2 if n_symbols < 65_535 else 4
        room = -(-self.depth * wide // 8) * 8
        cells = np.concatenate([codes, np.zeros(room // wide, codes.dtype)]).astype(f">u{wide}")
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(cells, room // wide)[: len(codes)])
        words = windows.view(">u8").astype(np.uint64)
        suffixes = np.lexsort(words.T[::-1])
        ordered = windows[suffixes].view(f"S{room}").ravel()
        own = [p for p in self.usable if all(c in symbol for c in p)]
        low = np.zeros((len(own), room // wide), f">u{wide}")
        for i, p in enumerate(own):
            low[i, : len(p)] = [symbol[c] for c in p]
        sizes = np.array([len(p) for p in own], np.int64)
        high = low.copy()
        high[np.arange(room // wide) >= sizes[:, None]] = (1 << 8 * wide) - 1
        first = np.searchsorted(ordered, low.view(f"S{room}").ravel(), "left")
        count = np.searchsorted(ordered, high.view(f"S{room}").ravel(), "right") - first
        ids = np.array([self.id_of[p] for p in own], np.int64)
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        return suffixes[at], np.repeat(ids, count)

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit, a string that needs no other, as unsigned 32-bit numbers."""
        lengths = np.array([len(u) for u in units], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        text = "\0".join(units) + "\0"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        seen = np.unique(points)
        known = np.array([ord(c) for c in self.alphabet], np.uint32)
        present = seen[np.isin(seen, known)]
        codes = np.searchsorted(present, points)
        codes = np.where((codes < len(present)) & (present[np.minimum(codes, len(present) - 1)] == points), codes + 1, 0) if len(present) else np.zeros(len(points), np.int64)
        codes[starts + lengths] = 0
        start, piece = self.edges(codes.astype(np.int64), len(present), {chr(c): i + 1 for i, c in enumerate(present.tolist())}) if len(present) else (np.zeros(0, np.int64),) * 2
        inside = np.ones(len(points), bool)
        inside[starts + lengths] = False
        alone = np.flatnonzero(inside & (codes == 0))
        start, piece = np.concatenate([start, alone]), np.concatenate([piece, self.size + points[alone].astype(np.int64)])
        size = np.where(piece < self.size, self.length[np.minimum(piece, self.size - 1)], 1)
        unit_of = np.repeat(np.arange(len(units)), lengths + 1)
        first = starts[unit_of[start]]
        end = start + size
        order = np.argsort(end - first, kind="stable")  # by end within the unit, all units side by side
        start, piece, end, first = start[order], piece[order], end[order], first[order]
        last = np.full(len(points) + 1, -1, np.int64)  # winner of each end
        cuts = np.flatnonzero(np.diff(end - first)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(end)], strict=True):
            s, p = start[a:b], piece[a:b]
            before = last[s]
            opens = s == first[a:b]
            fine = opens | (before >= 0)
            rest = np.flatnonzero(fine & ~opens)
            if len(rest):
                fine[rest] = self.stay_apart(before[rest], p[rest])
            last[end[a:b][fine]] = p[fine]
        where, what, at, who = [], [], starts + lengths, np.arange(len(units))
        while True:  # back from the ends
            more = at > starts[who]
            at, who = at[more], who[more]
            if not len(at):
                break
            won = last[at]
            at = at - np.where(won < self.size, self.length[np.minimum(won, self.size - 1)], 1)
            where.append(at), what.append(won)
        if not where:
            return [b""] * len(units)
        where, what = np.concatenate(where), np.concatenate(what)
        order = np.argsort(where)
        where, what = where[order], what[order]
        odd = np.flatnonzero(what >= self.size)  # characters without a piece become several ids
        spelled = [self.spelled(x) for x in what[odd].tolist()]
        times = np.ones(len(what), np.int64)
        times[odd] = [len(x) for x in spelled]
        flat, first = np.repeat(what, times), np.cumsum(times) - times
        if spelled:
            flat[np.repeat(first[odd], times[odd]) + np.concatenate([np.arange(len(x)) for x in spelled])] = [i for x in spelled for i in x]
        ends = 4 * np.cumsum(np.bincount(unit_of[where], times, minlength=len(units)).astype(np.int64))
        data = flat.astype("<u4").tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def spelled(self, piece: int) -> Sequence[int]:
        """Ids of a character without a piece."""
        return [self.byte_id.get(b, self.unknown) for b in chr(piece - self.size).encode()] if self.byte_id else (self.unknown,)

    def cut(self, text: str) -> list[str]:
        """Units of a text without their first space sign."""
        if not text:
            return []
        if not self.by_unit:
            return [text]
        parts = text.split(" ")
        if "" not in parts:
            return parts
        out, run = [], 0
        for p in parts:  # spaces in a row belong to the word after them
            if p:
                out.append(SPACE * run + p)
                run = 0
            else:
                run += 1
        return [*out, SPACE * (run - 1)] if run else out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit numbers in the machine's (little-endian) order."""
        units: dict[str, bytes] = {}
        split = [self.cut(t) for t in texts]
        prefix = SPACE if self.by_unit else ""
        new = sorted(set().union(*split))
        group, held = [], 0
        for i, u in enumerate(new):
            group.append(u)
            held += len(u) + 2
            if held > INDEXED or i == len(new) - 1:
                whole = [prefix + g if prefix else (SPACE * self.dummy_prefix + g.replace(" ", SPACE)) for g in group]
                units.update(zip(group, self.encode_units(whole), strict=True))
                group, held = [], 0
        self.remember()
        return [b"".join(map(units.__getitem__, s)) for s in split]

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.data.__getitem__, array("I", ids)))
        text = data.decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit numbers in one binary value."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids = pieces(path).encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, "doc_id long, ids binary", rows=TEXTS)


def decode_texts(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""

    def run(batches):
        for batch in batches:
            texts = [pieces(path).decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the text they decode to, and whether it came back."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    small_batches(spark)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = pieces(path).encode(texts)
            back = [pieces(path).decode(x) for x in found]
            columns = [pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([zlib.crc32(x) for x in found], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()), pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return map_arrow(docs, run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean", rows=TEXTS)
