"""Media columns: ISO base media files, written and read without decoding payloads.

A file is a tree of boxes (size, four-letter type, body). `read_container` walks the tree,
decodes the sample tables of the first track and returns codec, duration and byte ranges.
`write_container` makes a file whose track holds 8-bit grey frames of 24 x 24 samples.

Null texts count as empty. A file that is null, cut off, or no such file gives a null codec, duration and
ranges, and what a table states is checked against the file's size before anything is made of it.
Samples of movie fragments are in no sample table: a fragmented file has its codec and duration,
and no ranges. Rows that repeat give rows that repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, small_batches, table

#: Samples of one frame: 24 x 24 grey values of 8 bits.
FRAME = 576
SIDE = 24
#: Frames from one sync sample to the next.
GOP = 12
#: Frames in one chunk of the media data.
CHUNK = 64
TIMESCALE, FRAME_TICKS = 25_000, 1_000

#: Box types that hold boxes (fixed values of the format).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_container(payload: bytes) -> bytes:
    """A file with one video track whose frames are the payload's bytes, FRAME at a time."""
    n = len(payload) // FRAME
    if not n or len(payload) % FRAME:
        raise ValueError(f"a payload is a positive multiple of {FRAME} bytes")
    ticks = n * FRAME_TICKS
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  ", b"isom")
    entry = box(
        b"raw ",
        bytes(6) + struct.pack(">H", 1) + bytes(16) + struct.pack(">HHIIIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1),
        bytes(32) + struct.pack(">Hh", 40, -1),
    )
    keys = range(1, n + 1, GOP)
    chunks = range(0, n, CHUNK)
    runs = [(1, min(CHUNK, n))] + ([(len(chunks), n - chunks[-1])] if len(chunks) > 1 and n % CHUNK else [])

    def movie(first: int) -> bytes:
        stbl = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, n, FRAME_TICKS)),
            full_box(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", at, count, 1) for at, count in runs)),
            full_box(b"stsz", struct.pack(">II", FRAME, n)),
            full_box(b"co64", struct.pack(f">I{len(chunks)}Q", len(chunks), *(first + FRAME * at for at in chunks))),
        )
        minf = box(b"minf", full_box(b"vmhd", bytes(8), flags=1), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full_box(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0), version=1), full_box(b"hdlr", bytes(4) + b"vide" + bytes(12) + b"\0"), minf)
        tkhd = full_box(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">hhhH", 0, 0, 0, 0), matrix, struct.pack(">II", SIDE << 16, SIDE << 16), version=1, flags=3)
        mvhd = full_box(b"mvhd", struct.pack(">QQIQ", 0, 0, TIMESCALE, ticks), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = ftyp + movie(len(ftyp) + len(movie(0)) + 8)  # offsets are 64-bit, so the size doesn't depend on them
    return head + struct.pack(">I", 8 + len(payload)) + b"mdat" + payload


def walk(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """Type, start and end of each box's body, parents before children, in file order."""
    todo = [(start, len(data) if end is None else end)]
    while todo:
        at, stop = todo.pop()
        if at + 8 > stop:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if at + 16 > stop:
                raise ValueError("a 64-bit box size is cut off")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        upto = stop if size == 0 else at + size
        if upto < body or upto > stop:
            raise ValueError(f"the box at {at} leaves its parent")
        yield kind, body, upto
        todo.append((upto, stop))
        if kind in CONTAINERS:
            todo.append((body, upto))


@dataclass
class Track:
    """What the sample tables of a track say; samples and keyframes are rows (start, end) in bytes of the file."""

    codec: str = ""
    timescale: int = 0
    duration: int = 0
    samples: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))
    keyframes: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0


def read_container(data: bytes | None) -> Track | None:
    """Tables of the first track that has any; None where the bytes are no such file."""
    try:
        return decode_tables(data or b"")
    except (ValueError, struct.error):
        return None


def entries(body: bytes, at: int, n: int, kind: str = "u4", each: int = 1) -> np.ndarray:
    """n big-endian entries of `each` numbers in a table's body."""
    width = int(kind[1]) * each
    if at + n * width > len(body):
        raise ValueError("a table is shorter than it says")
    return np.frombuffer(body, f">{kind}", n * each, at).astype(np.int64).reshape(n, each)


def decode_tables(data: bytes) -> Track | None:
    track, found = Track(), set()
    sizes, runs, chunks, sync = np.zeros(0, np.int64), np.zeros((0, 3), np.int64), np.zeros(0, np.int64), None
    for kind, at, end in walk(data):
        if kind == b"trak" and b"stsz" in found:
            break
        found.add(kind)
        if kind not in (b"mdhd", b"stsd", b"stsz", b"stsc", b"stco", b"co64", b"stss"):
            continue
        body = data[at:end]
        (version, count) = struct.unpack_from(">B3xI", body)
        if kind == b"mdhd":
            track.timescale, track.duration = struct.unpack_from(">IQ", body, 20) if version == 1 else struct.unpack_from(">II", body, 12)
        elif kind == b"stsd":
            track.codec = struct.unpack_from("4s", body, 12)[0].decode("latin-1") if count else ""
        elif kind == b"stsz":
            n = struct.unpack_from(">I", body, 8)[0]
            if count * n > len(data):
                raise ValueError("more samples than the file has bytes")
            sizes = np.full(n, count, np.int64) if count else entries(body, 12, n)[:, 0]
        elif kind == b"stsc":
            runs = entries(body, 8, count, each=3)
            if (np.diff(runs[:, 0], prepend=0) <= 0).any():
                raise ValueError("runs of chunks are not in order")
        elif kind == b"stss":
            sync = entries(body, 8, count)[:, 0]
        else:
            chunks = entries(body, 8, count, "u4" if kind == b"stco" else "i8")[:, 0]
    if not {b"moov", b"stsd", b"stsz", b"stsc"} <= found:
        return None
    track.samples = sample_ranges(sizes, runs, chunks)
    if len(track.samples) and (track.samples.min() < 0 or track.samples[:, 1].max() > len(data)):
        raise ValueError("a sample lies outside the file")
    track.keyframes = track.samples if sync is None else track.samples[sync[(sync > 0) & (sync <= len(track.samples))] - 1]
    return track


def sample_ranges(sizes: np.ndarray, runs: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Start and end of each sample: the samples of a chunk follow each other from the chunk's offset."""
    run = np.searchsorted(runs[:, 0], np.arange(1, len(chunks) + 1), "right") - 1
    held = np.where(run >= 0, runs[np.maximum(run, 0), 1] if len(runs) else 0, 0)
    upto = np.minimum(np.cumsum(np.minimum(held, len(sizes))), len(sizes))  # a chunk beyond the last sample is empty
    number = np.diff(upto, prepend=0)
    used = sizes[: upto[-1] if len(upto) else 0]
    before = np.concatenate([[0], np.cumsum(used)])
    start = np.repeat(chunks - before[upto - number], number) + before[:-1]
    return np.stack([start, start + used], axis=1)


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes filled up with 255 to a positive multiple of FRAME, and their own number."""
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME), len(raw)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a media column: id, n_bytes, media (the file), codec, duration_ms, keyframes."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            files, sizes, codecs, spans, keys = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                payload, size = padded(text)
                media = write_container(payload)
                track = read_container(media)
                files.append(media), sizes.append(size), codecs.append(track.codec)
                spans.append(round(track.seconds * 1000)), keys.append(ranges_of(track))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary()), pa.array(codecs, pa.string()), pa.array(spans, pa.int64()), pa.array(keys, RANGES)],
                ["id", "n_bytes", "media", "codec", "duration_ms", "keyframes"],
            )

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, "id long, n_bytes long, media binary, codec string, duration_ms long, keyframes array<struct<start:long,end:long>>")


RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def ranges_of(track: Track) -> list[dict]:
    return [{"start": a, "end": b} for a, b in track.keyframes.tolist()]


def probe_media(files: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """(id, codec, duration_ms, keyframes) of a column of files from anywhere; nulls where one can't be read."""
    small_batches(files.sparkSession)

    def run(batches):
        for batch in batches:
            tracks = [read_container(m) for m in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([t and t.codec for t in tracks], pa.string()),
                    pa.array([None if t is None else round(t.seconds * 1000) for t in tracks], pa.int64()),
                    pa.array([t and ranges_of(t) for t in tracks], RANGES),
                ],
                ["id", "codec", "duration_ms", "keyframes"],
            )

    return map_arrow(files.select(F.col(id_col).cast("long"), F.col(media_col).cast("binary")), run, "id long, codec string, duration_ms long, keyframes array<struct<start:long,end:long>>")


def media_digests(stored: DataFrame) -> DataFrame:
    """What can be read back from stored media: payload digests and the tables as one string; nulls where a file can't be read."""

    def run(batches):
        for batch in batches:
            rows = []
            for n, media in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                track = read_container(media)
                if track is None:
                    rows.append((n, *[None] * 6))
                    continue
                payload = b"".join(media[a:b] for a, b in track.samples.tolist())
                ranges = zlib.crc32(track.keyframes.astype("<u8").tobytes())
                feature = f"codec={track.codec.strip()};ticks={track.duration}/{track.timescale};samples={len(track.samples)};keyframes={len(track.keyframes)};ranges={ranges:08x}"
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return map_arrow(stored.select("id", "n_bytes", "media"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(store_media(table(spark, sf_dir, "documents")))
