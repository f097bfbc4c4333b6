import hashlib
import struct
import tracemalloc
import zlib

from chronomesh.llm.media import FRAME, box, full_box, media_digests, padded, probe_media, read_container, store_media, write_container
from hypothesis import given, settings
from hypothesis import strategies as st


def plain_read(data):
    """Payload and keyframe ranges, read box by box without the operator's code."""

    def inside(start, end, path):
        while start < end:
            size, kind = struct.unpack(">I4s", data[start : start + 8])
            if kind == path[0]:
                return (start + 8, start + size) if len(path) == 1 else inside(start + 8, start + size, path[1:])
            start += size
        raise KeyError(path)

    def table(name, form, head=8):
        a, b = inside(0, len(data), [b"moov", b"trak", b"mdia", b"minf", b"stbl", name])
        return list(struct.iter_unpack(form, data[a + head : b]))

    each, n = struct.unpack(">II", struct.pack(">II", *table(b"stsz", ">II", 4)[0]))
    runs, chunks, ranges = table(b"stsc", ">III"), [c for (c,) in table(b"co64", ">Q")], []
    for i, at in enumerate(chunks, 1):
        count = [c for first, c, _ in runs if first <= i][-1]
        ranges += [(at + each * j, at + each * (j + 1)) for j in range(count)]
    assert len(ranges) == n
    return b"".join(data[a:b] for a, b in ranges), [ranges[k - 1] for (k,) in table(b"stss", ">I")]


def test_round_trip_of_many_sizes():
    for n in (1, 2, 11, 12, 13, 63, 64, 65, 128, 200):
        payload = bytes(i * 7 % 251 for i in range(n * FRAME))
        media = write_container(payload)
        track = read_container(media)
        assert b"".join(media[a:b] for a, b in track.samples.tolist()) == payload
        assert plain_read(media) == (payload, [tuple(k) for k in track.keyframes.tolist()])
        assert track.codec == "raw " and len(track.keyframes) == -(-n // 12)
        assert track.duration * 25 == n * track.timescale


def test_bytes_that_are_no_container():
    media = write_container(bytes(FRAME))
    assert read_container(b"") is None
    assert read_container(b"not a media file at all") is None
    assert read_container(media[:-1]) is None and read_container(None) is None
    for at in range(0, len(media), 7):
        read_container(media[:at])
    assert read_container(media + box(b"mdhd")) is None


def movie(*tables, head=b""):
    return head + box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", *tables)))))


def test_tables_that_state_too_much():
    entry = full_box(b"stsd", struct.pack(">I", 1), box(b"raw "))
    runs = full_box(b"stsc", struct.pack(">IIII", 1, 1, 50_000_000, 1))
    chunk = full_box(b"stco", struct.pack(">II", 1, 0))
    tracemalloc.start()
    for sizes in (struct.pack(">II", 1, 50_000_000), struct.pack(">II", 0, 50_000_000), struct.pack(">II", 1 << 31, 1 << 31)):
        assert read_container(movie(entry, full_box(b"stsz", sizes), runs, chunk)) is None
    assert read_container(movie(entry, full_box(b"stsz", struct.pack(">II", 1, 5)), full_box(b"stsc", struct.pack(">I", 1 << 30)), chunk)) is None
    fine = read_container(movie(entry, full_box(b"stsz", struct.pack(">II", 1, 5)), runs, chunk))
    assert fine.samples.tolist() == [[i, i + 1] for i in range(5)] and (fine.keyframes == fine.samples).all()
    assert tracemalloc.get_traced_memory()[1] < 1 << 20
    tracemalloc.stop()


@given(st.integers(0, 1 << 30), st.lists(st.tuples(st.integers(0, 2_000), st.integers(0, 255)), min_size=1, max_size=6), st.integers(0, 60))
@settings(max_examples=600, deadline=None)
def test_damaged_files(seed, changes, cut):
    media = bytearray(write_container(bytes(seed % 251 for _ in range(FRAME * (seed % 3 + 1)))))
    for at, value in changes:
        media[at % len(media)] = value
    track = read_container(bytes(media[: len(media) - cut]))
    if track is not None:
        assert all(0 <= a <= b <= len(media) for a, b in track.samples.tolist()) and len(track.keyframes) <= len(media)


def test_foreign_files(spark):
    good = write_container(bytes(FRAME * 30))
    fragment = movie(full_box(b"mdhd", struct.pack(">IIII", 0, 0, 1000, 5000)), full_box(b"stsd", struct.pack(">I", 1), box(b"avc1")), full_box(b"stsz", bytes(8)), full_box(b"stsc", bytes(4)), full_box(b"stco", bytes(4)))
    files = [good, None, b"", b"text", good[:200], fragment + box(b"moof", bytes(20))]
    df = spark.createDataFrame([(i, m, 0) for i, m in enumerate(files)], "id long, media binary, codec int")
    rows = {r.id: r for r in probe_media(df).collect()}
    assert (rows[0].codec, rows[0].duration_ms, len(rows[0].keyframes)) == ("raw ", 1200, 3)
    assert all(tuple(rows[i][1:]) == (None, None, None) for i in range(1, 5))
    assert tuple(rows[5][1:]) == ("avc1", 5000, [])
    told = {r.doc_id: r for r in media_digests(df.withColumn("n_bytes", df.id)).collect()}
    assert told[0].payload_bytes == 30 * FRAME and all(tuple(told[i][2:]) == (None,) * 6 for i in range(1, 5)) and told[5].payload_bytes == 0
    assert probe_media(df.limit(0)).count() == 0


def test_documents(spark):
    texts = [None, "", "a", "é" * 288, "é" * 289, "x" * 100_000, "a"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    rows = {r.doc_id: r for r in media_digests(store_media(docs)).collect()}
    for i, text in enumerate(texts):
        payload, n = padded(text)
        assert (rows[i].n_bytes, rows[i].payload_bytes) == (n, len(payload))
        assert rows[i].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert rows[i].tail_crc32 == zlib.crc32(payload[-32:])
    assert rows[2][1:] == rows[6][1:] and rows[0].payload_bytes == FRAME
    assert media_digests(store_media(docs.limit(0))).count() == 0
