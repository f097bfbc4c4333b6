import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from chronomesh.llm import repeats
from chronomesh.llm.repeats import cut_texts, repeat_digests, repeated_spans, runs, whole_characters, with_key


def plain(texts, depth):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for r in raws:
        for s in range(len(r) - depth + 1):
            seen[r[s : s + depth]] = seen.get(r[s : s + depth], 0) + 1
    out = []
    for r in raws:
        gone = [False] * len(r)
        for s in range(len(r) - depth + 1):
            if seen[r[s : s + depth]] > 1:
                gone[s : s + depth] = [True] * depth
        rest = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(rest).hexdigest()))
    return out


def some_texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(10, 90))) for _ in range(12)]
    out = [None, "", "a", "a" * 199, "a" * 200, "a" * 500, "ab" * 300, passages[0], passages[0]]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 6)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts.append(rng.choice([p, p[a:], p[: a + 30], word(), " ".join(word() for _ in range(40))]))
        out.append(" ".join(parts))
    return out


def run_both(spark, texts, depth=200, **limits):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    docs = docs.withColumn("k", F.lit(1)).withColumn("spans", F.lit("x"))
    found = repeated_spans(docs, depth=depth, **limits)
    rows = with_key(docs).join(repeat_digests(found, depth), ["t1", "t2"]).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert len(rows) == len(texts)
    want = plain(texts, depth)
    assert [got[i] for i in range(len(texts))] == want
    return want


def test_equals_brute_force(spark):
    want = run_both(spark, some_texts(1))
    assert 5 < sum(0 < w[1] < w[0] for w in want)


def test_hot_anchor_goes_by_windows(spark):
    run_both(spark, some_texts(2), most=2)


def test_rows_of_an_anchor_in_pieces():
    k = np.array([1, 1, 1, 2, 3, 3], np.int64)
    c = np.array([5, 5, 6, 7, 8, 9], np.int64)
    found = {kind: rows.tolist() for rows, kind in repeats.marked(k, c, False)}
    assert found == {repeats.REPEATED: [0, 1], repeats.BYTES: [0, 2, 4, 5], repeats.WINDOWS: []}


def test_pieces_of_a_huge_anchor(spark):
    run_both(spark, some_texts(3), held_rows=3)


def test_pieces_of_a_huge_anchor_without_repeats(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line = min((word(64) for _ in range(20_000)), key=lambda x: int(repeats.rolling(np.frombuffer(x.encode(), np.uint8), 64)[0] * np.uint32(0xC2B2AE3D)))
    docs = spark.createDataFrame([(word(200) + line + word(200),) for _ in range(20)], "text string")
    texts = repeats.distinct_texts(docs, "text")
    rows = repeats.anchor_rows(texts, 200, 64).cache()
    hot = rows.groupBy("k").count().orderBy(F.desc("count")).first()
    assert hot["count"] == 20
    found = repeats.stretches(repeats.mark_runs(rows.where(F.col("k") == hot["k"]), held_rows=3), texts, 200)
    assert found.count() == 20 and repeats.resolve_windows(found, 200).count() == 0


def test_radix_passes_equal_brute_force():
    rng = random.Random(6)
    for depth in (1, 7, 8, 20, 64):
        raw = bytes(rng.choice(b"ab") for _ in range(300)) * 2 + bytes(rng.choice(b"abc") for _ in range(400))
        at = np.array([rng.randrange(len(raw) - depth) for _ in range(500)])
        group = np.array([rng.randrange(3) for _ in at])
        seen = Counter((g, raw[a : a + depth]) for g, a in zip(group.tolist(), at.tolist(), strict=True))
        want = [i for i, (g, a) in enumerate(zip(group.tolist(), at.tolist(), strict=True)) if seen[g, raw[a : a + depth]] > 1]
        assert sorted(repeats.radix_repeats(group, at, np.frombuffer(raw, np.uint8), depth).tolist()) == want
    none = np.zeros(0, int)
    assert len(repeats.radix_repeats(none, none, np.zeros(0, np.uint8), 8)) == 0


def test_long_texts_null_and_repeated_ids(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = word(700)
    texts = [word(300_000) + shared + word(10), shared + word(200_000), word(500) + shared]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, None), (2, "x" * 150)], "doc_id long, text string")
    rows = with_key(docs).join(repeat_digests(repeated_spans(docs)), ["t1", "t2"]).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in rows) == sorted((len(t), n, int(n > 0)) for t, n in ((texts[0], 700), (texts[1], 700), (texts[2], 700), ("", 0), ("x" * 150, 0)))


def test_runs_cover_all_windows():
    raw = ("abc " * 100 + "xyz" * 90).encode()
    place, first, last = runs(raw, 200, 64)
    assert first[0] == 0 and last[-1] == len(raw) - 200 and (first[1:] == last[:-1] + 1).all()
    assert all(a <= p and p + 64 <= a + 200 and p >= b for p, a, b in zip(place, first, last, strict=True))


def test_empty_table_and_characters(spark):
    assert repeat_digests(repeated_spans(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    raw = "aéb".encode()
    assert whole_characters(raw, [(0, 2)]) == [(0, 1)] and whole_characters(raw, [(2, 4)]) == [(3, 4)]
    docs = spark.createDataFrame([(1, "é" * 300 + "x"), (2, "é" * 300)], "doc_id long, text string")
    rows = with_key(docs).withColumnsRenamed({"t1": "a", "t2": "b"})
    assert sorted(r.text for r in cut_texts(rows, repeated_spans(docs), ("a", "b"), "text").collect()) == ["", "x"]
