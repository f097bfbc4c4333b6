import hashlib
import random

import pytest
from chronomesh.llm import edits
from chronomesh.llm.registry import queries

SF = "/root/testdata/sf0.001"


def by_steps(text):
    """The same digits by one step after another, and by looking through every place of a writing."""
    if not text:
        return edits.EMPTY * (edits.WALKS * edits.CELLS)
    out = ""
    for n in range(edits.WALKS):
        bit = lambda step, c: int(edits.mix(edits.np.array([(n * edits.PERIOD + step % edits.PERIOD) * edits.LETTERS + ord(c) % edits.LETTERS]))[0]) >> 63  # noqa: B023, E731
        i, written = 0, []
        while i < len(text):
            written.append(text[i])
            i += bit(len(written) - 1, text[i])
        for own in edits.walks().places[n].tolist():
            place = max(p for p in own if p < len(written))
            x = edits.np.array([ord(written[place]) + (n << 32)], edits.np.uint64)
            out += f"{int(edits.mix(edits.mix(x) + edits.np.uint64(place))[0]) >> 60:x}"
    return out


def print_of(text):
    return edits.Readings([text]).prints[0]


def test_side_by_side_equals_alone(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abc dé") for _ in range(rng.choice((0, 1, 5, 90, 100, 700)))) for _ in range(120)]
    then = texts[1:] + texts[:1]
    together = edits.Readings(texts)
    monkeypatch.setattr(edits, "FEW", 10**9)
    alone = edits.Readings(texts)
    assert together.prints == alone.prints and together.edited(then) == alone.edited(then)


@pytest.mark.parametrize("text", [None, "", "a", "ab", "wörter 日本 😀", "the quick brown fox " * 20])
def test_fingerprint_equals_steps(text):
    assert print_of(text) == by_steps(text)


def test_places_are_spread_over_the_whole_writing():
    for length in (1, 10, 1_000, 10**6, 10**9):
        taken = [max(p for p in own if p < length) for w in edits.walks().places for own in w.tolist()]
        if length > 100:
            assert abs(sum(taken) / len(taken) / length - 0.5) < 0.06
    close = sum(max(p for p in own if p < 1_000) == max(p for p in own if p < 1_050) for w in edits.walks().places for own in w.tolist())
    assert close > 0.9 * 256


def brute(rows):
    """Rows in a list, by the contract's words; rows of one id by the hash that the operator states is left to the caller."""
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, then = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + then[:half]
        a, b, c = (by_steps(x) for x in (text, edited, then))
        same = lambda x, y: sum(p == q for p, q in zip(x, y, strict=True)) / 256
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, same(a, b), same(a, c)))
    return out


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_next_documents(spark, partitions):
    rng = random.Random(1)
    ids = [*rng.sample(range(-(10**15), 10**15), 60), 5, 9, None]
    rows = [(i, rng.choice([None, "", "x", "ab" * rng.randint(1, 20), "".join(rng.choice("abc é😀") for _ in range(rng.randint(0, 60)))])) for i in ids]
    df = spark.createDataFrame([(i, t, 1, False, "h") for i, t in rows], "doc_id long, text string, part int, border boolean, h string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted(tuple(r) for r in edits.edited_fingerprints(df).collect() if r.doc_id is not None)
        last = [tuple(r) for r in edits.edited_fingerprints(df).collect() if r.doc_id is None]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True))
    assert got == sorted(w for w in want if w[0] is not None) and last == [w for w in want if w[0] is None]


def test_few_rows(spark):
    schema = "doc_id long, text string"
    assert edits.edited_fingerprints(spark.createDataFrame([], schema)).count() == 0
    one = edits.edited_fingerprints(spark.createDataFrame([(3, "abcdef")], schema)).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one[0].near_next == 1
    same = edits.edited_fingerprints(spark.createDataFrame([(3, "abcdef")] * 40 + [(None, None)] * 3, schema)).collect()
    assert len(same) == 43 and len({r.fingerprint for r in same}) == 2


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = sorted(rows, reverse=True)
    got = {r.doc_id: r for r in queries()["op11_edit_fingerprint"](spark, SF).collect()}
    assert len(got) == len(rows)
    for (doc_id, text), (_, then) in zip(rows, [*rows[1:], rows[0]], strict=True):
        half, r = len(text or "") // 2, got[doc_id]
        edited = (text or "")[: len(text or "") - half] + (then or "")[:half]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.fingerprint == print_of(text) and r.edited_fingerprint == print_of(edited)
        if r.n_chars >= 200 and text != then:
            assert r.near_edited > 0.4 and r.near_edited > r.near_next
    assert sum(r.near_edited for r in got.values()) / len(got) > 0.5 > 0.25 > sum(r.near_next for r in got.values()) / len(got)


def test_few_edits_stay_near():
    rng, kept = random.Random(2), 0
    for _ in range(40):
        text = "".join(rng.choice("etaoin shrdlu") for _ in range(rng.randint(300, 900)))
        edited = list(text)
        for _ in range(5):
            at = rng.randrange(len(edited))
            edited[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "e"])
        kept += edits.likeness(print_of(text), print_of("".join(edited)))
    assert kept / 40 > 0.6


def test_classes_equal_all_pairs(spark):
    rng, texts = random.Random(4), [None, "", ""]
    for _ in range(25):
        base = "".join(rng.choice("etaoin shrdlu") for _ in range(400))
        texts += [base, base]
        for _ in range(3):
            at = rng.randrange(200, 400)
            texts.append(base[:at] + rng.choice("xyz") + base[at + 1 :])
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t, "f", 1) for i, t in enumerate(texts)], "doc_id int, text string, fingerprint string, node int")
    prints, root = [print_of(t) for t in texts], list(range(len(texts)))
    for _ in range(4):
        for i in range(len(texts)):
            for j in range(len(texts)):
                if edits.likeness(prints[i], prints[j]) >= edits.LIKE:
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: r.class_id for r in edits.near_classes(df).collect()}
    assert [got[i] for i in range(len(texts))] == root and len(set(root)) < len({t or "" for t in texts})
    assert edits.near_classes(df.limit(0)).count() == 0


def test_blocks_of_a_large_cell(spark, monkeypatch):
    monkeypatch.setattr(edits, "BLOCK", 5)
    base = "some words that all texts have, one after another, and a number "
    rows = [(i, base * 8 + str(i)) for i in range(60)]
    got = edits.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}
