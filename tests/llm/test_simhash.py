import re
from collections import Counter
from itertools import combinations

import numpy as np
import xxhash
from chronomesh.llm.components import components
from chronomesh.llm.simhash import assign, fingerprints, link_codes, near_duplicates, part_masks, parts_for, spread_join
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def plain(text, k=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def closure(codes, radius=4):
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    codes = list(root)
    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {c: find(c) for c in codes}


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB é\n\t\x0b\x85 ", max_size=40)), max_size=8))
@settings(max_examples=60, deadline=None)
def test_fingerprints(texts):
    assert fingerprints(texts, 4).tolist() == [plain(t) for t in texts]


def some_codes(rng, n):
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 40, dtype=np.uint64)
    out = set(map(int, base))
    while len(out) < n:
        c = int(rng.choice(base)) if rng.random() < 0.5 else int(rng.choice(list(out)))
        for b in rng.integers(0, 64, rng.integers(1, 6)):
            c ^= 1 << int(b)
        out.add(c)
    return np.array(sorted(out), np.uint64)


def test_index_equals_brute_force():
    rng = np.random.default_rng(1)
    for n in (2, 40, 300, 700):
        codes = some_codes(rng, n)
        u, v = link_codes(codes, np.zeros(len(codes), np.int64), 4)
        root = {int(c): int(c) for c in codes} | dict(zip(map(int, u), map(int, v), strict=True))
        want = closure(map(int, codes))
        assert Counter(Counter(root.values()).values()) == Counter(Counter(want.values()).values())
        assert root == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 140)] + [(7, 7), (139, 200), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in [*range(100, 140), 200])
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_links_over_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr("chronomesh.llm.simhash.CELL", 50)
    codes = some_codes(np.random.default_rng(2), 600)
    prints = spark.createDataFrame([(i, int(c)) for i, c in enumerate(codes.view(np.int64).tolist())], "doc_id long, fp long")
    want = closure(map(int, codes))
    number = {int(c): i for i, c in enumerate(codes)}
    for same in (None, 2, 3):  # parts that must agree
        got = {r.fp % (1 << 64): r.component_id for r in assign(prints, 4, same).collect()}
        assert got == {c: min(number[x] for x in want if want[x] == r) for c, r in want.items()}


def test_parts_grow_with_the_fingerprints():
    assert [parts_for(n, 4) for n in (0, 10**6, 10**7, 10**8, 10**9, 10**11)] == [1, 1, 1, 2, 2, 3]
    assert [len(part_masks(4, n)) for n in (1, 2, 3)] == [5, 15, 35]
    for n in (1, 2, 3):
        for bits in combinations(range(0, 64, 9), 4):
            assert any(not sum(1 << b for b in bits) & m & (1 << 64) - 1 for m in part_masks(4, n))


def test_hot_and_rare_keys_join_alike(spark):
    rows = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(6_000)], "doc_id long, fp long")
    values = rows.groupBy("fp").count().withColumnRenamed("count", "n").withColumn("x", F.col("fp") * 2)
    got = spread_join(rows, values, "fp")
    assert got.count() == 6_000 and got.where("x <> 2 * fp").count() == 0 and got.columns == ["fp", "doc_id", "x"]


def test_documents(spark):
    texts = [None, "", "  \n", "one two", "One TWO", "a b c d e f", "a b c d e f", "x " * 50_000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a b c d e f", 1)], "doc_id long, text string, fp int")
    rows = near_duplicates(docs).collect()
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in rows}
    assert len(rows) == 9 and all(got[i][0] == plain(t) for i, t in enumerate(texts))
    assert {got[i][1] for i in (0, 1, 2)} == {0} and got[4][1] == 3 and got[6][1] == got[None][1] == 5
    assert near_duplicates(docs.limit(0)).count() == 0
