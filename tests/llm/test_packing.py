import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from chronomesh.llm import packing
from chronomesh.llm.bytebpe import encoder
from chronomesh.llm.packing import Shelf, cut, fullest, pack, plan
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


LIBRARY = Tokenizer.from_file(PATH)


@given(st.one_of(st.text(max_size=60), st.text(alphabet="aAzé' \n\t 1.<|endoftext>", max_size=60), st.lists(st.sampled_from(["<|endoftext|>", " ", "a", "\n", "<|"]), max_size=8).map("".join)))
@settings(max_examples=400, deadline=None)
def test_ids_equal_the_library(text):
    assert encoder(PATH).by_rank
    assert np.frombuffer(encoder(PATH).encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_long_runs():
    for text in (" " * 50_000, "a" * 50_000, "\n\n" * 20_000, "é" * 20_000, "x<|endoftext|>y"):
        assert np.frombuffer(encoder(PATH).encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_cut():
    assert cut(1, 1024) == [(0, 1)] and cut(1024, 1024) == [(0, 1024)]
    assert cut(1025, 1024) == [(0, 1), (1, 1024)] and cut(2048, 1024) == [(0, 1024), (1024, 1024)]


def test_fullest():
    assert sum(fullest([500, 300, 200], {500: 1, 300: 5, 200: 2}, 1000)) == 1000
    assert fullest([700], {700: 3}, 600) == [] and sum(fullest([300], {300: 2}, 1000)) == 600


def check_plan(counts):
    used, segments = plan(counts)
    ranks, filled = defaultdict(list), defaultdict(list)
    for length, rank, n, first, place in segments:
        ranks[length].append((rank, n))
        for i in range(n):
            filled[first + i].append((place, length))
    for length, own in ranks.items():
        at = 0
        for rank, n in sorted(own):
            assert rank == at
            at += n
        assert at == counts[length]
    assert sorted(filled) == list(range(used))
    for own in filled.values():
        at = 0
        for place, length in sorted(own):
            assert place == at
            at += length
        assert at <= 1024
    assert set(ranks) == {n for n, c in counts.items() if c}
    return used, -(-sum(n * c for n, c in counts.items()) // 1024)


def best_fit(counts):
    shelf = Shelf(1024)
    shelf.best_fit(list(counts.items()))
    return shelf.used


def optimum(lengths, capacity=1024):
    """Fewest sequences, by trying every place for every piece."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= lengths[i]}.values():
            place(i + 1, [*rooms[:j], rooms[j] - lengths[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


def test_plans():
    rng = random.Random(1)
    assert check_plan({}) == (0, 0) and check_plan({1: 5})[0] == 1 and check_plan({600: 10})[0] == 10
    for draw, share in ((lambda: rng.randint(1, 1023), 1.02), (lambda: min(1023, int(rng.lognormvariate(5, 1)) + 1), 1.01), (lambda: rng.randint(300, 700), 1.1)):
        for n in (10, 1000, 20_000):
            counts = Counter(draw() for _ in range(n))
            used, least = check_plan(counts)
            assert used <= least * share + 2 and used <= best_fit(counts) * 1.002 + 1, (n, used, least)


def test_plans_against_the_optimum():
    rng = random.Random(3)
    over = 0
    for _ in range(300):
        low, high = rng.choice([(1, 1023), (150, 700), (200, 520), (330, 360)])
        lengths = [rng.randint(low, high) for _ in range(rng.randint(1, 9))]
        used, least = check_plan(Counter(lengths))[0], optimum(lengths)
        assert least <= used <= least + 1
        over += used > least
    assert over <= 6


def test_groups_round_up():
    """With fewer groups than lengths, plans stay whole and lose at most a group's pieces."""
    rng = random.Random(4)
    counts = Counter(rng.randint(1, 1023) for _ in range(5_000))
    for groups in (4, 64, 1024):
        assert plan(counts, groups=groups)[0] <= plan(counts, groups=16_384)[0] + 5_000 / groups + 1


def test_given_documents_are_rounded(spark, monkeypatch):
    """Fewer sizes than lengths go into configurations, and no more sequences than best-fit takes."""
    seen = []

    def spied(sizes, left, room):
        seen.append(len(left))
        return fullest(sizes, left, room)

    monkeypatch.setattr(packing, "fullest", spied)
    for sf in ("sf0.01", "sf0.1"):
        counts = Counter(n for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("text").collect() for _, n in cut(len(encoder(PATH).encode(r.text or "")) // 4 + 1, 1024))
        counts = {n: c for n, c in counts.items() if n < 1024}
        lengths, groups = sum(n > packing.SMALL[0] for n in counts), min(packing.GROUPS, sum(c for n, c in counts.items() if n > packing.SMALL[0]))
        seen.clear()
        used, least = check_plan(counts)
        assert max(seen) <= groups < lengths
        assert least <= used <= best_fit(counts)


def test_plan_size_does_not_grow_with_the_pieces():
    rng = random.Random(5)
    counts = Counter(rng.randint(1, 1023) for _ in range(50_000))
    sizes = [len(plan({n: c * times for n, c in counts.items()})[1]) for times in (1, 1_000, 1_000_000)]
    assert max(sizes) < 100_000


def test_documents(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "a", "x<|endoftext|>y", "word " * 5000, "é" * 3000] + [" ".join(rng.choice("the of and tion") for _ in range(rng.randint(0, 1500))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, row int").repartition(5)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pack(docs, PATH).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(texts):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for piece, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (piece, at) and (r.length == 1024 or piece == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert pack(docs.limit(0), PATH).count() == 0
