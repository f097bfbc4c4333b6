import re
from itertools import combinations

import corpus_pipeline
import numpy as np
from chronomesh.llm import nearcopies, simhash
from chronomesh.llm.nearcopies import Judge, cell_forest, exact_links, near_copies, set_fingerprints, set_keys, shingle_set, strangers, without_copies
from chronomesh.llm.repeats import repeated_spans
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def shingles(text, k=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.lower().encode())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_stages_keep_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DATA).cache()
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        assert 0 < after.count() <= before
        before, docs = after.count(), after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == before
    assert corpus_pipeline.run(spark, DATA).select("doc_id").distinct().count() == before


def test_good_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.language_stage):
        kept = stage(spark, docs, sf)
        good = labels.where("quality = 1")
        assert good.join(kept, "doc_id", "left_anti").count() <= 0.005 * good.count()


def test_near_copies_are_found_and_others_stay(spark):
    rng = np.random.default_rng(6)
    word = [f"w{i}" for i in range(5000)]
    base = [[word[j] for j in rng.integers(0, 5000, 300)] for _ in range(30)]
    texts = [" ".join(b) for b in base]
    for b in base[:15]:  # one or two words changed: similarity 0.93 and more
        c = list(b)
        for j in rng.integers(0, 300, 2):
            c[j] = "changed"
        texts.append(" ".join(c))
    texts += [" ".join(b[:200] + [word[j] for j in rng.integers(0, 5000, 100)]) for b in base[15:]]  # similarity 0.5
    texts += [texts[0], texts[0].upper(), None, "", " "]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, code int, node string")
    got = {r.doc_id: r.component_id for r in near_copies(docs).collect()}
    for i in range(15):
        assert got[30 + i] == i
    assert all(got[45 + i] == 45 + i for i in range(15)) and got[60] == got[61] == 0 and got[62] == got[63] == got[64] == 62
    kept = corpus_pipeline.near_copy_stage(spark, docs.union(docs.where("doc_id in (0, 3)")), DATA)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(30), *range(45, 60), 62]


def test_rows_and_not_ids_are_documents(spark):
    rng = np.random.default_rng(16)
    text = lambda: " ".join(f"w{i}" for i in rng.integers(0, 9999, 80))
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a), (1, b), (1, b), (2, a), (None, a), (None, c), (None, c + " more"), (3, ""), (4, None), (None, " "), (5, d)]
    docs = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, t1 string, n long")
    kept = without_copies(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == 5 and set(got) >= {(1, a), (1, b), (3, ""), (5, d)} and {t for i, t in got if i is None} <= {c, c + " more"}
    assert without_copies(docs.limit(0)).count() == 0 and near_copies(docs.limit(0)).count() == 0


def closure(texts, similarity=0.8):
    sets = [shingles(t) if t.split() else set() for t in texts]
    root = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) and root[a] != root[b]:
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    return root


def families(seed, groups=25, each=14, words=120):
    """Texts of families whose members differ by none to a sixth of their words, and that share lines."""
    rng = np.random.default_rng(seed)
    lines = [" ".join(f"line{i}x{j}" for j in range(40)) for i in range(3)]
    texts = []
    for _ in range(groups):
        base = [f"w{i}" for i in rng.integers(0, 1 << 40, words)]
        for _ in range(each):
            own = list(base)
            for at in rng.integers(0, words, rng.integers(0, 4)):
                own[at] = f"c{rng.integers(0, 1 << 40)}"
            texts.append(" ".join([*own, *([lines[rng.integers(0, 3)]] * int(rng.integers(0, 2)))]))
    return texts


def test_near_copies_equal_brute_force(spark):
    texts = families(11) + ["a b", "a b c", "a b c d e f", "a b c d e f g", "", " ", "A  b"]
    want = closure(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for most in (4_096, 12):  # whole cells, and cells cut into blocks
        got = {r.doc_id: r.component_id for r in near_copies(docs, most=most).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert 60 < len(set(want)) < len(texts) * 0.7


def test_sets_and_keys():
    texts = families(12, 3, 4) + ["", "a", "a b", "é É", "x\x0by  z\tq"]
    for t in texts:
        assert len(shingle_set(t, 5)) == (len(shingles(t)) if t.split() else 0)
    assert (shingle_set("A b\n c d e f", 5) == shingle_set("a B c  d e f", 5)).all()
    sets = [shingle_set(t, 5) for t in texts]
    keys = set_keys(sets)
    assert keys.shape == (len(texts), 16) and len(set(keys[0].tolist())) == 16 and not keys[12].any()
    long = shingle_set("word " * 3 + " ".join(f"w{i}" for i in range(200_000)), 5)
    assert len(long) == 200_003 - 4


def test_share_of_pairs_that_share_a_key():
    rng, met = np.random.default_rng(13), 0
    for _ in range(2_000):
        h = rng.integers(0, 1 << 63, 300, dtype=np.uint64)  # 240 of 300 in both
        a, b = set_keys([np.sort(h[:270]), np.sort(h[30:])])
        met += bool((a == b).any())
    assert met >= 1_996


def test_cells_equal_brute_force():
    texts = families(14, 4, 30)
    sets = [shingle_set(t, 5) for t in texts]
    judge = Judge(set_fingerprints(sets), np.array([len(x) for x in sets]), 0.8)
    one, alone = np.zeros(len(texts), np.int64), np.arange(len(texts))
    a, b = exact_links(judge, one, alone, sets)
    root = list(range(len(texts)))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        low, high = sorted((root[x], root[y]))
        assert low != high  # a forest
        root = [low if r == high else r for r in root]
    assert root == closure(texts)
    label = np.array(root)
    u, v, _ = cell_forest(judge, one, alone)
    assert len(u) < len(texts) and {*u.tolist(), *v.tolist()} >= {i for i in range(len(texts)) if root.count(root[i]) > 1}
    assert len(exact_links(judge, one, label, sets)[0]) == 0 and len(strangers(judge, one, np.zeros(len(texts), int))) == 0


def test_repeat_stage(spark):
    docs = spark.createDataFrame([(1, None, 0, "n"), (2, "é" * 300 + "x", 301, "n"), (3, "é" * 300, 300, "n"), (4, "short", 5, "n")], "doc_id long, text string, n_chars long, t1 string")
    rows = {r.doc_id: r for r in corpus_pipeline.repeat_stage(spark, docs, DATA).collect()}
    assert (rows[1].text, rows[2].text, rows[3].text, rows[4].text) == (None, "x", "", "short") and rows[2].n_chars == 1
    assert rows[1].t1 == "n" and repeated_spans(docs).where(F.size("spans") > 0).count() == 2


def test_a_repeated_line_does_not_make_copies(spark):
    rng = np.random.default_rng(8)
    line = " ".join(f"l{i}" for i in range(14))
    texts = []
    for _ in range(8):
        own = [f"w{j}" for j in rng.integers(0, 100_000, 204)]
        texts.append(" ".join([*own, *[line] * 20]))
    for same in (44, 45):  # 49 shingles in each: 40 of 58 and 41 of 57 in both
        texts += [" ".join([*[f"{same}s{i}" for i in range(same)], *[f"{same}{x}{i}" for i in range(9)]]) for x in "ab"]
    assert max(len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in combinations(texts, 2)) < 0.8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert corpus_pipeline.near_copy_stage(spark, docs, DATA).count() == len(texts)


def test_pairs_around_the_bound(spark):
    rng, texts, alike = np.random.default_rng(9), [], []
    for n in range(200):
        own = 244 + n % 30  # of 300 words at the front of both
        tail = rng.integers(0, 1 << 40, 2 * (300 - own))
        front = [f"w{i}" for i in rng.integers(0, 1 << 40, own)]
        a, b = (" ".join([*front, *(f"w{i}" for i in t)]) for t in np.split(tail, 2))
        x, y = shingles(a), shingles(b)
        alike.append(len(x & y) / len(x | y) >= 0.8)
        texts += [a, b]
    assert 20 < sum(alike) < 180
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[2 * i + 1] == 2 * i for i in range(200)] == alike


def test_a_large_group_around_the_bound(spark):
    """Hundreds of texts, most pairs of which are a little below the bound: all links are found, and few pairs leave a task."""
    rng = np.random.default_rng(15)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(400):
        own = list(base)
        for at in rng.integers(0, 200, 4):
            own[at] = f"c{rng.integers(0, 1 << 40)}"
        texts.append(" ".join(own))
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), most=64).collect()}
    assert [got[i] for i in range(400)] == closure(texts)


def test_texts_in_other_languages_go(spark):
    foreign = [
        "Съешь же ещё этих мягких французских булок, да выпей чаю, а потом иди домой",
        "我能吞下玻璃而不伤身体。今天天气很好，我们去公园散步，然后回家吃晚饭。",
        "הקיפודים אוהבים לאכול תותים בגינה שלנו",
        "Suomen kielen sana jota käytetään esimerkkinä sisältää kaikki kirjaimet mutta ei ole kovin yleinen puheessa",
        "Pchnąć w tę łódź jeża lub ośm skrzyń fig, a potem wrócić do domu przed zmrokiem bo będzie zimno",
        "Pijamalı hasta yağız şoföre çabucak güvendi ve sonra evine dönmek için yola çıktı ama hava çok soğuktu",
    ]
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    planted = docs.limit(1).crossJoin(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(foreign)], "n long, t string"))
    planted = planted.withColumns({"doc_id": F.col("n").cast(docs.schema["doc_id"].dataType), "text": F.col("t"), "lang": F.lit(None).cast("string")}).select(*docs.columns)
    kept = corpus_pipeline.language_stage(spark, docs.union(planted), sf)
    assert kept.where("doc_id < 0").count() == 0 and kept.count() > 0.98 * docs.count()


def test_cells_are_searched_by_a_tree_in_gray_order(monkeypatch):
    rng = np.random.default_rng(17)
    base = rng.integers(0, 1 << 63, (60, 4), dtype=np.uint64)[rng.integers(0, 60, 900)]
    codes = base ^ np.array([[sum(1 << k for k in set(rng.integers(0, 64, rng.integers(0, 9)).tolist())) for _ in range(4)] for _ in range(900)], np.uint64)
    judge, cell = Judge(codes, rng.integers(20, 90, 900), 0.8), np.sort(rng.integers(0, 12, 900))
    met = []
    monkeypatch.setattr(nearcopies, "tree_pairs", lambda *how: ((met.append(len(x)), (x, y))[1] for x, y in simhash.tree_pairs(*how)))
    pairs = lambda parts: sorted(p for a, b in parts for p in zip(*(x.tolist() for x in judge.near(a, b)[:2]), strict=True))
    whole = pairs(nearcopies.pairs_in(cell))
    assert pairs(nearcopies.met_in(judge, cell, lambda a, b: a != b)) == whole and len(whole) > 300
    assert 0 < sum(met) < 3 * len(whole)  # far pairs are not met
    order = simhash.gray_order(codes, np.zeros(900))
    ranks = [sum(int(w) << 64 * (3 - k) for k, w in enumerate(c)) for c in codes[order]]
    for shift in (1, 2, 4, 8, 16, 32, 64, 128):
        ranks = [r ^ (r >> shift) for r in ranks]
    assert ranks == sorted(ranks)
