import math
from fractions import Fraction

import numpy as np
from chronomesh.llm.topk import Best, Block, choose_pivots, search_block, sortable, top_k
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def plain(rows, every, k=10):
    fine = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, q in sorted(fine, reverse=True):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in fine if j != i and len(v) == len(q))[:k]
            out[i] = [(rank, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for rank, (s, j) in enumerate(scores, 1)]
    return {i: own for i, own in out.items() if own}


def some_rows(n=300, d=8):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=d) * (0.01 if i % 3 else 1))]) for i in range(n)]
    rows[7] = (7, None)
    rows[20] = (20, [None] + rows[20][1][1:])
    rows[30] = (30, [math.nan] + rows[30][1][1:])
    rows[40] = (40, [math.inf] + rows[40][1][1:])
    rows[50] = (50, [200_000.0] * d)
    rows[51] = (51, [-150_000.0] * d)
    rows[52] = (52, [300_000.0] * d)
    rows += [(n + j, rows[11][1]) for j in range(15)]  # ties
    return rows


def check(spark, rows, kind="float", **how):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, score int, rank string").repartition(4)
    got = {}
    for r in top_k(df, F.col("vec_id") % 10 == 0, **how).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: sorted(v) for q, v in got.items()} == plain(rows, 10)


def test_equals_brute_force(spark):
    check(spark, some_rows())


def test_in_blocks(spark):
    check(spark, some_rows(), block=7)


def test_few_and_none(spark):
    check(spark, some_rows()[:4])
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(df, F.col("vec_id") % 10 == 0).count() == 0


def test_values_of_any_size(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(260):
        size = 10.0 ** int(rng.choice([-3, 0, 3, 6, 12, 30, 120, 300, 307]))
        rows.append((i, [float(x) * size for x in rng.normal(size=6)]))
    rows += [(260 + j, [x * 10.0**30 for x in (1.0, -2.0, 0.5, 3.0, 0.0, j % 2)]) for j in range(40)]
    check(spark, rows, kind="double")
    check(spark, rows, kind="double", block=9)


def test_other_lengths_and_empty_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=(0, 1, 3, 200)[i % 4])]) for i in range(120)]
    rows += [(None, [1.0, 2.0, 3.0]), (10, [1.0, 2.0, 3.0]), (10, [1.0, 2.0, -3.0])]
    df = [(i, v) for i, v in rows if i != 10]
    check(spark, df, kind="double")
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 10).collect()
    assert len(got) == 10 and all(r.vec_id != 10 for r in got)  # one query, its least vector; no row of its own id


@given(st.lists(st.one_of(st.integers(), st.integers(-(1 << 64), 1 << 64), st.integers(-(1 << 600), 1 << 600)), min_size=2, max_size=6))
@settings(max_examples=200, deadline=None)
def test_sortable(scores):
    wide = [s for s in scores if sortable(s) is not None]
    assert sorted(wide, key=sortable) == sorted(wide) and all(abs(s) < 1 << 62 for s in scores if s not in wide)


def test_floors_save_scores():
    rng = np.random.default_rng(7)
    v = np.float32(rng.normal(size=(3000, 16))) + np.float32(rng.normal(size=(10, 16)) * 6)[rng.integers(0, 10, 3000)]
    block = Block(list(range(600)), v[:600].tolist(), 10, 1024)
    whole = np.floor(v.astype(float) * 1024).astype(np.int64)
    counts = [search_block(best, block.ids, block.queries, block.pivots, np.arange(3000), whole) for best in (Best(600, 10), block.best())]
    assert counts[1] < counts[0]


def test_elimination_saves_scores():
    rng = np.random.default_rng(4)
    centres = rng.integers(-9000, 9000, (20, 16))
    v = centres[rng.integers(0, 20, 4000)] + rng.integers(-50, 50, (4000, 16))
    best = Best(5, 10)
    n = search_block(best, np.arange(5), v[:5], choose_pivots(v[:500], 24), np.arange(4000), v)
    assert n < 5 * 4000 / 2
    for q in range(5):
        want = sorted((-int(v[q] @ x), i) for i, x in enumerate(v) if i != q)[:10]
        assert [(-int(s), int(i)) for s, i in zip(*best.rows[q], strict=True)] == want
