import random

import pytest
from chronomesh.operators import polygons

from .chains import walked_chains


def test_walking():
    """The brute force itself, on lines that are plain to see."""
    assert walked_chains(dict(enumerate([[1, 2], [4, 3], [2, 3], [9, 8], [0, 1]]))) == {0: [0, 1, 2, 3, 4], 3: [9, 8]}
    assert walked_chains(dict(enumerate([[1, 2], [3, 2]])), turn=False) == {0: [1, 2], 1: [3, 2]}
    assert walked_chains(dict(enumerate([[2, 3], [1, 2], [1, 3]]))) == {0: [2, 3, 1, 2]}


@pytest.mark.parametrize("turn", [True, False])
@pytest.mark.parametrize("nodes", [4, 200])
def test_chains_equal_walks(spark, turn, nodes):
    """Junctions, circles, loops, doubled lines, lines of one node, several tiers; rows of no order."""
    rng = random.Random(nodes)
    rows = []
    for tier in range(3):
        for line in rng.sample(range(-1000, 1000), 150):
            rows.append((tier, line, [rng.randrange(nodes) for _ in range(rng.choice((1, 2, 2, 2, 3, 5)))]))
    ring = [(7, i, [i, (i + 1) % 37] if i % 3 else [(i + 1) % 37, i]) for i in range(37)] if turn else [(7, i, [i, (i + 1) % 37]) for i in range(37)]
    rows += ring + [(8, 1, [5, 6, 5]), (9, 1, []), (9, 2, [1, 2])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "tier long, line long, nodes array<long>, chain string").repartition(4)
    ended = df.withColumns({"head": polygons.F.element_at("nodes", 1), "tail": polygons.F.element_at("nodes", -1)})
    got = {(r.tier, r.chain): (r.nodes, r.closed) for r in polygons.chains(ended, turn).collect()}
    want = {}
    for tier in {r[0] for r in rows}:
        for name, own in walked_chains({line: n for t, line, n in rows if t == tier and n}, turn).items():
            want[tier, name] = own, own[0] == own[-1]
    assert got == want and any(c for _, c in want.values())


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(polygons, "settle", lambda df, f=polygons.settle: rounds.append(df.columns) or f(df))
    order = list(range(1000))
    random.Random(1).shuffle(order)
    df = spark.createDataFrame([(0, order[i], [i, i + 1]) for i in range(1000)], "tier long, line long, nodes array<long>")
    found = polygons.stitched_lines(df).collect()
    assert len(found) == 1 and sorted(found[0].nodes) == list(range(1001)) and abs(found[0].nodes[0] - found[0].nodes[-1]) == 1000
    assert sum("steps" in r for r in rounds) <= 14


def test_no_lines(spark):
    assert polygons.stitched_lines(spark.createDataFrame([], "tier long, line long, nodes array<long>")).count() == 0


def test_assembled_rings(spark):
    point = lambda a, b: {"lat": float(a), "lon": float(b)}
    rows = [("open", 1, 0, [point(0, 0), point(0, 1)]), ("open", 1, 1, [point(0, 1), point(1, 1), point(0, 0.0000001)]), ("open", 2, 0, [point(5, 5), point(6, 6)]), ("open", 3, 0, [point(8, 8), point(9, 9), point(8, 8)])]
    df = spark.createDataFrame(rows, "layer string, part long, pos int, points array<struct<lat:double,lon:double>>")
    got = {(r.chain.part, r.chain.pos): (r.closed, [(p.lat, p.lon) for p in r.points]) for r in polygons.assembled(df).collect()}
    assert got == {(1, 0): (True, [(0, 0), (0, 1), (1, 1)]), (2, 0): (False, [(5, 5), (6, 6)]), (3, 0): (False, [(8, 8), (9, 9), (8, 8)])}


def test_darts_of_finished_chains_are_not_moved_again(spark, monkeypatch):
    """Many short chains and a long one: rounds after the short ones' end hold the long one's darts alone."""
    sizes = []
    monkeypatch.setattr(polygons, "settle", lambda df, f=polygons.settle: (lambda now: sizes.append(now.count()) or now)(f(df)))
    lengths = [3] * 300 + [100]
    darts = [(1000 * c + k, 1000 * c + k + 1 if k + 1 < n else None) for c, n in enumerate(lengths) for k in range(n)]
    ended, circles = polygons.ranked_darts(spark.createDataFrame(darts + [(-1, -2), (-2, -1)], "dart long, next long"))
    want = {(1000 * c + k, 1000 * c + n - 1, n - 1 - k) for c, n in enumerate(lengths) for k in range(n)}
    assert {tuple(r) for r in ended.collect()} == want and {r.dart for r in circles.collect()} == {-1, -2}
    assert sizes[0] == len(darts) + 2 and sizes[-1] <= 102
