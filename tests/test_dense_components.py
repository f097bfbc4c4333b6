"""Strong components of graphs with many edges a node."""

import random

from chronomesh.operators import graph


def test_few_edges_of_each_node_come_first(spark, monkeypatch):
    """Two crowds, a way from one to the other, a crowd in one direction only, and a loop."""
    rng = random.Random(4)
    crowd = lambda a, b, n: {(rng.randrange(a, b), rng.randrange(a, b)) for _ in range(n)}
    edges = crowd(100, 140, 900) | crowd(200, 240, 900) | {(120, 220)} | {(a, b) for a in range(300, 330) for b in range(a + 1, 330)} | {(7, 7)}
    taken, parts = [], graph._components_by_parts
    monkeypatch.setattr(graph, "_components_by_parts", lambda e, n: taken.append(e.where("src <> dst").count()) or parts(e, n))
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    got = {r.node: r.component for r in graph.strong_components(df, 200).collect()}
    want = {n: own for n, own in graph._circles(sorted(edges)).items()}
    assert got == want and {want[100], want[200]} == {100, 200} and want[329] == 329 and want[7] == 7
    assert max(taken) < len(edges) / 2
