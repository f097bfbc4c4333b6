"""Strong components by parts, against reach by loops."""

import random

import pytest
from chronomesh.operators import graph


def plain(edges):
    out = {}
    for s, d in edges:
        out.setdefault(s, set()).add(d)
        out.setdefault(d, set())

    def reach(n):
        seen, todo = {n}, [n]
        while todo:
            for v in out[todo.pop()] - seen:
                seen.add(v)
                todo.append(v)
        return seen

    ways = {n: reach(n) for n in out}
    return {n: min(m for m in ways[n] if n in ways[m]) for n in out}


def made(kind, rng):
    if kind == "chain":  # long ways with few circles: rounds of labels would need a round a node
        return [(i, i + 1) for i in range(400)] + [(70, 10), (75, 60), (200, 150), (400, 380), (5, 5), (999, 999)]
    if kind == "hub":  # one node has most edges, both ways
        return [(0, i) for i in range(1, 300)] + [(i, 0) for i in range(1, 300, 3)] + [(i, i + 1) for i in range(1, 299, 2)]
    if kind == "ring":
        return [(i, (i + 1) % 300) for i in range(300)]
    n = {"sparse": 200, "dense": 60}[kind]
    return [(rng.randrange(n), rng.randrange(n)) for _ in range({"sparse": 220, "dense": 300}[kind])]


@pytest.mark.parametrize("kind", ["chain", "hub", "ring", "sparse", "dense"])
@pytest.mark.parametrize("part_edges", [24])
def test_parts_equal_reach(spark, kind, part_edges):
    edges = made(kind, random.Random(7))
    got = graph.strong_components(spark.createDataFrame(edges * 2, "src int, dst int").repartition(3), part_edges=part_edges).collect()
    assert len(got) == len({n for e in edges for n in e}) and dict(map(tuple, got)) == plain(edges)


def test_colours_where_nothing_shrinks(spark, monkeypatch):
    monkeypatch.setattr(graph, "SHRUNK", 0)
    edges = made("dense", random.Random(1))
    assert dict(map(tuple, graph.strong_components(spark.createDataFrame(edges, "src long, dst long"), part_edges=50).collect())) == plain(edges)


def test_summary_says_the_same_ways():
    """Of shared nodes each reaches the same ones in a part and in what it says of itself, in no more edges."""
    rng = random.Random(3)
    for _ in range(200):
        edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(rng.randrange(1, 60))]
        shared = {n for e in edges for n in e if n % 5 == 0}
        said = list(graph._summary(edges, [(n, n) for n in shared], []))

        def reached(rows, shared=shared):
            out = {}
            for s, d in rows:
                out.setdefault(s, set()).add(d)
            found = set()
            for n in shared:
                seen, todo = {n}, [n]
                while todo:
                    for v in out.get(todo.pop(), set()) - seen:
                        seen.add(v)
                        todo.append(v)
                found |= {(n, m) for m in seen & shared}
            return found

        assert reached(said) == reached(edges)
        assert len({e for e in said if e[0] != e[1]}) <= len(set(edges)) + 2 * len(shared)


def test_no_edges(spark):
    assert graph.strong_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_registered_query_deals_its_edges(spark, monkeypatch):
    from chronomesh.plans.registry import queries

    plans = []
    monkeypatch.setattr(graph, "_in_parts", lambda rows, *a, f=graph._in_parts: plans.append(rows) or f(rows, *a))
    monkeypatch.setattr(graph, "PART_EDGES", 64)
    found = graph.strong_components(__import__("chronomesh.plans.bindings", fromlist=["blocks"]).blocks(spark, "/root/testdata/sf0.001"), part_edges=64)
    assert len(plans) >= 3 and plans[0].select("part").distinct().count() > 1
    assert found.exceptAll(queries()["g3_strong_components"](spark, "/root/testdata/sf0.001")).count() == 0
