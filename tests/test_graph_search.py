"""Searches that stop at their targets, against a heap that doesn't."""

import heapq
import random

import numpy as np
import pyarrow as pa
import pytest
from chronomesh.operators import graph


class Table:
    def __init__(self, rows):
        self.rows = rows

    def toArrow(self):
        return pa.table({n: [r[i] for r in self.rows] for i, n in enumerate(("src", "dst", "w"))})


def heap(edges, source):
    """Distance and smallest previous node of each node that is reached."""
    out = {}
    for s, d, w in edges:
        out.setdefault(s, []).append((d, w))
    dist, todo = {source: 0}, [(0, source)]
    while todo:
        x, u = heapq.heappop(todo)
        if x == dist[u]:
            for v, w in out.get(u, ()):
                if x + w < dist.get(v, float("inf")):
                    dist[v] = x + w
                    heapq.heappush(todo, (x + w, v))
    prev = {}
    for s, d, w in edges:
        if d != source and s in dist and d in dist and dist[s] + w == dist[d]:
            prev[d] = min(s, prev.get(d, s))
    return dist, prev


def walked(prev, source, target):
    path = [target]
    while path[-1] != source:
        path.append(prev[path[-1]])
    return path[::-1]


def street_grid(n, rng, kind):
    """A town of n x n corners with one-way streets and many ways of one length."""
    edges = {}
    for y in range(n):
        for x in range(n):
            for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                if 0 <= y + dy < n and 0 <= x + dx < n and rng.random() < 0.9:
                    w = rng.randint(1, 3) if kind == "whole" else rng.randint(1, 3) * 0.1
                    edges[y * n + x, (y + dy) * n + x + dx] = w
    return [(s, d, w) for (s, d), w in sorted(edges.items())]


@pytest.mark.parametrize("kind", ["whole", "double"])
def test_ways_and_ties_equal_the_heap(kind):
    rng = random.Random(1)
    edges = street_grid(15, rng, kind) + [(1000, 1001, 1 if kind == "whole" else 0.5), (1000, 3, 2 if kind == "whole" else 0.5)]
    arrays = graph.Arrays(Table(edges)).with_landmarks()
    drawn = every = 0
    for _ in range(150):
        source, target = (int(x) for x in rng.choices(arrays.nodes, k=2))
        dist, prev = heap(edges, source)
        at, end = arrays.place(np.array([source, target])).tolist()
        got, count = arrays.toward(at, end)
        goal = arrays.distances(at, goals=np.array([end]))
        drawn += count
        every += len(dist)
        if target not in dist:
            assert got[end] == arrays.none and goal[end] == arrays.none
            continue
        assert got[end] == goal[end] == dist[target]
        want = walked(prev, source, target)
        assert all(arrays.nodes[arrays.way(at, end, d)].tolist() == want for d in (got, goal))
    assert drawn < 0.6 * every


def test_search_is_drawn_to_its_target():
    """In a town of 3,600 corners a way across a few streets relaxes a small part of them."""
    rng = random.Random(2)
    arrays = graph.Arrays(Table(street_grid(60, rng, "whole"))).with_landmarks()
    counts = [arrays.toward(*arrays.place(np.array([30 * 60 + 20, 30 * 60 + 20 + far])).tolist())[1] for far in (3, 6, 10)]
    assert max(counts) < 3600 / 8


def test_edges_without_weight():
    edges = [(0, 1, 0), (1, 2, 0), (0, 2, 0), (2, 3, 1), (1, 3, 1), (3, 4, 0), (4, 5, 0), (3, 5, 0)]
    arrays = graph.Arrays(Table(edges)).with_landmarks()
    full = arrays.distances(0)
    prev = arrays.previous(0, full, full < arrays.none)
    for end in range(1, 6):
        path = [end]
        while path[-1] != 0:
            path.append(int(prev[path[-1]]))
        assert arrays.way(0, end, arrays.toward(0, end)[0]) == path[::-1]


@pytest.mark.parametrize("kernel", [True, False])
def test_routes_for_few_and_many_targets(spark, kernel):
    rng = random.Random(3)
    edges = street_grid(6, rng, "whole")
    nodes = sorted({n for s, d, _ in edges for n in (s, d)})
    asked = [(0, t) for t in nodes] + [(n, rng.choice(nodes)) for n in nodes[1:]] + [(7777, 7777), (7777, 1), (2, 8888)]
    df = spark.createDataFrame(edges, "src long, dst long, w long")
    got = {(r.source, r.target): (r.dist, r.path) for r in graph.routes(df, spark.createDataFrame(asked, "source long, target long"), kernel=kernel).collect()}
    want = {(7777, 7777): (0, [7777])}
    for s, t in asked:
        dist, prev = heap(edges, s)
        if t in dist and s != 7777:
            want[s, t] = dist[t], walked(prev, s, t)
    if not kernel:  # a node without edges is reached by itself in both
        assert got.pop((7777, 7777), (0, [7777])) == want.pop((7777, 7777))
    assert got == want


def test_searches_from_both_ends_see_little_of_a_random_graph_and_clear_what_they_touched(spark):
    n = 20_000
    edges = [(i, (i * a + b) % n, 1 + (i * 7919 + b) % 50) for i in range(n) for a, b in ((1, 1), (7, 5), (13, 11))]
    df = spark.createDataFrame(edges, "src long, dst long, w long")
    arrays = graph.Arrays(graph.least_edges(df)).with_landmarks()
    for k in range(30):
        at, end = k * 661 % n, (k * 7907 + 13) % n
        got, count = arrays.toward(at, end)
        whole = arrays.distances(at)
        assert got[end] == whole[end] and arrays.way(at, end, got) == arrays.way(at, end, whole)
        assert count < n / 20  # landmarks alone prune next to nothing here
