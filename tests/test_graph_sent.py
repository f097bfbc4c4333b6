"""Graphs come to the tasks that search them by a shuffle, and many searches go side by side."""

import random

import numpy as np
import pytest
from chronomesh.operators import graph
from pyspark.sql import DataFrame


def columns(edges):
    return {c: np.array([e[k] for e in edges]) for k, c in enumerate(("src", "dst", "w"))}


def town(n, seed, longest):
    rng = random.Random(seed)
    return sorted({(a, b): (a, b, rng.randint(1, longest)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(3 * n)) if a != b}.values())


def edges_of(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long, w long")


def test_no_graph_passes_through_the_driver(spark, monkeypatch):
    whole = DataFrame.toArrow

    def guarded(df):
        assert "w" not in df.columns, "edges are brought to the driver"
        return whole(df)

    monkeypatch.setattr(DataFrame, "toArrow", guarded)
    df = edges_of(spark, [(1, 2, 4), (2, 3, 1), (3, 1, 1)])
    asked = spark.createDataFrame([(1, 3), (3, 2)], "source long, target long")
    assert {(r.source, r.target, r.dist) for r in graph.routes(df, asked).collect()} == {(1, 3, 5), (3, 2, 5)}
    assert graph.sssp(df, asked, previous=False).count() == 6
    assert graph.drive_matrix(df, spark.createDataFrame([(10, 1), (11, 3)], "id long, node long")).count() == 4


def test_distances_alone_and_ways_go_by_kernel_on_larger_graphs(spark, monkeypatch):
    monkeypatch.setattr(graph, "KERNEL_EDGES", 1)
    rounds = []
    monkeypatch.setattr(graph, "_sssp_rounds", lambda *a, **k: rounds.append(1))
    assert graph.sssp(edges_of(spark, [(1, 2, 4), (2, 3, 1)]), spark.createDataFrame([(1,)], "source long"), previous=False).count() == 3
    assert not rounds and graph.ROUTE_EDGES >= graph.MATRIX_EDGES >= 16_000_000


@pytest.mark.parametrize("longest", [9, 9_000, 40_000, 2_000_000_000])
def test_searches_side_by_side_equal_single_ones(longest):
    """Ways that are longer than two, four bytes hold are found with more."""
    arrays = graph.Arrays(columns(town(300, 5, longest) + [(1000, 1001, longest)]))
    lanes, goals = graph.Lanes(arrays), np.arange(0, len(arrays.nodes), 7)
    starts = np.arange(0, len(arrays.nodes), 11)
    got = lanes.distances(starts, goals)
    for start, row in zip(starts, got, strict=True):
        dist = arrays.distances(start)[goals]
        assert np.array_equal(row, np.where(dist < arrays.none, dist, -1))
    assert (got < 0).any() and (got > 0).any()


def test_searches_with_little_in_common_go_alone(spark, monkeypatch):
    """Along a street of 4,000 corners the nodes around one source are far from those around another."""
    street = [(k, k + 1, 1) for k in range(4_000)] + [(k + 1, k, 2) for k in range(4_000)]
    assert graph.Lanes(graph.Arrays(columns(street))).distances(np.arange(0, 4_000, 40), np.array([7])) is None
    monkeypatch.setattr(graph, "SMALL_EDGES", 0)
    snapped = spark.createDataFrame([(k, 40 * k) for k in range(100)] + [(200, 5_000), (201, 80)], "id long, node long")
    got = {(r.i, r.j): r.seconds for r in graph.drive_matrix(edges_of(spark, street), snapped).collect()}
    want = {(a, b): 40 * (b - a) if b > a else 80 * (a - b) for a in range(100) for b in range(100)}
    own = {k: (2 if k == 201 else k) for k in (*range(100), 201)}
    assert got == {(a, b): want[own[a], own[b]] for a in own for b in own} | {(200, 200): 0}


@pytest.mark.parametrize("kind", ["whole", "double"])
def test_a_dense_graph_is_thinned_and_its_matrix_stays(spark, monkeypatch, kind):
    rng = random.Random(8)
    places = [(rng.random(), rng.random()) for _ in range(60)]
    metres = lambda a, b: ((places[a][0] - places[b][0]) ** 2 + (places[a][1] - places[b][1]) ** 2) ** 0.5 * rng.choice((1, 2, 3))
    edges = [(a, b, metres(a, b)) for a in range(60) for b in range(60) if a != b and rng.random() < 0.8]
    if kind == "whole":
        edges = [(a, b, 1 + int(w * 30)) for a, b, w in edges]
    df = spark.createDataFrame(edges + [(70, 71, edges[0][2])], f"src long, dst long, w {'long' if kind == 'whole' else 'double'}")
    snapped = spark.createDataFrame([(n, n) for n in (*range(60), 70, 71)], "id long, node long")
    rows = lambda **how: {(r.i, r.j): r.seconds for r in graph.drive_matrix(df.withColumn("w", df.w * 1000), snapped, **how).collect()}
    want = rows(kernel=False)
    monkeypatch.setattr(graph, "THIN_EDGES", 0)
    monkeypatch.setattr(graph, "DENSE", 8)
    left, thin = [], graph.thinned
    monkeypatch.setattr(graph, "thinned", lambda e: left.append(thin(e)) or left[0])
    assert rows() == want and left[0].count() < len(edges) / 2
