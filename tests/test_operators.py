import math
import random

import numpy as np
import pytest
from chronomesh.functions import geo
from chronomesh.operators import graph, grid, layout, polygons, spatial, transit
from pyspark.sql import functions as F


def random_edges(seed, n=60, m=200):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), rng.randint(0, 20)) for _ in range(m)]


def plain_paths(edges, source):
    dist = {source: 0}
    for _ in range(len(edges)):
        changed = False
        for s, d, w in edges:
            if s in dist and dist[s] + w < dist.get(d, math.inf):
                dist[d], changed = dist[s] + w, True
        if not changed:
            break
    return dist


@pytest.mark.parametrize("kernel", [True, False])
def test_shortest_paths(spark, kernel):
    edges = random_edges(1)
    df = spark.createDataFrame(edges + [(0, 1, None)], "src long, dst long, w long")
    labels = graph.sssp(df, spark.createDataFrame([(0,), (5,), (999,)], "source long"), kernel=kernel).persist()
    for s in (0, 5, 999):
        assert {r.node: r.dist for r in labels.where(F.col("source") == s).collect()} == plain_paths(edges, s)
    routes = graph.paths(labels, labels.select("source", F.col("node").alias("target")))
    got = {(r.source, r.target): r.path for r in routes.collect()}
    least = {}
    for a, b, w in edges:
        least[a, b] = min(w, least.get((a, b), math.inf))
    for r in labels.collect():
        p = got[r.source, r.node]
        assert p[0] == r.source and p[-1] == r.node and sum(least[x] for x in zip(p, p[1:], strict=False)) == r.dist
    near = graph.sssp(df, spark.createDataFrame([(0,)], "source long"), cutoff=10, kernel=kernel)
    assert {r.node: r.dist for r in near.collect()} == {k: d for k, d in plain_paths(edges, 0).items() if d <= 10}


@pytest.mark.parametrize("kernel", [True, False])
def test_strong_components(spark, kernel):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (7, 7)] + [(a, b) for a, b, _ in random_edges(2, 40, 60)]
    edges = [(a + 100, b + 100) if i > 7 else (a, b) for i, (a, b) in enumerate(edges)]
    reach = {}
    nodes = {x for e in edges for x in e}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            u = todo.pop()
            for a, b in edges:
                if a == u and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[n] = seen
    want = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
    parts = graph.strong_components(spark.createDataFrame(edges, "src long, dst long"), **({} if kernel else {"part_edges": 2}))
    assert dict(parts.collect()) == want
    if kernel:
        largest = graph.largest_component(parts).first()
        sizes = {c: list(want.values()).count(c) for c in want.values()}
        assert (largest["component"], largest["size"]) == min(sizes.items(), key=lambda x: (-x[1], x[0]))


def test_rounds_of_transit(spark):
    """Ride, walk, ride; a walk does not follow a walk."""
    trips = spark.createDataFrame([(1, 0, 0, 1, 100, 110), (1, 0, 1, 2, 200, 210), (2, 0, 0, 3, 300, 310), (2, 0, 1, 5, 400, 410)], "pattern long, trip long, pos long, stop long, arr long, dep long")
    foot = spark.createDataFrame([(2, 3, 30), (3, 4, 30), (1, 6, 40), (6, 7, 40)], "a long, b long, sec long")
    access = spark.createDataFrame([(0, 1, 90)], "source long, stop long, arr long")
    got = {r.stop: r.arr for r in transit.earliest_arrivals(trips, foot, access).collect()}
    assert got == {1: 90, 6: 130, 2: 200, 3: 230, 5: 400}


def test_scalars(spark):
    tags = [("30 mph", "primary"), ("30 km/h", "primary"), ("55;45", "primary"), ("none", "primary"), (None, "living_street"), ("0", "primary"), (None, "path")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(tags)], "i int, t string, h string")
    assert [r.m for r in df.orderBy("i").select(geo.maxspeed_mph(F.col("t"), F.col("h")).alias("m")).collect()] == [30, 30, 55, 40, 12, 0, 25]
    ways = [("yes", "primary", [1]), ("true", "primary", [1]), ("1", "primary", [1]), ("-1", "primary", [-1]), ("no", "primary", [1, -1]), (None, "motorway", [1]), ("-1", "motorway", [-1])]
    df = spark.createDataFrame([(i, o, h) for i, (o, h, _) in enumerate(ways)], "i int, o string, h string")
    assert [r.d for r in df.orderBy("i").select(geo.directions(F.col("o"), F.col("h")).alias("d")).collect()] == [w[2] for w in ways]
    x = spark.createDataFrame([(math.nan,), (math.inf,), (0.5,), (1.4,), (9.0,)], "x double")
    assert [r.c for r in x.select(geo.clamp_factor(F.col("x")).alias("c")).collect()] == [1, 1, 1, 1.4, 4]
    t = spark.createDataFrame([("25:30:00",), ("08:05",), ("7:00:30",), ("",)], "t string")
    assert [r.s for r in t.select(geo.gtfs_seconds(F.col("t")).alias("s")).collect()] == [91800, 29100, 25230, None]
    f = spark.createDataFrame([(0.61,), (0.97,), (1.0,), (1.03,), (1.53,)], "f double")
    assert [r.t for r in f.select(geo.drawn_text(F.col("f")).alias("t")).collect()] == ["39% closer", "close to true", "close to true", "close to true", "53% farther"]
    s = spark.createDataFrame([("",), ("0",), ("15",), ("300",)], "t string")
    assert [r.s for r in s.select(transit.declared_seconds(F.col("t")).alias("s")).collect()] == [120, 30, 30, 300]


def test_snap_equals_brute_force(spark):
    rng = random.Random(3)
    nodes = [(i, 47.5 + rng.random() * 0.2, -122.4 + rng.random() * 0.2) for i in range(200)]
    points = [(i, 47.4 + rng.random() * 0.5, -122.6 + rng.random() * 0.6) for i in range(100)]
    df = spark.createDataFrame(points, "id long, lat double, lng double")
    nd = spark.createDataFrame(nodes, "node long, r_lat double, r_lng double")
    got = {r.id: r.node for r in spatial.snap(df, nd, geo.haversine_m).collect()}

    def metres(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    assert got == {p[0]: min(nodes, key=lambda n: metres(p, n))[0] for p in points}


def test_places_share_a_search_and_no_pair_is_sorted(spark):
    rng = random.Random(5)
    nodes = [(i, 47.5 + i % 9 * 0.01, -122.4 + rng.random() * 0.1) for i in range(60)]
    nodes += [(100 + i, *nodes[i][1:]) for i in range(60)] + [(999, None, -122.4)]
    points = [(i, 47.5 + i % 7 * 0.012, -122.4 + i % 5 * 0.02) for i in range(140)] + [(999, None, -122.4)]
    df = spark.createDataFrame(points, "id long, lat double, lng double")
    nd = spark.createDataFrame(nodes, "node long, r_lat double, r_lng double")
    km = lambda p, n: math.hypot((p[1] - n[1]) * geo.KM_PER_DEG, (p[2] - n[2]) * geo.KM_PER_LNG)
    whole = lambda p: sorted((km(p, n), n[0]) for n in nodes[:-1])
    lists, spatial.LIST = spatial.LIST, 7
    try:
        places = spatial.nearest_places(df, nd, 5, geo.flat_km, **spatial.within_km(1.5))
        got = {r.id: [x.node for x in r.best] for r in df.join(places, ["lat", "lng"]).collect()}
        assert got == {p[0]: [n for d, n in whole(p) if d <= 1.5][:5] for p in points[:-1]}
        window = lambda p: [n for n in nodes[:-1] if all(abs(math.floor(n[i] / c) - math.floor(p[i] / c)) <= 1 for i, c in ((1, 0.0108), (2, 0.016)))]
        near = spatial.nearest_in_window(df, nd, 6, 0.0108, 0.016, 1)
        got = {r.id: [x.node for x in r.best] for r in df.join(near, ["lat", "lng"]).collect()}
        want = {p[0]: [n for _, n in sorted((km(p, n), n[0]) for n in window(p))][:6] for p in points[:-1]}
        assert got == {p: n for p, n in want.items() if n}
        # Nodes are sorted, and the best of a place; 140 points with all 120 nodes in sight are 28 rows, not 28 * 120.
        one = spatial._nearest_in_cells(df.select("lat", "lng").where("lat is not null").distinct(), nd.where("r_lat is not null"), 5, geo.flat_km, 1.0, 4)
        assert one.count() == len({p[1:] for p in points[:-1]}) and "Window" in one._jdf.queryExecution().executedPlan().toString().split("Join")[-1]
    finally:
        spatial.LIST = lists


def test_layout_recovers_a_map(spark):
    rng = np.random.default_rng(4)
    xy = rng.random((30, 2)) * 10
    d = np.hypot(*(xy[:, None] - xy).transpose(2, 0, 1))
    m = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(30) for j in range(30)], "i long, j long, d double")
    ref = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, x double, y double")
    seed = layout.classical_mds(m)
    assert layout.stress(m, seed)[0].first().stress < 1e-6
    rough = ref.select("id", (F.col("x") + F.sin("id")).alias("x"), (F.col("y") - F.cos("id")).alias("y"))
    last = math.inf
    for rounds in (0, 1, 5, 30):
        now = layout.stress(m, layout.smacof(m, rough, rounds))[0].first().stress
        assert now <= last + 1e-12
        last = now
    one = {r.id: (r.x, r.y) for r in layout.smacof(m, rough, 1).collect()}
    sql = {r.id: (r.x, r.y) for r in layout.smacof_step(m, rough).collect()}
    assert all(np.allclose(one[i], sql[i]) for i in one)
    turned = ref.select("id", (3 - 2 * F.col("y")).alias("x"), (5 - 2 * F.col("x")).alias("y"))
    back = {r.id: (r.x, r.y) for r in layout.procrustes(turned, ref).collect()}
    assert all(np.allclose(back[i], xy[i]) for i in range(30))


def test_tiles_of_any_size_agree(spark, monkeypatch):
    """Iterations over tiles equal steps by joins, whatever the tiles and partitions."""
    rng = np.random.default_rng(6)
    ids = sorted(rng.choice(1000, 23, replace=False).tolist())
    m = spark.createDataFrame([(i, j, float(abs(i - j) + (i * j) % 7)) for i in ids for j in ids], "i long, j long, d double").repartition(5)
    seed = spark.createDataFrame([(i, float(i % 3), float(i)) for i in ids], "id long, x double, y double")
    want = {r.id: (r.x, r.y) for r in layout.smacof_step(m, layout.smacof_step(m, seed)).collect()}
    v = rng.random((23, 2))
    d = np.array([[abs(i - j) + (i * j) % 7 for j in ids] for i in ids], float)
    for block, width in ((128, 2048), (3, 4), (1, 23), (23, 1)):
        monkeypatch.setattr(layout, "BLOCK", block)
        monkeypatch.setattr(layout, "WIDTH", width)
        got = {r.id: (r.x, r.y) for r in layout.smacof(m, seed, 2).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in ids)
        vectors = spark.createDataFrame([(i, *map(float, x)) for i, x in zip(ids, v, strict=True)], "id long, x double, y double")
        product = {r.id: (r.x, r.y) for r in layout.block_product(m, "d", vectors).collect()}
        assert np.allclose([product[i] for i in ids], d @ v)


def test_clipping_closing():
    box = (0.0, 1.0, 0.0, 1.0)
    square = [(-0.5, -0.5), (-0.5, 0.5), (0.5, 0.5), (0.5, -0.5)]
    assert sorted(polygons.clip(square, box)) == [(0.0, 0.0), (0.0, 0.5), (0.5, 0.0), (0.5, 0.5)]
    assert polygons.clip([(2.0, 2.0), (2.0, 3.0), (3.0, 3.0)], box) == []
    coast = [(0.0, 0.5), (0.5, 0.5), (1.0, 0.5)]  # northwards: water is on the right, the east
    ring = polygons.closed_by_border(coast, box, probe_km=5)
    assert polygons.holds(ring, (0.5, 0.9)) and not polygons.holds(ring, (0.5, 0.1))
    west = polygons.closed_by_border(coast[::-1], box, probe_km=5)
    assert polygons.holds(west, (0.5, 0.1)) and not polygons.holds(west, (0.5, 0.9))


def test_water(spark):
    box = (47.5, 47.7, -122.45, -122.25)
    lake = [{"lat": a, "lon": b} for a, b in ((47.6, -122.35), (47.65, -122.35), (47.65, -122.3), (47.6, -122.3), (47.6, -122.35))]
    half = [lake[:3], lake[2:]]
    members = [{"type": "way", "role": "outer", "geometry": h} for h in half] + [{"type": "way", "role": "inner", "geometry": lake}]
    pond = [{"lat": 47.55 + a, "lon": -122.3 + b} for a, b in ((0, 0), (0.0001, 0), (0.0001, 0.0001), (0, 0.0001), (0, 0))]
    coast = [{"lat": 47.7, "lon": -122.42}, {"lat": 47.6, "lon": -122.42}, {"lat": 47.5, "lon": -122.42}]
    rows = [(1, "way", {"natural": "water"}, lake, None), (2, "relation", {"natural": "water"}, None, members), (3, "way", {"waterway": "riverbank"}, pond, None), (4, "way", {"natural": "coastline"}, coast, None), (5, "way", {"highway": "primary"}, lake, None)]
    schema = "id long, type string, tags map<string,string>, geometry array<struct<lat double, lon double>>, members array<struct<type string, role string, geometry array<struct<lat double, lon double>>>>"
    got = polygons.build_water(spark.createDataFrame(rows, schema), box)
    areas = {r.ring: r.km2 for r in polygons.ring_areas(got).collect()}
    assert sorted(areas) == ["closed-1-0", "coast-4-0", "open-2-0"] and areas["closed-1-0"] == pytest.approx(areas["open-2-0"])
    points = spark.createDataFrame([(0, 47.62, -122.33), (1, 47.6, -122.44), (2, 47.6, -122.4)], "id int, lat double, lng double")
    assert {(r.id, r.ring) for r in polygons.in_rings(points, got).collect()} == {(0, "closed-1-0"), (0, "open-2-0"), (1, "coast-4-0")}
    assert "Elliott Bay" in {r.name for r in polygons.water_failures(got).collect()}


def test_grid(spark):
    points = grid.grid_points(spark).persist()
    rows = points.groupBy("row").count().count()
    assert (rows, points.count()) == (52, 1300)
    ends = points.orderBy("row", "col").collect()
    assert (ends[0].lat, ends[0].lng) == (47.5, -122.43) and round(ends[-1].lat, 4) == 47.7295
    none = spark.createDataFrame([], "ring string, k int, lat double, lng double")
    anchors = grid.land_anchors(points, none)
    ids = sorted(r.id for r in anchors.select("id").collect())
    assert ids == list(range(1300))
    canal = spark.createDataFrame([("c", k, lat, lng) for k, (lat, lng) in enumerate(((47.645, -122.5), (47.652, -122.5), (47.652, -122.2), (47.645, -122.2)))], "ring string, k int, lat double, lng double")
    land = grid.land_anchors(points, canal).persist()
    assert 0 < land.count() < 1300
    kinds = {r.kind: r["count"] for r in grid.mesh(land, canal).groupBy("kind").count().collect()}
    assert kinds[0] > 2000 and 0 < kinds[1] <= 14


def test_thinning(spark):
    p = [(47.6 + i * 0.0005, -122.3) for i in range(10)]
    df = spark.createDataFrame([(1, p)], "id int, p array<struct<lat double, lng double>>")
    kept = df.select(polygons.thinned(F.col("p"), 100.0).alias("t")).first().t
    assert [round((x.lat - 47.6) / 0.0005) for x in kept] == [0, 2, 4, 6, 8, 9]


def test_journeys(spark):
    trips = spark.createDataFrame([(1, 0, 0, 1, 100, 110), (1, 0, 1, 2, 200, 210), (2, 0, 0, 3, 300, 310), (2, 0, 1, 5, 400, 410)], "pattern long, trip long, pos long, stop long, arr long, dep long")
    foot = spark.createDataFrame([(2, 3, 30), (3, 4, 30)], "a long, b long, sec long")
    access = spark.createDataFrame([(0, 1, 90)], "source long, stop long, arr long")
    targets = spark.createDataFrame([(0, 5), (0, 1), (0, 77)], "source long, target long")
    got = {r.target: (r.arr, [(x.kind, x.start, x.stop, x.pattern) for x in r.legs]) for r in transit.journeys(trips, foot, access, targets).collect()}
    assert got == {1: (90, []), 5: (400, [("ride", 1, 2, 1), ("foot", 2, 3, None), ("ride", 3, 5, 2)])}
