import math
from collections import defaultdict

import pytest
from chronomesh.operators import grid, polygons, reports
from chronomesh.plans import feeds, layouts
from chronomesh.plans.registry import oracle_sql, queries

from .chains import walked_chains
from .oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    compare(spark, name, queries()[name], oracle_sql()[name], SF)


def test_all_others_are_held_against_brute_force():
    assert queries().keys() - oracle_sql().keys() == {"g15_classical_scaling", "g18_embedding", "g20_mesh", "g24_water", "g26_basemap"}


def rings_of(frame):
    out = defaultdict(list)
    for r in frame.orderBy("ring", "k").collect():
        out[r.ring].append((r.lat, r.lng))
    return out


def inside(ring, p):
    hit = False
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (a > p[0]) != (c > p[0]) and p[1] < (d - b) * (p[0] - a) / (c - a) + b:
            hit = not hit
    return hit


def test_g20_mesh(spark):
    """Every pair of points by loops: neighbours on land, and the two shortest crossings of each bridge."""
    ponds = rings_of(layouts.ponds(spark, SF))
    wet = lambda p: any(inside(r, p) for r in ponds.values())
    dry = [(r.lat, r.lng) for r in grid.grid_points(spark).orderBy("row", "col").collect() if not wet((r.lat, r.lng))]
    dry = [(math.floor(a * 1e6 + 0.5) / 1e6, math.floor(b * 1e6 + 0.5) / 1e6) for a, b in dry]
    per_lng = 111.32 * math.cos(math.radians(47.617))
    km = lambda p, q: math.hypot((p[0] - q[0]) * 111.32, (p[1] - q[1]) * per_lng)

    def away(b, p, q):
        ux, uy = (q[1] - p[1]) * per_lng, (q[0] - p[0]) * 111.32
        wx, wy = (b[1] - p[1]) * per_lng, (b[0] - p[0]) * 111.32
        t = max(0, min(1, (ux * wx + uy * wy) / (ux * ux + uy * uy)))
        return math.hypot(wx - t * ux, wy - t * uy)

    step, want, crossing = 0.0045 * 111.32, set(), defaultdict(list)
    for i, p in enumerate(dry):
        for j in range(i + 1, len(dry)):
            q = dry[j]
            if q[0] - p[0] > 0.03:
                break
            d = km(p, q)
            if d > 4.5 * step:
                continue
            over = any(wet((p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t)) for t in (0.2, 0.35, 0.5, 0.65, 0.8))
            if not over and d <= 1.6 * step:
                want.add((i, j, 0))
            if over:
                near = min((away(b[1:], p, q), n) for n, b in enumerate(grid.BRIDGES))
                if near[0] < 0.35:
                    crossing[near[1]].append((d, i, j))
    for own in crossing.values():
        want |= {(i, j, 1) for _, i, j in sorted(own)[:2]}
    got = {tuple(r) for r in queries()["g20_mesh"](spark, SF).select("i", "j", "kind").collect()}
    assert got == want and len({k for _, _, k in want}) == 2


def area_in_box(ring, box, rows=4000):
    """Area with winding inside a box, summed over thin slices: how often, and which way, the ring goes round."""
    south, north, west, east = box
    total = 0.0
    for n in range(rows):
        y = south + (north - south) * (n + 0.5) / rows
        cuts = []
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (a > y) != (c > y):
                cuts.append((b + (d - b) * (y - a) / (c - a), 1 if c > a else -1))
        total += sum(sign * (min(max(x, west), east) - west) for x, sign in cuts) * (north - south) / rows
    return abs(total) * 111.32 * math.cos(math.radians(47.61)) * 111.32


def test_g21_clip_rings(spark):
    rings = rings_of(layouts.rings(spark, SF))
    got = {r.ring: r for r in queries()["g21_clip_rings"](spark, SF).collect()}
    assert got.keys() == rings.keys() and len(rings) == 25
    for name, ring in rings.items():
        assert got[name].km2 == pytest.approx(area_in_box(ring, feeds.CLIP_BOX), rel=0.01, abs=0.05)


def test_g26_basemap(spark):
    """Every drawn street by walks from line to line, thinned node by node."""
    at = {r.id: (r.lat, r.lng) for r in feeds.known(spark, SF).collect()}
    lines = defaultdict(dict)
    for w in feeds.ways(spark, SF).collect():
        tier, nodes = reports.TIERS.get(w.highway), [n for n in w.nodes if n in at]
        if tier is not None and len(w.nodes) >= 2 and nodes:
            lines[tier][w.way] = nodes
    metres = lambda p, q: 2 * 6371000 * math.asin(math.sqrt(min(1, math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2)))
    want = {}
    for tier, own in lines.items():
        for chain, nodes in walked_chains(own).items():
            kept = []
            for k, n in enumerate(nodes):
                if not kept or k == len(nodes) - 1 or metres(kept[-1], at[n]) >= 90:
                    kept.append(at[n])
            if len(kept) >= 2:
                want[tier, chain] = [[math.floor(x * 1e4 + 0.5) / 1e4 for x in p] for p in kept]
    got = {(r.tier, r.chain): [[p.lat, p.lng] for p in r.points] for r in reports.basemap(feeds.ways(spark, SF), feeds.known(spark, SF)).collect()}
    assert got.keys() == want.keys() and all(len(got[k]) == len(want[k]) and sum(abs(a - b) for p, q in zip(got[k], want[k], strict=True) for a, b in zip(p, q, strict=True)) < 1e-6 for k in want)
    assert queries()["g26_basemap"](spark, SF).count() == len(want) > 10


def test_g15_classical_scaling(spark):
    """Against all eigenvectors of the double-centred matrix."""
    import numpy as np

    rows = layouts.full(spark, SF).collect()
    ids = sorted({r.i for r in rows})
    d = np.zeros((len(ids), len(ids)))
    for r in rows:
        d[ids.index(r.i), ids.index(r.j)] = r.d
    s = d**2
    b = -0.5 * (s - s.mean(axis=1, keepdims=True) - s.mean(axis=1)[None, :] + s.mean())
    b = (b + b.T) / 2
    values, vectors = np.linalg.eigh(b)
    top = np.argsort(-np.abs(values))[:2]
    want = vectors[:, top] * np.sqrt(np.abs(values[top]))
    got = {r.id: (r.x, r.y) for r in queries()["g15_classical_scaling"](spark, SF).collect()}
    found = np.array([got[i] for i in ids])
    assert np.allclose(np.abs(found), np.abs(want), rtol=0.05, atol=0.05 * np.abs(want).max())


def test_g24_water(spark):
    """Joined halves are the ponds again, and the sea is the strip west of the coast."""
    got = rings_of(queries()["g24_water"](spark, SF))
    areas = {k: polygons.area_km2(r) for k, r in got.items()}
    big = [r for r in rings_of(layouts.ponds(spark, SF)).values() if len(r) >= 4 and polygons.area_km2(polygons.clip(r, feeds.CITY)) >= 0.2]
    assert sum(k.startswith("closed") for k in got) == sum(k.startswith("open") for k in got) == len(big)
    assert areas["coast-999-0"] == pytest.approx(0.005 * 0.234 * 111.32**2 * math.cos(math.radians(47.61)), rel=0.01)
