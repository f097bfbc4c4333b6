"""Rings and polylines: containment, area, clipping, stitching, closing, thinning.

Containment, area and densifying are joins and folds over vertex rows. Chains are made by pairing the ends of
lines that meet and ranking lines by pointers that double, so that no task holds a layer. Clipping and closing work on one ring
or chain at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEG, KM_PER_LNG
from .shared import settle

Point = tuple[float, float]  # latitude, longitude
Box = tuple[float, float, float, float]  # south, north, west, east


def ring_edges(vertices: DataFrame) -> DataFrame:
    """(ring, k, lat1, lng1, lat2, lng2) of vertices (ring, k, lat, lng); the last joins the first."""
    w = Window.partitionBy("ring").orderBy("k")
    first = Window.partitionBy("ring").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(first))
    return vertices.select("ring", "k", F.col("lat").alias("lat1"), F.col("lng").alias("lng1"), nxt("lat").alias("lat2"), nxt("lng").alias("lng2"))


def in_rings(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, ring) for every ring that holds a point: an odd number of its edges cross the point's ray.

    Different places meet the edges of one ring in one band of latitudes, CELL degrees high. Of each latitude in it the edges that
    cross are found once and sorted by where they cross, so that a place looks up how many lie east of it.
    """
    edges = ring_edges(vertices).where("lat1 <> lat2")
    low, high = F.floor(F.least("lat1", "lat2") / CELL), F.floor(F.greatest("lat1", "lat2") / CELL)
    banded = edges.select("ring", "lat1", "lng1", "lat2", "lng2", F.explode(F.sequence(low, high)).alias("band"))
    places = points.select("lat", "lng").distinct().withColumn("band", F.floor(F.col("lat") / CELL))
    met = places.join(banded.select("band", "ring").distinct(), "band").select("lat", "lng", F.col("band").alias("own_band"), F.col("ring").alias("own_ring"))
    schema = f"lat double, lng double, ring {vertices.schema['ring'].dataType.simpleString()}"
    held = met.groupBy("own_band", "own_ring").cogroup(banded.groupBy("band", "ring")).applyInArrow(_odd_places, schema)
    return points.join(held, ["lat", "lng"]).select("id", "ring")


def _odd_places(places: pa.Table, edges: pa.Table) -> pa.Table:
    """The places east of which an odd number of a ring's edges cross their latitude; half-open in latitude, as geo.crosses_ray."""
    lat, lng = (places.column(c).to_numpy() for c in ("lat", "lng"))
    lat1, lng1, lat2, lng2 = (edges.column(c).to_numpy() for c in ("lat1", "lng1", "lat2", "lng2"))
    order = np.argsort(lat, kind="stable")
    odd = np.zeros(len(lat), bool)
    for own in np.split(order, np.flatnonzero(np.diff(lat[order])) + 1) if len(lat) else ():
        y = lat[own[0]]
        cross = (lat1 > y) != (lat2 > y)
        at = np.sort((lng2[cross] - lng1[cross]) * (y - lat1[cross]) / (lat2[cross] - lat1[cross]) + lng1[cross])
        odd[own] = (len(at) - np.searchsorted(at, lng[own], side="right")) % 2 == 1
    return places.select(["lat", "lng", "own_ring"]).rename_columns(["lat", "lng", "ring"]).filter(pa.array(odd))


CELL = 0.01


def ring_areas(vertices: DataFrame) -> DataFrame:
    """(ring, vertices, km2)."""
    term = F.col("lng2") * F.col("lat1") - F.col("lng1") * F.col("lat2")
    return ring_edges(vertices).groupBy("ring").agg(F.count("*").alias("vertices"), F.abs(F.sum(term) / 2 * KM_PER_LNG * KM_PER_DEG).alias("km2"))


def densified(vertices: DataFrame, metres: float = 300.0) -> DataFrame:
    """(ring, k, cut, lat, lng): each edge cut into equal parts, one more than its length holds `metres`."""
    e = ring_edges(vertices)
    dy, dx = (F.col("lat2") - F.col("lat1")) * KM_PER_DEG, (F.col("lng2") - F.col("lng1")) * KM_PER_LNG
    cuts = F.floor(F.sqrt(dy * dy + dx * dx) * 1000 / metres).cast("int")
    many = e.withColumn("cuts", cuts).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts"))))
    t = F.col("cut") / (F.col("cuts") + 1)
    return many.select("ring", "k", "cut", (F.col("lat1") + (F.col("lat2") - F.col("lat1")) * t).alias("lat"), (F.col("lng1") + (F.col("lng2") - F.col("lng1")) * t).alias("lng"))


def thinned_by(points: F.Column, far) -> F.Column:
    """Of an array of struct(lat, lng): the first, the last, and each that is far(last one kept, it)."""
    start = F.slice(points, 1, 1)

    def step(kept, p):
        return F.when(far(F.element_at(kept, -1), p), F.concat(kept, F.array(p))).otherwise(kept)

    inner = F.aggregate(F.slice(points, F.lit(2), F.greatest(F.size(points) - 2, F.lit(0))), start, step)
    return F.when(F.size(points) > 1, F.concat(inner, F.slice(points, F.size(points), F.lit(1)))).otherwise(points)


def thinned(points: F.Column, metres: float) -> F.Column:
    """Of an array of struct(lat, lng): the first, the last, and each at least `metres` from the last one kept."""
    km = lambda a, b: F.sqrt(F.pow((a["lat"] - b["lat"]) * KM_PER_DEG, 2) + F.pow((a["lng"] - b["lng"]) * KM_PER_LNG, 2))
    return thinned_by(points, lambda a, b: km(a, b) * 1000 >= metres)


def without_repeats(points: F.Column) -> F.Column:
    """The array without elements that equal the one before."""
    return F.filter(points, lambda p, i: (i == 0) | (p != F.get(points, i - 1)))


def clip(ring: list[Point], box: Box) -> list[Point]:
    """A ring cut by the four sides of a box, north, south, east, west in turn."""
    south, north, west, east = box
    for axis, bound, sign in ((0, north, -1), (0, south, 1), (1, east, -1), (1, west, 1)):
        depth = [sign * (p[axis] - bound) for p in ring]
        out: list[Point] = []
        for i, here in enumerate(ring):
            j = (i + 1) % len(ring)
            if depth[i] >= 0:
                out.append(here)
            if (depth[i] >= 0) != (depth[j] >= 0):
                share = depth[i] / (depth[i] - depth[j])
                met = [here[x] + share * (ring[j][x] - here[x]) for x in (0, 1)]
                met[axis] = bound
                out.append((met[0], met[1]))
        ring = out
        if not ring:
            break
    return ring


def links_of(lines: DataFrame, turn: bool = True) -> DataFrame:
    """(dart, next): lines (seg, tier, line, head, tail) joined where their ends meet; next is null where nothing follows.

    A dart is a line in one direction, 2 * seg as it is and 2 * seg + 1 turned. The ends at one place are paired in order of
    their lines, the first with the second, the third with the fourth. Without turn a line's end goes with another's beginning,
    the first in order with the first.
    """
    side = lambda n, c: F.struct(F.lit(n).alias("side"), F.col(c).alias("place"))
    ends = lines.select("seg", "tier", "line", F.inline(F.array(side(0, "head"), side(1, "tail"))))
    here = ["tier", "place"] if turn else ["tier", "place", "side"]
    ranked = ends.withColumn("rank", F.row_number().over(Window.partitionBy(*here).orderBy("line", "side")) - 1)
    if turn:
        pairs = ranked.withColumn("pair", F.floor(F.col("rank") / 2)).groupBy("tier", "place", "pair").agg(F.min(F.struct("rank", "seg", "side")).alias("a"), F.max(F.struct("rank", "seg", "side")).alias("b"))
        two = F.col("a.rank") < F.col("b.rank")
        met = pairs.select("a.seg", "a.side", F.when(two, F.col("b.seg")).alias("other"), F.when(two, F.col("b.side")).alias("other_side"))
    else:
        begin = ranked.where("side = 0").select("tier", "place", "rank", F.col("seg").alias("other"), F.col("side").alias("other_side"))
        met = ranked.where("side = 1").join(begin, ["tier", "place", "rank"], "full_outer").select("seg", "side", "other", "other_side")
    # Who leaves by its tail goes forward, who enters by its head too.
    link = lambda a, a_side, b, b_side: F.struct((2 * F.col(a) + 1 - F.col(a_side)).alias("dart"), (2 * F.col(b) + F.col(b_side)).alias("next"))
    return met.select(F.inline(F.array(link("seg", "side", "other", "other_side"), link("other", "other_side", "seg", "side")))).where("dart is not null")


def ranked_darts(darts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dart, end, steps) for rows (dart, next): the last dart that follows, and how many follow; and the darts (dart) that go in circles.

    Each round doubles how far a pointer goes. A dart that has its end stays only while others point to it, and a round in which none
    gets its end leaves circles alone.
    """
    # 0 has no end yet, 1 got it in this round, 2 had it and is pointed to, 3 is not and stays out of the rounds that follow.
    now = settle(darts.select("dart", F.coalesce("next", "dart").alias("to"), F.col("next").isNotNull().cast("long").alias("steps"), F.col("next").isNull().cast("int").alias("state")))
    out = []
    while True:
        here = now.where("state <> 3")
        kinds = {r["state"]: r["count"] for r in now.groupBy("state").count().collect()}
        if not kinds.get(0) or not kinds.get(1):
            break
        x = here.where("state = 0").select("dart", "to", "steps")
        y = here.select(F.col("dart").alias("at"), F.col("to").alias("far"), F.col("steps").alias("more"), (F.col("state") > 0).alias("ended"))
        row = lambda dart, to, steps, state: F.struct(F.col(dart).alias("dart"), F.col(to).alias("to"), steps.alias("steps"), state.cast("int").alias("state"))
        led = F.col("dart").isNotNull()
        moved = F.when(led, row("dart", "far", F.col("steps") + F.col("more"), F.col("ended")))
        stays = F.when(F.col("ended"), row("at", "far", F.col("more"), F.when(led, 2).otherwise(3)))
        out.append(now.where("state = 3"))
        now = settle(x.join(y, F.col("to") == F.col("at"), "full_outer").select(F.inline(F.filter(F.array(moved, stays), F.isnotnull))))
    ended = now.where("state > 0")
    for part in out:
        ended = ended.unionByName(part)
    return ended.select("dart", F.col("to").alias("end"), "steps"), now.where("state = 0").select("dart")


def circle_starts(darts: DataFrame) -> DataFrame:
    """(dart, least) for rows (dart, next) that all go in circles: the least dart of each one's circle."""
    now = settle(darts.select("dart", "next", F.col("dart").alias("least")))
    while True:
        ahead = now.select(F.col("dart").alias("next"), F.col("next").alias("far"), F.col("least").alias("other"))
        after = settle(now.join(ahead, "next").select("dart", F.col("far").alias("next"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("moved")))
        if not after.where("moved").limit(1).count():
            return after.select("dart", "least")
        now = after.drop("moved")


def chains(lines: DataFrame, turn: bool = True) -> DataFrame:
    """(tier, chain, nodes, closed) of lines (tier, line, nodes, head, tail): lines of a tier joined where their ends, head and tail, are equal.

    A chain is named by its first line in order, which goes the way it is drawn; a closed one begins with it. Lines without
    nodes are left out. Joints hold a node once.
    """
    # Segments are numbered in order of their lines, so that the least dart of a chain is of its first line.
    dealt = lines.where(F.size("nodes") > 0).select("tier", "line", "nodes", "head", "tail").repartitionByRange("line").sortWithinPartitions("line")
    own = settle(dealt.withColumn("seg", F.monotonically_increasing_id()))
    darts = settle(links_of(own.select("seg", "tier", "line", "head", "tail"), turn))
    ranked, round_ = ranked_darts(darts)
    ranked, circles = settle(ranked), settle(darts.join(round_, "dart", "left_semi"))
    if not circles.isEmpty():
        # A circle is cut before its first line, in the direction in which that line is not turned.
        starts = circle_starts(circles).where("least % 2 = 0")
        cut = circles.join(starts, "dart").select("dart", F.when(F.col("next") != F.col("least"), F.col("next")).alias("next"))
        ranked = ranked.unionByName(ranked_darts(cut)[0])
    # Of a chain's two directions the one in which its first line is not turned.
    drawn_way = ranked.groupBy("end").agg(F.min("dart").alias("first")).where("first % 2 = 0")
    placed = ranked.join(drawn_way, "end").select("first", "steps", F.floor(F.col("dart") / 2).alias("seg"), (F.col("dart") % 2 == 1).alias("turned"))
    drawn = placed.join(own, "seg").select(
        "tier", "first", "line", "seg", (-F.col("steps")).alias("at"), F.when(F.col("turned"), F.reverse("nodes")).otherwise(F.col("nodes")).alias("nodes"),
        F.when(F.col("turned"), F.col("tail")).otherwise(F.col("head")).alias("head"), F.when(F.col("turned"), F.col("head")).otherwise(F.col("tail")).alias("tail"),
    )
    whole = drawn.groupBy("tier", "first").agg(F.min_by("line", "seg").alias("chain"), F.array_sort(F.collect_list(F.struct("at", "nodes"))).alias("parts"), F.min_by("head", "at").alias("head"), F.max_by("tail", "at").alias("tail"))
    rest = F.flatten(F.transform("parts", lambda p, i: F.when(i == 0, p["nodes"]).otherwise(F.slice(p["nodes"], F.lit(2), F.size(p["nodes"])))))
    return whole.select("tier", "chain", rest.alias("nodes"), (F.col("head") == F.col("tail")).alias("closed"))


def stitched_lines(lines: DataFrame) -> DataFrame:
    """(tier, chain, nodes) of lines (tier, line, nodes): chains of one tier, joined at shared end nodes."""
    ended = lines.withColumns({"head": F.element_at("nodes", 1), "tail": F.element_at("nodes", -1)}).where(F.size("nodes") > 0)
    return chains(ended).select("tier", "chain", "nodes")


def six_digits(point: F.Column) -> F.Column:
    return F.concat_ws(",", *(F.format_string("%.6f", point[c]) for c in ("lat", "lon")))


def assembled(segments: DataFrame, turn: bool = True) -> DataFrame:
    """(layer, chain, closed, points) of segments (layer, part, pos, points): chains of points; those that close on themselves with over
    three points are rings, and hold their first point once."""
    named = segments.where(F.size("points") > 0).select(F.col("layer").alias("tier"), F.struct("part", "pos").alias("line"), F.col("points").alias("nodes"))
    ended = named.withColumns({"head": six_digits(F.element_at("nodes", 1)), "tail": six_digits(F.element_at("nodes", -1))})
    ring = F.col("closed") & (F.size("nodes") > 3)
    return chains(ended, turn).select(F.col("tier").alias("layer"), "chain", ring.alias("closed"), F.when(ring, F.slice("nodes", F.lit(1), F.size("nodes") - 1)).otherwise(F.col("nodes")).alias("points"))


def holds(ring: list[Point], p: Point) -> bool:
    inside = False
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > p[0]) != (y2 > p[0]) and p[1] < (x2 - x1) * (p[0] - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def along(box: Box, p: Point) -> float:
    """Place of a point's nearest spot on the box's border: 0 to 4, clockwise from the north-west corner."""
    south, north, west, east = box
    lat, lng = min(north, max(south, p[0])), min(east, max(west, p[1]))
    spots = [(north - lat, (lng - west) / (east - west)), (east - lng, 1 + (north - lat) / (north - south)), (lat - south, 2 + (east - lng) / (east - west)), (lng - west, 3 + (lat - south) / (north - south))]
    return min(enumerate(spots), key=lambda s: (s[1][0], s[0]))[1][1]


def closed_by_border(chain: list[Point], box: Box, probe_km: float = 0.3) -> list[Point] | None:
    """A coast, water on its right, closed along the box's border on the side that makes it water; None if neither does."""
    south, north, west, east = box
    corner = [(north, west), (north, east), (south, east), (south, west)]
    middle = len(chain) // 2
    a, b = chain[max(0, middle - 1)], chain[min(len(chain) - 1, middle + 1)]
    east_km, north_km = (b[1] - a[1]) * KM_PER_LNG, (b[0] - a[0]) * KM_PER_DEG
    size = (east_km**2 + north_km**2) ** 0.5 or 1.0
    step = (-east_km / size * probe_km / KM_PER_DEG, north_km / size * probe_km / KM_PER_LNG)
    right, left = ((chain[middle][0] + s * step[0], chain[middle][1] + s * step[1]) for s in (1, -1))
    start, end = along(box, chain[0]), along(box, chain[-1])
    for clockwise in (True, False):
        span = (start - end) % 4 if clockwise else (end - start) % 4
        met = sorted((gap, i) for i in range(4) if 1e-9 < (gap := ((i - end) % 4 if clockwise else (end - i) % 4)) < span)
        ring = [*chain, *(corner[i] for _, i in met)]
        if holds(ring, right) and not holds(ring, left):
            return ring
    return None


def area_km2(ring: list[Point]) -> float:
    return abs(sum(x2 * y1 - x1 * y2 for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1], strict=True)) / 2) * KM_PER_LNG * KM_PER_DEG


def water_segments(elements: DataFrame) -> DataFrame:
    """(layer, part, pos, points) of nested elements (id, type, tags, geometry, members).

    Layers: closed water rings, open water lines, coast lines. Of relations only outer ways count.
    """
    tag = F.col("tags")
    wet = F.coalesce((tag["natural"] == "water") | (tag["waterway"] == "riverbank"), F.lit(False))
    coast = F.coalesce(tag["natural"] == "coastline", F.lit(False))
    g = F.col("geometry")
    shut = F.element_at(g, 1) == F.element_at(g, -1)
    ways = elements.where((F.col("type") == "way") & (F.size("geometry") >= 2)).select(F.col("id").alias("part"), F.lit(0).alias("pos"), F.when(coast, "coast").when(wet & shut, "closed").when(wet, "open").alias("layer"), g.alias("points"))
    outer = elements.where((F.col("type") == "relation") & wet).select("id", F.posexplode("members").alias("pos", "m")).where("m.type = 'way' AND m.role = 'outer' AND m.geometry IS NOT NULL")
    parts = outer.select(F.col("id").alias("part"), "pos", F.lit("open").alias("layer"), F.col("m.geometry").alias("points"))
    return ways.where("layer is not null").unionByName(parts)


def build_water(elements: DataFrame, box: Box, least_km2: float = 0.2) -> DataFrame:
    """(ring, k, lat, lng): rings of water inside a box; ring names a ring's layer and first part. Coasts keep their direction, and closed ones are islands."""
    parts = settle(water_segments(elements))
    one = F.struct("part", "pos").alias("chain")
    shut = parts.where("layer = 'closed'").select("layer", one, F.slice("points", F.lit(1), F.size("points") - 1).alias("points"))
    joined = assembled(parts.where("layer = 'open'")).where("closed").select("layer", "chain", "points")
    coasts = assembled(parts.where("layer = 'coast'"), turn=False).where("not closed").select("layer", "chain", "points")
    rows = shut.unionByName(joined).unionByName(coasts).select("layer", F.concat_ws("-", "layer", "chain.part", "chain.pos").alias("ring"), "points")

    def run(frames):
        for pdf in frames:
            out = []
            for layer, ring, points in zip(pdf["layer"], pdf["ring"], pdf["points"], strict=True):
                line = [(p["lat"], p["lon"]) for p in points]
                whole = closed_by_border(line, box) if layer == "coast" else line
                kept = clip(whole, box) if whole else []
                if len(kept) >= 4 and area_km2(kept) >= least_km2:
                    out += [(ring, k, lat, lng) for k, (lat, lng) in enumerate(kept)]
            yield pd.DataFrame(out, columns=["ring", "k", "lat", "lng"])

    return rows.mapInPandas(run, "ring string, k int, lat double, lng double")


#: Places that must be wet or dry: latitude, longitude, name, wet (fixed values).
PROBES = (
    (47.598, -122.37, "Elliott Bay", True), (47.64, -122.334, "Lake Union", True), (47.68, -122.335, "Green Lake", True),
    (47.66, -122.26, "Lake Washington", True), (47.61, -122.332, "Downtown", False), (47.668, -122.384, "Ballard", False),
    (47.657, -122.406, "Discovery Park", False),
)


def water_failures(vertices: DataFrame, probes=PROBES) -> DataFrame:
    """(name, expected) of probes that are not as they must be."""
    spark = vertices.sparkSession
    p = spark.createDataFrame([(i, lat, lng, name, wet) for i, (lat, lng, name, wet) in enumerate(probes)], "id int, lat double, lng double, name string, wet boolean")
    got = in_rings(p.select("id", "lat", "lng"), vertices).select("id").distinct().withColumn("in", F.lit(True))
    is_wet = F.coalesce("in", F.lit(False))
    return p.join(got, "id", "left").where(is_wet != F.col("wet")).select("name", F.when(F.col("wet"), "water").otherwise("land").alias("expected"))
