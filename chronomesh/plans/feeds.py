"""Feed parsing, set operations, calendars and the smaller operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import rounded
from ..operators import graph, polygons, reports, spatial, transit
from ..sources.files import csv_fields
from ..sources.http import matrix_blocks, public_roads
from ..operators.shared import settle
from .bindings import CTE, anchors, links, pick, readings, stops, table, timetable, ways, with_ctes
from .catalog import query, sql_haversine, sql_km, sql_round
from .layouts import RINGS, rings
from .spatial import ROAD, known, segments


@query("s6_csv_fields", """SELECT p_partkey, unnest([CAST(p_partkey AS VARCHAR), p_name || ', "' || p_brand || '"', '', p_type]) AS field, unnest([0, 1, 2, 3]) AS place FROM part""")
def s6(spark, sf):
    """Lines with quotes, doubled quotes, commas and empty fields, taken apart again."""
    quoted = F.concat(F.lit('"'), F.replace(F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), quoted, F.lit(""), F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", F.posexplode(csv_fields(line)).alias("place", "field"))


@query("s12_feed_statistics", "SELECT l_returnflag AS feed, l_linestatus AS member, count(*) - 1 AS rows FROM lineitem GROUP BY ALL")
def s12(spark, sf):
    from ..sources.files import member_counts

    return member_counts(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("feed"), F.col("l_linestatus").alias("member")))


ACCESS_TAGS = (None, "no", "permissive", "private", "destination")


@query(
    "s9_road_predicate",
    f"""{with_ctes('ways')}, t AS (SELECT way, highway, (['', 'no', 'permissive', 'private', 'destination'])[(way // 4) % 5 + 1] AS access FROM ways)
      SELECT way AS id, highway, nullif(access, '') AS access FROM t WHERE regexp_full_match(highway, 'motorway|trunk|primary|secondary|tertiary|unclassified|residential|living_street|motorway_link|trunk_link|primary_link|secondary_link|tertiary_link')
      AND NOT regexp_full_match(access, 'no|private')""",
)
def s9(spark, sf):
    """Ways of a drivable class whose access does not forbid; those without the tag stay."""
    tagged = ways(spark, sf).select(F.col("way").alias("id"), "highway", pick(ACCESS_TAGS, F.floor(F.col("way") / 4) % len(ACCESS_TAGS)).alias("access"))
    return public_roads(tagged)


@query("s14_matrix_blocks", f"{with_ctes('anchors')}, z AS (SELECT id FROM anchors) SELECT a.id // 25 AS bi, b.id // 25 AS bj, count(*) AS cells FROM z a, z b GROUP BY ALL")
def s14(spark, sf):
    return matrix_blocks(anchors(spark, sf)).select("bi", "bj", (F.size("origins") * F.size("destinations")).cast("long").alias("cells"))


@query("u1_union_feeds", "SELECT feed, count(*) AS stops FROM (SELECT 'a:' || c_custkey AS id, 'a' AS feed FROM customer UNION ALL SELECT 'b:' || s_suppkey, 'b' FROM supplier) GROUP BY feed")
def u1(spark, sf):
    a = table(spark, sf, "customer").select(F.concat(F.lit("a:"), "c_custkey").alias("id"), F.lit("a").alias("feed"))
    b = table(spark, sf, "supplier").select(F.concat(F.lit("b:"), "s_suppkey").alias("id"), F.lit("b").alias("feed"))
    return a.unionByName(b).groupBy("feed").agg(F.count("id").alias("stops"))


_CAL = "c AS (SELECT CAST(o_custkey AS VARCHAR) AS service_id, strftime(min(o_orderdate), '%Y%m%d') AS start_date, strftime(max(o_orderdate), '%Y%m%d') AS end_date, CASE WHEN o_custkey % 3 <> 0 THEN '1' ELSE '0' END AS wednesday FROM orders GROUP BY o_custkey)"
_EXC = "x AS (SELECT CAST(o_custkey AS VARCHAR) AS service_id, CASE WHEN o_orderkey % 4 = 0 THEN '2' ELSE '1' END AS exception_type, o_orderkey AS line FROM orders)"
DAY = "19950607"


def calendar(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.date_format(F.min("o_orderdate"), "yyyyMMdd").alias("start_date"), F.date_format(F.max("o_orderdate"), "yyyyMMdd").alias("end_date"))
    runs = F.when(F.col("o_custkey") % 3 != 0, "1").otherwise("0")
    return o.select(F.col("o_custkey").cast("string").alias("service_id"), "start_date", "end_date", *((runs if d == "wednesday" else F.lit("0")).alias(d) for d in transit.WEEKDAYS))


def exceptions(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("service_id"), F.lit(DAY).alias("date"), F.when(k % 4 == 0, "2").otherwise("1").alias("exception_type"), k.alias("line"))


@query("x1_calendar", f"WITH {_CAL} SELECT service_id FROM c WHERE start_date <= '{DAY}' AND end_date >= '{DAY}' AND wednesday = '1'")
def x1(spark, sf):
    return transit.active_services(calendar(spark, sf), exceptions(spark, sf).limit(0), DAY)


@query("u3_service_exceptions", f"WITH {_CAL}, {_EXC}, l AS (SELECT service_id, arg_max(exception_type, line) AS kind FROM x GROUP BY service_id) SELECT service_id FROM (SELECT service_id FROM c WHERE start_date <= '{DAY}' AND end_date >= '{DAY}' AND wednesday = '1' UNION SELECT service_id FROM l WHERE kind = '1') WHERE service_id NOT IN (SELECT service_id FROM l WHERE kind <> '1')")
def u3(spark, sf):
    return transit.active_services(calendar(spark, sf), exceptions(spark, sf), DAY)


@query("u4_symmetrized_edges", f"{with_ctes('links')} SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM links UNION ALL SELECT dst, src FROM links) GROUP BY src, dst")
def u4(spark, sf):
    e = links(spark, sf).select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("u6_marked_union", "SELECT l_suppkey AS stop FROM lineitem WHERE l_quantity > 45 UNION SELECT l_suppkey FROM lineitem WHERE l_discount > 0.08")
def u6(spark, sf):
    line = table(spark, sf, "lineitem")
    return line.where("l_quantity > 45").select("l_suppkey").union(line.where("l_discount > 0.08D").select("l_suppkey")).distinct().withColumnRenamed("l_suppkey", "stop")


@query("u7_wanted_anchors", "SELECT DISTINCT user_id % 17 AS anchor FROM events")
def u7(spark, sf):
    return table(spark, sf, "events").select((F.col("user_id") % 17).alias("anchor")).distinct()


@query("a18_pattern_stops", f"{with_ctes('timetable')} SELECT pattern, count(DISTINCT stop) AS stops FROM timetable GROUP BY pattern")
def a18(spark, sf):
    return timetable(spark, sf).select("pattern", "stop").distinct().groupBy("pattern").agg(F.count("*").alias("stops"))


@query("t4_argmin", "SELECT l_suppkey, arg_min(l_orderkey, {'p': l_extendedprice, 'k': l_orderkey}) AS l_orderkey FROM lineitem GROUP BY l_suppkey")
def t4(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.min_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("l_orderkey"))


@query("t8_first_found", "SELECT n_name FROM nation WHERE n_nationkey = 7")
def t8(spark, sf):
    return table(spark, sf, "nation").where("n_nationkey = 7").select("n_name")


@query("w1_adjacent_pairs", f"{with_ctes('ways')}, u AS (SELECT way, unnest(nodes) AS a, unnest(range(1, len(nodes) + 1)) AS pos FROM ways), p AS (SELECT *, lead(a) OVER (PARTITION BY way ORDER BY pos) AS b FROM u) SELECT way, CAST(pos AS INTEGER) AS pos, a, b FROM p WHERE b IS NOT NULL")
def w1(spark, sf):
    w = Window.partitionBy("way").orderBy("pos")
    n = ways(spark, sf).select("way", F.posexplode("nodes").alias("pos", "a"))
    return n.select("way", (F.col("pos") + 1).alias("pos"), "a", F.lead("a").over(w).alias("b")).where("b is not null")


@query("x8_missing_places", f"{with_ctes('ways', 'anchors')}, u AS (SELECT way, unnest(nodes) AS node FROM ways) SELECT way, count(*) AS known FROM u WHERE node IN (SELECT id FROM anchors WHERE id % 4 <> 0) GROUP BY way")
def x8(spark, sf):
    known = anchors(spark, sf).where("id % 4 <> 0").select(F.col("id").alias("node"))
    return ways(spark, sf).select("way", F.explode("nodes").alias("node")).join(known, "node", "left_semi").groupBy("way").agg(F.count("*").alias("known"))


_TIERS = "CASE highway " + " ".join(f"WHEN '{h}' THEN {t}" for h, t in reports.TIERS.items()) + " END"


@query("x10_street_tiers", f"{with_ctes('ways')} SELECT way, {_TIERS} AS tier FROM ways WHERE {_TIERS} IS NOT NULL")
def x10(spark, sf):
    """Tiers of drawn streets; residential streets and links below primary are not drawn."""
    return ways(spark, sf).select("way", reports.street_tier(F.col("highway")).alias("tier")).where("tier is not null")


@query("x9_known_chain_nodes", f"{with_ctes('ways', 'anchors')}, u AS (SELECT way, unnest(nodes) AS node, unnest(range(len(nodes))) AS pos FROM ways) SELECT way, string_agg(CAST(node AS VARCHAR), ',' ORDER BY pos) AS nodes FROM u WHERE node IN (SELECT id FROM anchors WHERE id % 4 <> 0) GROUP BY way")
def x9(spark, sf):
    """Nodes without a place leave their ways before ways are joined."""
    return reports.known_nodes(ways(spark, sf), known(spark, sf)).select("way", F.concat_ws(",", F.col("nodes").cast("array<string>")).alias("nodes"))


@query("x15_fallback_path", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN [o_orderkey, o_custkey] ELSE [o_orderkey, 0, o_custkey] END AS path FROM orders")
def x15(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    path = F.when(k % 4 != 0, F.array(k, F.lit(0).cast("long"), c))
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(path, F.array(k, c)).alias("path"))


@query("x2_usable_trips", f"{with_ctes('anchors')} SELECT l_orderkey FROM lineitem JOIN anchors a ON l_suppkey = a.id GROUP BY l_orderkey HAVING count(*) >= 2 AND bool_or(lat > 47.6 AND lat < 47.65)")
def x2(spark, sf):
    near = F.col("lat").between(47.6, 47.65) & (F.col("lat") != 47.6) & (F.col("lat") != 47.65)
    t = table(spark, sf, "lineitem").join(anchors(spark, sf), F.col("l_suppkey") == F.col("id")).groupBy("l_orderkey")
    return t.agg(F.count("*").alias("n"), F.bool_or(near).alias("in")).where(F.col("in") & (F.col("n") >= 2)).select("l_orderkey")


@query("j2_dense_nodes", f"{ROAD} SELECT node, dense_rank() OVER (ORDER BY node) - 1 AS place FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)")
def j2(spark, sf):
    """Dense numbers of the nodes, counted by blocks so that no task holds them all."""
    e = graph.road_edges(segments(spark, sf))
    n = e.select(F.explode(F.array("src", "dst")).alias("src"), F.lit(1).alias("dst")).distinct()
    return graph.csr(n).select(F.col("src").alias("node"), F.col("first").cast("long").alias("place"))


@query("j14_all_pairs", f"{with_ctes('anchors')} SELECT a.id AS i, count(*) AS n, {sql_round(f'sum({sql_km("a.lat", "a.lng", "b.lat", "b.lng")})', 4)} AS km FROM anchors a, anchors b GROUP BY a.id")
def j14(spark, sf):
    a = anchors(spark, sf)
    b = a.select(F.col("id").alias("j"), F.col("lat").alias("y"), F.col("lng").alias("x"))
    return spatial.every_pair(a, b, "id").groupBy(F.col("id").alias("i")).agg(F.count("*").alias("n"), rounded(F.sum(geo.flat_km(F.col("lat"), F.col("lng"), F.col("y"), F.col("x"))), 4).alias("km"))


@query("j21_access_lookup", f"{with_ctes('anchors', 'stops')} SELECT a.id AS anchor, s.id AS stop FROM anchors a JOIN stops s ON a.id % 50 = s.id % 50")
def j21(spark, sf):
    node = (F.col("id") % 50).alias("node")
    stop = stops(spark, sf).select(F.col("id").alias("stop"), node)
    a = anchors(spark, sf).select(F.col("id").alias("anchor"), node)
    return spatial.every_pair(stop, a.withColumnRenamed("node", "at"), "stop", F.col("node") == F.col("at")).select("anchor", "stop")


@query("x16_swapped_rings", "SELECT c_custkey AS k, -122.43 + (c_custkey * 104729 % 1900) / 1e4 AS first, 47.5 + (c_custkey * 7919 % 2340) / 1e4 AS second FROM customer")
def x16(spark, sf):
    """Rings in their stored order, longitude first."""
    return rings(spark, sf).select("k", F.col("lng").alias("first"), F.col("lat").alias("second"))


@query("x19_means", f"{with_ctes('readings')} SELECT {sql_round('avg(r_lat)', 6)} AS lat, {sql_round('sum(factor)', 4)} AS total, {sql_round('corr(r_lat, r_lng)', 6)} AS r FROM readings")
def x19(spark, sf):
    return readings(spark, sf).agg(rounded(F.avg("r_lat"), 6).alias("lat"), rounded(F.sum("factor"), 4).alias("total"), rounded(F.corr("r_lat", "r_lng"), 6).alias("r"))


@query("u5_water_layers", "SELECT layer, count(*) AS rings FROM (SELECT DISTINCT c_nationkey AS ring, 'closed' AS layer FROM customer UNION ALL SELECT DISTINCT c_nationkey, 'coast' FROM customer WHERE c_nationkey < 2) GROUP BY layer")
def u5(spark, sf):
    r = rings(spark, sf).select("ring").distinct()
    return r.withColumn("layer", F.lit("closed")).unionByName(r.where("ring < 2").withColumn("layer", F.lit("coast"))).groupBy("layer").agg(F.count("*").alias("rings"))


_FEET = f"""o AS MATERIALIZED (SELECT DISTINCT e.src, e.dst, a.lat AS a1, a.lng AS a2, b.lat AS b1, b.lng AS b2 FROM e JOIN q a ON e.src = a.id JOIN q b ON e.dst = b.id),
  f AS MATERIALIZED (SELECT src, dst, min(w) AS w FROM (SELECT src, dst, {sql_km('a1', 'a2', 'b1', 'b2')} * 1000 / 1.35 AS w FROM o UNION ALL SELECT dst, src, {sql_km('a1', 'a2', 'b1', 'b2')} * 1000 / 1.35 FROM o) WHERE src <> dst GROUP BY src, dst),
  g AS MATERIALIZED (SELECT * FROM q WHERE id IN (SELECT src FROM f)),
  near AS MATERIALIZED (SELECT s.id AS stop, arg_min(g.id, {{'d': {sql_haversine('s.lat', 's.lng', 'g.lat', 'g.lng')}, 'n': g.id}}) AS node, min({sql_haversine('s.lat', 's.lng', 'g.lat', 'g.lng')}) / 1.35 AS gap FROM stops s, g GROUP BY s.id),
  d(source, node, dist) USING KEY (source, node) AS (SELECT id, id, CAST(0 AS DOUBLE) FROM g
    UNION SELECT n.source, n.node, n.dist FROM (SELECT d.source, f.dst AS node, min(d.dist + f.w) AS dist FROM d JOIN f ON d.node = f.src WHERE d.dist + f.w <= 720 GROUP BY d.source, f.dst) n
    LEFT JOIN recurring.d x ON n.source = x.source AND n.node = x.node WHERE x.dist IS NULL OR n.dist < x.dist)"""


@query("g9_stop_access", f"WITH RECURSIVE stops AS MATERIALIZED ({CTE['stops']}), {ROAD.removeprefix('WITH ')}, {_FEET} SELECT source AS anchor, stop, CAST(floor(dist + gap + 0.5) AS BIGINT) AS seconds FROM d JOIN near USING (node) WHERE gap * 1.35 <= 300")
def g9(spark, sf):
    """Stops within a walk of 720 seconds of each node of the streets, which stand for anchors that are on the graph."""
    walk = settle(graph.least_edges(graph.walk_edges(settle(segments(spark, sf))).withColumnRenamed("seconds", "w")))
    at = known(spark, sf).join(walk.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    nodes = at.select(F.col("id").alias("node"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    return transit.stop_access(at.select("id", F.col("id").alias("node")), walk, stops(spark, sf), nodes)


CLIP_BOX = (47.55, 47.68, -122.4, -122.28)


def _clip_pass(name: str, before: str, axis: str, bound: float, sign: int) -> str:
    """One side of the box: what lies inside stays, and where an edge crosses the side there is a new vertex after its first one."""
    share = "(d / (d - d2))"
    met = {"lat": f"lat + {share} * (lat2 - lat)", "lng": f"lng + {share} * (lng2 - lng)"} | {axis: str(bound)}
    w = "PARTITION BY ring ORDER BY k"
    return f"""{name}n AS (SELECT ring, k, lat, lng, coalesce(lead(lat) OVER ({w}), first(lat) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS lat2,
      coalesce(lead(lng) OVER ({w}), first(lng) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS lng2 FROM {before}),
    {name}d AS (SELECT *, {sign} * ({axis} - {bound}) AS d, {sign} * ({axis}2 - {bound}) AS d2 FROM {name}n),
    {name} AS MATERIALIZED (SELECT ring, row_number() OVER (PARTITION BY ring ORDER BY k, part) AS k, lat, lng FROM (SELECT ring, k, 0 AS part, lat, lng FROM {name}d WHERE d >= 0
      UNION ALL SELECT ring, k, 1, {met['lat']}, {met['lng']} FROM {name}d WHERE (d >= 0) <> (d2 >= 0)))"""


_SIDES = (("lat", CLIP_BOX[1], -1), ("lat", CLIP_BOX[0], 1), ("lng", CLIP_BOX[3], -1), ("lng", CLIP_BOX[2], 1))
_CLIPPED = ",\n".join(_clip_pass(f"c{n + 1}", f"c{n}" if n else "v", *side) for n, side in enumerate(_SIDES))


@query(
    "g21_clip_rings",
    f"""WITH {RINGS}, {_CLIPPED}, z AS (SELECT ring, lat, lng, coalesce(lead(lat) OVER w, first(lat) OVER f) AS lat2, coalesce(lead(lng) OVER w, first(lng) OVER f) AS lng2 FROM c4
      WINDOW w AS (PARTITION BY ring ORDER BY k), f AS (PARTITION BY ring ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    t AS (SELECT ring, count(*) AS n, abs(sum(lng2 * lat - lng * lat2) / 2 * 111.32 * cos(radians(47.61)) * 111.32) AS km2 FROM z GROUP BY ring)
    SELECT CAST(r.ring AS BIGINT) AS ring, CAST(coalesce(t.n, 0) AS INTEGER) AS vertices, {sql_round('coalesce(t.km2, 0.0)', 3)} AS km2 FROM (SELECT DISTINCT ring FROM v) r LEFT JOIN t ON r.ring = t.ring""",
)
def g21(spark, sf):
    """Rings cut by the middle of the city, with the area that is left."""
    box = CLIP_BOX

    def kernel(pdf):
        import pandas as pd

        ring = polygons.clip(list(zip(pdf.sort_values("k")["lat"], pdf.sort_values("k")["lng"], strict=True)), box)
        return pd.DataFrame({"ring": [pdf["ring"].iloc[0]], "vertices": [len(ring)], "km2": [polygons.area_km2(ring) if ring else 0.0]})

    cut = rings(spark, sf).select(F.col("ring").cast("long").alias("ring"), "k", "lat", "lng").groupBy("ring").applyInPandas(kernel, "ring long, vertices int, km2 double")
    return cut.select("ring", "vertices", rounded(F.col("km2"), 3).alias("km2"))


@query("g26_basemap")
def g26(spark, sf):
    """Drawn streets of each tier, joined at shared nodes and thinned."""
    return reports.basemap(ways(spark, sf), known(spark, sf)).select("tier", "chain", F.size("points").alias("vertices"), F.to_json("points").alias("points"))


def water_elements(spark, sf):
    """Nested elements: each nation's pond as a closed way, and once more as a relation of two open halves; a coast from north to south."""
    from .layouts import ponds

    point = F.struct(F.col("lat"), F.col("lng").alias("lon"))
    ring = ponds(spark, sf).groupBy(F.col("ring").cast("long").alias("n")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", point.alias("p")))), lambda s: s["p"]).alias("g"))
    shut = F.concat("g", F.slice("g", 1, 1))
    half = F.floor(F.size("g") / 2).cast("int")
    member = lambda geometry: F.struct(F.lit("way").alias("type"), F.lit("outer").alias("role"), geometry.alias("geometry"))
    two = F.array(member(F.slice(shut, F.lit(1), half + 1)), member(F.slice(shut, half + 1, F.size("g"))))
    tags = F.create_map(F.lit("natural"), F.lit("water"))
    members, geometry = "array<struct<type:string,role:string,geometry:array<struct<lat:double,lon:double>>>>", "array<struct<lat:double,lon:double>>"
    ways_ = ring.select(F.col("n").alias("id"), F.lit("way").alias("type"), tags.alias("tags"), shut.cast(geometry).alias("geometry"), F.lit(None).cast(members).alias("members"))
    parts = ring.select((F.col("n") + 100).alias("id"), F.lit("relation").alias("type"), tags.alias("tags"), F.lit(None).cast(geometry).alias("geometry"), two.cast(members).alias("members"))
    line = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct((47.734 - i * 0.0585).alias("lat"), F.lit(-122.425).alias("lon")))
    coast = spark.range(1).select(F.lit(999).cast("long").alias("id"), F.lit("way").alias("type"), F.create_map(F.lit("natural"), F.lit("coastline")).alias("tags"), line.cast(geometry).alias("geometry"), F.lit(None).cast(members).alias("members"))
    return ways_.unionByName(parts).unionByName(coast)


CITY = (47.5, 47.734, -122.43, -122.24)


@query("g22_assembled_rings", "SELECT c_nationkey + 100 AS part, true AS closed, count(*) AS vertices FROM customer GROUP BY 1")
def g22(spark, sf):
    """Open halves of ponds, joined to rings again."""
    found = polygons.assembled(polygons.water_segments(water_elements(spark, sf)).where("layer = 'open'"))
    return found.select("chain.part", "closed", F.size("points").cast("long").alias("vertices"))


@query("x4_water_layers", "SELECT layer, count(*) AS parts FROM (SELECT DISTINCT 'closed' AS layer, c_nationkey AS n, 0 AS half FROM customer UNION ALL SELECT DISTINCT 'open', c_nationkey, half FROM customer, range(2) AS t(half) UNION ALL SELECT 'coast', 0, 0) GROUP BY layer")
def x4(spark, sf):
    return polygons.water_segments(water_elements(spark, sf)).groupBy("layer").agg(F.count("*").alias("parts"))


@query("g24_water")
def g24(spark, sf):
    """Rings of water inside the city from nested elements: ponds, joined ponds, and the sea west of a coast that the border closes."""
    return polygons.build_water(water_elements(spark, sf), CITY)
