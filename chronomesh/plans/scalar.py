"""Projections, predicates and scalar expressions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import rounded
from ..operators import spatial
from .bindings import CLASSES, ONEWAY_TAGS, SPEED_TAGS, _values, anchors, pick, readings, stops, table, ways, with_ctes
from .catalog import query, sql_haversine, sql_km, sql_round

CORE = (47.606, -122.335)
_PART = f"SELECT p_partkey, ({_values(CLASSES)})[p_partkey % {len(CLASSES)} + 1] AS highway, ({_values(SPEED_TAGS)})[p_partkey % {len(SPEED_TAGS)} + 1] AS maxspeed, ({_values(ONEWAY_TAGS)})[p_partkey % {len(ONEWAY_TAGS)} + 1] AS oneway, CAST(p_retailprice AS DOUBLE) AS metres FROM part"
SQL_MPH = "coalesce(TRY_CAST(nullif(regexp_extract(maxspeed, '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE), CASE highway " + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in geo.CLASS_MPH.items()) + " ELSE 25.0 END)"
SQL_DRIVABLE = "highway IN (" + ", ".join(f"'{k}'" for k in geo.CLASS_MPH) + ")"
SQL_DIRECTIONS = "CASE WHEN oneway = '-1' THEN [-1] WHEN coalesce(oneway IN ('yes', 'true', '1'), false) OR highway IN ('motorway', 'motorway_link') THEN [1] ELSE [1, -1] END"


def roads(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", pick(CLASSES, k % len(CLASSES)).alias("highway"), pick(SPEED_TAGS, k % len(SPEED_TAGS)).alias("maxspeed"), pick(ONEWAY_TAGS, k % len(ONEWAY_TAGS)).alias("oneway"), F.col("p_retailprice").cast("double").alias("metres"))


@query("p1_haversine", f"{with_ctes('stops')} SELECT id, {sql_round(sql_haversine('lat', 'lng', '47.606', '-122.335'), 3)} AS metres FROM stops")
def p1(spark, sf):
    return stops(spark, sf).select("id", rounded(geo.haversine_m(F.col("lat"), F.col("lng"), *CORE), 3).alias("metres"))


@query("p2_equirectangular", f"{with_ctes('stops')} SELECT id, {sql_round(sql_km('lat', 'lng', '47.606', '-122.335'), 6)} AS km FROM stops")
def p2(spark, sf):
    return stops(spark, sf).select("id", rounded(geo.flat_km(F.col("lat"), F.col("lng"), *CORE), 6).alias("km"))


@query("p3_maxspeed", f"SELECT p_partkey, {SQL_MPH} AS mph FROM ({_PART})")
def p3(spark, sf):
    return roads(spark, sf).select("p_partkey", geo.maxspeed_mph(F.col("maxspeed"), F.col("highway")).alias("mph"))


@query("p4_drivable", f"SELECT p_partkey, highway FROM ({_PART}) WHERE {SQL_DRIVABLE}")
def p4(spark, sf):
    return roads(spark, sf).where(geo.drivable(F.col("highway"))).select("p_partkey", "highway")


@query("p5_oneway", f"SELECT p_partkey, unnest({SQL_DIRECTIONS}) AS dir FROM ({_PART})")
def p5(spark, sf):
    return roads(spark, sf).select("p_partkey", F.explode(geo.directions(F.col("oneway"), F.col("highway"))).alias("dir"))


@query("p6_edge_seconds", f"SELECT p_partkey, {sql_round(f'CASE WHEN {SQL_MPH} > 0 THEN metres / ({SQL_MPH} * 0.44704) END', 4)} AS seconds FROM ({_PART})")
def p6(spark, sf):
    return roads(spark, sf).select("p_partkey", rounded(geo.edge_seconds(F.col("metres"), geo.maxspeed_mph(F.col("maxspeed"), F.col("highway"))), 4).alias("seconds"))


@query("p8_clamp_factor", "SELECT event_id, CASE WHEN x IS NULL OR isnan(x) OR isinf(x) OR x < 1 THEN 1.0 ELSE least(x, 4.0) END AS factor FROM (SELECT event_id, CASE event_id % 50 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN NULL ELSE value / 30 END AS x FROM events)")
def p8(spark, sf):
    k = F.col("event_id") % 50
    x = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, None).otherwise(F.col("value") / 30)
    return table(spark, sf, "events").select("event_id", geo.clamp_factor(x).alias("factor"))


_SLOW = f"1 + 0.9 * exp(-pow({sql_km('lat', 'lng', '47.606', '-122.335')} / 4, 2))"


@query("p9_modeled_slowdown", f"{with_ctes('stops')} SELECT id, {sql_round(f'least(greatest({_SLOW}, 1.0), 4.0)', 6)} AS factor FROM stops")
def p9(spark, sf):
    return stops(spark, sf).select("id", rounded(geo.modeled_slowdown(F.col("lat"), F.col("lng")), 6).alias("factor"))


def _rect(a, b, r):
    return f"(({a}.lat + {b}.lat) / 2 > {r[0]} AND ({a}.lat + {b}.lat) / 2 < {r[1]} AND ({a}.lng + {b}.lng) / 2 > {r[2]} AND ({a}.lng + {b}.lng) / 2 < {r[3]})"


_LAKE = f"({_rect('a', 'b', geo.LAKES[0])} OR {_rect('a', 'b', geo.LAKES[1])})"
_SYN = f"floor((abs(b.lat - a.lat) * 111.32 / 45 * 3600 + abs(b.lng - a.lng) * 111.32 * cos(radians(47.61)) / 22 * 3600 + CASE WHEN (a.lat - 47.655) * (b.lat - 47.655) < 0 THEN 240.0 ELSE 0.0 END) * CASE WHEN {_LAKE} THEN 1.25 ELSE 1.0 END + 90 + 0.5)"
SYNTHETIC = f"SELECT a.id AS i, b.id AS j, CASE WHEN a.id = b.id THEN 0 ELSE CAST({_SYN} AS BIGINT) END AS seconds FROM anchors a, anchors b"


def synthetic(spark, sf):
    """All ordered pairs of anchors; the anchors are the small side on purpose, the result is what is asked for."""
    return both_ways(spark, sf).select("i", "j", "seconds")


def anchor_pairs(spark, sf, on=None):
    """(i, lat, lng, j, r_lat, r_lng): pairs of anchors."""
    a = anchors(spark, sf)
    b = a.select(F.col("id").alias("j"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    return spatial.every_pair(a.withColumnRenamed("id", "i"), b, "i", on)


def both_ways(spark, sf):
    """(i, j, seconds, back): all ordered pairs of anchors with the way back, which is known where the pair is made: no pair has to look for its other."""
    there, here = (F.col("lat"), F.col("lng")), (F.col("r_lat"), F.col("r_lng"))
    same = F.col("i") == F.col("j")
    way = lambda a, b: F.when(same, 0).otherwise(geo.synthetic_seconds(*a, *b)).cast("long")
    return anchor_pairs(spark, sf).select("i", "j", way(there, here).alias("seconds"), way(here, there).alias("back"))


@query("p10_synthetic_matrix", f"{with_ctes('anchors')} {SYNTHETIC}")
def p10(spark, sf):
    return synthetic(spark, sf)


@query("mean_travel_time", f"{with_ctes('anchors')}, m AS ({SYNTHETIC}) SELECT x.i AS id, {sql_round('avg((x.seconds + y.seconds) / 2.0)', 3)} AS seconds FROM m x JOIN m y ON x.i = y.j AND x.j = y.i GROUP BY x.i")
def mean_travel_time(spark, sf):
    """Mean of both ways from each anchor to all."""
    m = both_ways(spark, sf).select("i", geo.round_trip(F.col("seconds"), F.col("back")).alias("d"))
    return m.groupBy("i").agg(rounded(F.avg("d"), 3).alias("seconds")).withColumnRenamed("i", "id")


@query("p11_gtfs_time", "SELECT o_orderkey, ((o_orderkey % 30) * 3600 + (o_orderkey % 60) * 60 + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 59 END) AS seconds FROM orders")
def p11(spark, sf):
    k = F.col("o_orderkey")
    text = F.concat_ws(":", k % 30, F.lpad((k % 60).cast("string"), 2, "0"), F.when(k % 3 != 0, F.lpad((k % 59).cast("string"), 2, "0")))
    return table(spark, sf, "orders").select("o_orderkey", geo.gtfs_seconds(text).cast("long").alias("seconds"))


@query("p12_departure", "SELECT user_id, CAST(max(hour(ts) * 3600 + minute(ts) * 60) AS BIGINT) AS depart FROM events GROUP BY user_id")
def p12(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max(geo.gtfs_seconds(F.date_format("ts", "HH:mm"))).cast("long").alias("depart"))


@query("p13_service_date", "SELECT o_orderkey, CAST(d + CAST((10 - isodow(d)) % 7 AS INTEGER) AS DATE) AS service FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def p13(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", geo.service_date(F.to_date("o_orderdate")).alias("service"))


@query("p14_next_wednesday", "SELECT o_orderkey, CAST(d + CAST(1 + (9 - isodow(d)) % 7 AS INTEGER) AS DATE) AS depart FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def p14(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", geo.strictly_next_wednesday(F.to_date("o_orderdate")).alias("depart"))


@query("p18_lake_midpoint", f"{with_ctes('anchors')} SELECT a.id AS i, b.id AS j FROM anchors a, anchors b WHERE a.id < b.id AND {_LAKE}")
def p18(spark, sf):
    x = [F.col(c) for c in ("lat", "lng", "r_lat", "r_lng")]
    return anchor_pairs(spark, sf, (F.col("i") < F.col("j")) & (geo.middle_in(*x, geo.LAKES[0]) | geo.middle_in(*x, geo.LAKES[1]))).select("i", "j")


@query("p19_padded_box", f"{with_ctes('stops')} SELECT id FROM stops WHERE lat > 47.6 - 0.05 AND lat < 47.65 + 0.05 AND lng > -122.36 - 0.05 AND lng < -122.3 + 0.05")
def p19(spark, sf):
    return stops(spark, sf).where("lat > 47.6 - 0.05D AND lat < 47.65 + 0.05D AND lng > -122.36 - 0.05D AND lng < -122.3 + 0.05D").select("id")


@query("p22_cell_key", f"{with_ctes('stops')} SELECT CAST(floor(lat / 0.004) AS BIGINT) AS cy, CAST(floor(lng / 0.004) AS BIGINT) AS cx, count(*) AS n FROM stops GROUP BY ALL")
def p22(spark, sf):
    return stops(spark, sf).groupBy(geo.cell(F.col("lat"), 0.004).alias("cy"), geo.cell(F.col("lng"), 0.004).alias("cx")).agg(F.count("*").alias("n"))


@query("p23_fixed_digits", f"SELECT o_orderkey, {', '.join(f'{sql_round("o_totalprice / 7919", k)} AS d{k}' for k in range(1, 7))} FROM orders")
def p23(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", *(rounded(F.col("o_totalprice") / 7919, k).alias(f"d{k}") for k in range(1, 7)))


@query("p24_round_half_up", "SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(floor(l_quantity / 4 - 5 + 0.5) AS BIGINT) AS r FROM lineitem")
def p24(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", rounded(F.col("l_quantity") / 4 - 5).alias("r"))




@query("p25_drawn_text", f"SELECT o_orderkey, CASE WHEN f < 0.97 THEN CAST(abs(CAST(floor((f - 1) * 100 + 0.5) AS INTEGER)) AS VARCHAR) || '% closer' WHEN f > 1.03 THEN CAST(abs(CAST(floor((f - 1) * 100 + 0.5) AS INTEGER)) AS VARCHAR) || '% farther' ELSE 'close to true' END AS text FROM (SELECT o_orderkey, CAST(0.5 AS DOUBLE) + (o_orderkey % 120) / CAST(100 AS DOUBLE) AS f FROM orders)")
def p25(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", geo.drawn_text(0.5 + F.col("o_orderkey") % 120 / F.lit(100.0)).alias("text"))


@query("p26_caption", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'noted' WHEN event_id % 5 = 0 THEN 'free flow' ELSE strftime(timezone('America/Los_Angeles', timezone('UTC', ts + to_hours(CAST(event_id % 8760 AS BIGINT)))), '%Y-%m-%d %H:%M') END AS caption FROM events")
def p26(spark, sf):
    """Captions with the city's time; captures are spread over a year, so that both daylight saving and standard time occur."""
    at = F.expr("CAST(ts AS TIMESTAMP) + make_dt_interval(0, CAST(event_id % 8760 AS INT))")
    note = F.when(F.col("event_type") == "view", "noted")
    free = F.when(F.col("event_id") % 5 == 0, "free flow")
    local = F.date_format(F.from_utc_timestamp(at, "America/Los_Angeles"), "yyyy-MM-dd HH:mm")
    return table(spark, sf, "events").select("event_id", F.coalesce(note, free, local).alias("caption"))


@query("p27_dot_radius", f"SELECT event_id, {sql_round('1.5 + 0.7 * least(value / 120, 3.0)', 6)} AS radius FROM events")
def p27(spark, sf):
    return table(spark, sf, "events").select("event_id", rounded(1.5 + 0.7 * F.least(F.col("value") / 120, F.lit(3.0)), 6).alias("radius"))


@query("p28_morph", f"{with_ctes('stops')} SELECT id, {sql_round('lat + (lng * -0.39 - lat) * 0.25', 6)} AS y FROM stops")
def p28(spark, sf):
    return stops(spark, sf).select("id", rounded(F.col("lat") + (F.col("lng") * -0.39 - F.col("lat")) * 0.25, 6).alias("y"))


_FIT = "SELECT min(lng) AS x0, max(lng) AS x1, min(lat) AS y0, max(lat) AS y1 FROM stops"


@query("p29_screen_fit", f"{with_ctes('stops')}, f AS ({_FIT}) SELECT id, {sql_round('(lng - x0) * k', 3)} AS x, {sql_round('(y1 - lat) * k', 3)} AS y FROM stops, (SELECT *, least(640 / (x1 - x0), 480 / (y1 - y0)) AS k FROM f)")
def p29(spark, sf):
    """Fit to a 640 x 480 panel with one scale, north up."""
    s = stops(spark, sf)
    fit = s.agg(F.min("lng").alias("x0"), F.max("lng").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    k = F.least(640 / (F.col("x1") - F.col("x0")), 480 / (F.col("y1") - F.col("y0")))
    return s.crossJoin(F.broadcast(fit)).select("id", rounded((F.col("lng") - F.col("x0")) * k, 3).alias("x"), rounded((F.col("y1") - F.col("lat")) * k, 3).alias("y"))


@query("p30_round_trip", "SELECT o_orderkey, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a + b) / 2 ELSE coalesce(a, b) END AS v FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_totalprice AS DOUBLE) END AS a, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS b FROM orders)")
def p30(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", geo.round_trip(F.when(k % 7 != 0, F.col("o_totalprice").cast("double")), F.when(k % 5 != 0, F.col("o_custkey").cast("double"))).alias("v"))


@query("a12_traffic_summary", f"{with_ctes('readings')} SELECT count(*) AS n, {sql_round('avg(factor)', 6)} AS mean, {sql_round('max(factor)', 6)} AS most FROM readings")
def a12(spark, sf):
    return readings(spark, sf).agg(F.count("*").alias("n"), rounded(F.avg("factor"), 6).alias("mean"), rounded(F.max("factor"), 6).alias("most"))


@query("a13_element_counts", f"{with_ctes('ways')} SELECT highway, count(*) AS n, CAST(sum(len(nodes)) AS BIGINT) AS nodes FROM ways GROUP BY highway")
def a13(spark, sf):
    return ways(spark, sf).groupBy("highway").agg(F.count("*").alias("n"), F.sum(F.size("nodes")).cast("long").alias("nodes"))


@query("s15_slice_names", "SELECT o_orderkey, regexp_extract(f, '^embedding-(drive|transit)-(.+)\\.json$', 1) AS mode, regexp_extract(f, '^embedding-(drive|transit)-(.+)\\.json$', 2) AS slice FROM (SELECT o_orderkey, 'embedding-' || CASE o_orderkey % 3 WHEN 0 THEN 'drive' WHEN 1 THEN 'transit' ELSE 'other' END || '-' || lower(o_orderstatus) || '.json' AS f FROM orders) WHERE regexp_matches(f, '^embedding-(drive|transit)-(.+)\\.json$')")
def s15(spark, sf):
    k = F.col("o_orderkey") % 3
    name = F.concat(F.lit("embedding-"), F.when(k == 0, "drive").when(k == 1, "transit").otherwise("other"), F.lit("-"), F.lower("o_orderstatus"), F.lit(".json"))
    pattern = r"^embedding-(drive|transit)-(.+)\.json$"
    return table(spark, sf, "orders").select("o_orderkey", name.alias("f")).where(F.rlike("f", F.lit(pattern))).select("o_orderkey", F.regexp_extract("f", pattern, 1).alias("mode"), F.regexp_extract("f", pattern, 2).alias("slice"))


@query("s17_payload_stamp", "SELECT p_partkey, substr(sha1('window.EMBEDDING = ' || p_name || ';'), 1, 8) AS stamp, regexp_replace('embedding.js?v=old', 'v=[a-z0-9]+', 'v=' || substr(sha1('window.EMBEDDING = ' || p_name || ';'), 1, 8)) AS page FROM part")
def s17(spark, sf):
    stamp = F.substring(F.sha1(F.concat(F.lit("window.EMBEDDING = "), F.col("p_name"), F.lit(";"))), 1, 8)
    return table(spark, sf, "part").select("p_partkey", stamp.alias("stamp"), F.regexp_replace(F.lit("embedding.js?v=old"), F.lit("v=[a-z0-9]+"), F.concat(F.lit("v="), stamp)).alias("page"))


@query("s18_payload_scan", "SELECT p_partkey, p_size AS size FROM part")
def s18(spark, sf):
    payload = F.concat(F.lit("window.EMBEDDING = "), F.to_json(F.struct(F.col("p_size").alias("size"))), F.lit(";"))
    text = F.regexp_replace(F.regexp_replace(payload, r"^window\.EMBEDDING =\s*", ""), r";\s*$", "")
    return table(spark, sf, "part").select("p_partkey", F.from_json(text, "size int")["size"].alias("size"))


@query("x11_slice_key", "SELECT DISTINCT event_type || ':' || CAST(user_id % 4 AS VARCHAR) AS key FROM events")
def x11(spark, sf):
    return table(spark, sf, "events").select(F.concat_ws(":", "event_type", F.col("user_id") % 4).alias("key")).distinct()


@query("x13_readout", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'drive' ELSE 'transit' END || CASE WHEN o_orderkey % 3 = 0 THEN ', ' || lower(o_orderstatus) ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN ', alternative' ELSE '' END AS sentence FROM orders")
def x13(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.concat_ws(", ", F.when(k % 2 == 0, "drive").otherwise("transit"), F.when(k % 3 == 0, F.lower("o_orderstatus")), F.when(k % 5 == 0, "alternative")).alias("sentence"))


@query("x14_transit_note", "SELECT o_orderkey, strftime(o_orderdate, '%m/%d') || ' 08:30' AS note FROM orders")
def x14(spark, sf):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    return table(spark, sf, "orders").select("o_orderkey", F.concat(F.substring(day, 5, 2), F.lit("/"), F.substring(day, 7, 2), F.lit(" 08:30")).alias("note"))


@query("x18_request_blocks", f"{with_ctes('anchors')} SELECT (id - 1) // 25 AS block, string_agg(CAST(CAST(floor(lat * 10000 + 0.5) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(floor(lng * 10000 + 0.5) AS BIGINT) AS VARCHAR), '|' ORDER BY id) AS points FROM anchors GROUP BY block")
def x18(spark, sf):
    """Points of 25 anchors joined for one request, in units of 1e-4 degrees."""
    at = F.concat_ws(",", rounded(F.col("lat") * 10000), rounded(F.col("lng") * 10000))
    a = anchors(spark, sf).select(F.expr("(id - 1) div 25").alias("block"), "id", at.alias("p"))
    return a.groupBy("block").agg(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("id", "p"))), lambda s: s["p"])).alias("points"))


@query("t5_slice_order", "SELECT slice, mode, row_number() OVER (ORDER BY CASE mode WHEN 'drive' THEN 0 ELSE 1 END, slice <> 'freeflow', slice) AS place FROM (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'drive' ELSE 'transit' END AS mode, CASE WHEN event_type = 'view' THEN 'freeflow' ELSE event_type END AS slice FROM events)")
def t5(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "events").select(F.when(F.col("user_id") % 2 == 0, "drive").otherwise("transit").alias("mode"), F.when(F.col("event_type") == "view", "freeflow").otherwise(F.col("event_type")).alias("slice")).distinct()
    order = Window.orderBy(F.when(F.col("mode") == "drive", 0).otherwise(1), F.col("slice") != "freeflow", "slice")
    return e.select("slice", "mode", F.row_number().over(order).cast("long").alias("place"))
