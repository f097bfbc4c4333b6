"""Domain relations out of the driver's tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import CLASS_MPH, clamp_factor, rounded

CLASSES = (*CLASS_MPH, "footway", "service")
SPEED_TAGS = ("30 mph", "30 km/h", "55;45", "none", None, "0", "12.5")
ONEWAY_TAGS = ("yes", "no", "-1", None, "true", "1")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def placed(key: str, df: DataFrame, name: str = "id") -> DataFrame:
    k = F.col(key).cast("long")
    return df.select(k.alias(name), (47.5 + k * 7919 % 2340 / F.lit(1e4)).alias("lat"), (-122.43 + k * 104729 % 1900 / F.lit(1e4)).alias("lng"))


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    return placed("s_suppkey", table(spark, sf, "supplier"))


def stops(spark: SparkSession, sf: str) -> DataFrame:
    return placed("c_custkey", table(spark, sf, "customer"))


def readings(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    mean = table(spark, sf, "events").groupBy("user_id").agg(rounded(F.avg("value"), 4).alias("v"))
    return mean.select(u.alias("reading"), (47.5 + u * 6151 % 2340 / F.lit(1e4)).alias("r_lat"), (-122.43 + u * 3571 % 1900 / F.lit(1e4)).alias("r_lng"), clamp_factor(F.col("v") / 60).alias("factor"))


def pick(values, at) -> F.Column:
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), at.cast("int"))


def ways(spark: SparkSession, sf: str) -> DataFrame:
    """(way, nodes, highway, maxspeed, oneway): each order is a way through its lines' suppliers."""
    lines = table(spark, sf, "lineitem")
    seq = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    way = lines.groupBy(F.col("l_orderkey").alias("way")).agg(F.transform(F.array_sort(F.collect_list(seq)), lambda s: s["l_suppkey"]).alias("nodes"))
    k = F.col("way")
    return way.withColumns({"highway": pick(CLASSES, F.floor(k / 8) % len(CLASSES)), "maxspeed": pick(SPEED_TAGS, F.floor(k / 8) % len(SPEED_TAGS)), "oneway": pick(ONEWAY_TAGS, F.floor(k / 16) % len(ONEWAY_TAGS))})


def links(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst, w): a sparse directed graph on the parts, with parallel edges."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("p"), F.col("p_size").alias("s"))
    n = part.agg(F.count("*").alias("n"))
    each = F.explode(F.array(*(F.struct(*(F.lit(v).alias(x) for v, x in zip(t, "abc", strict=True))) for t in ((1, 1, 3), (7, 5, 9), (13, 11, 20)))))
    e = part.crossJoin(F.broadcast(n)).select("p", "s", "n", each.alias("t"))
    return e.select("p", ((F.col("p") * F.col("t.a") + F.col("t.b")) % F.col("n")).alias("q"), (F.col("s") + F.col("t.c")).cast("long").alias("w")).select(F.col("p").alias("src"), F.col("q").alias("dst"), "w").where("dst > 0")


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst): chains of a hundred parts with one back edge each."""
    part = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("p"))
    most = part.agg(F.max("p").alias("m"))
    p = part.crossJoin(F.broadcast(most))
    on = p.where("p < m").select(F.col("p").alias("src"), (F.col("p") + 1).alias("dst"))
    back = p.where("p % 100 = 10 + 4 * (p div 100)").select(F.col("p").alias("src"), F.expr("100 * (p div 100)").alias("dst")).where("dst > 0")
    return on.unionByName(back)


def with_count(spark: SparkSession, sf: str, df: DataFrame) -> DataFrame:
    """df with n, the number of suppliers: they stand for stops as well, numbered from 0."""
    return df.crossJoin(F.broadcast(table(spark, sf, "supplier").agg(F.count("*").alias("n"))))


def timetable(spark: SparkSession, sf: str) -> DataFrame:
    """(pattern, trip, pos, stop, arr, dep): every order is a six-stop trip on one of fifty patterns."""
    k = F.col("o_orderkey")
    o = with_count(spark, sf, table(spark, sf, "orders").select((k % 50).alias("p"), F.expr("o_orderkey div 50").alias("trip")))
    x = o.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(5))))
    arr = F.expr("28800 + trip * 60 + (p % 13) * 40 + pos * (90 + p % 60)").cast("long")
    return x.select(F.col("p").alias("pattern"), F.col("trip").cast("long").alias("trip"), F.col("pos").cast("long").alias("pos"), F.expr("(p * 17 + pos * (3 + p % 5)) % n").cast("long").alias("stop"), arr.alias("arr"), (arr + 10).alias("dep"))


def seeds(spark: SparkSession, sf: str, step: int, near: int) -> DataFrame:
    """(s, k, stop, n): each supplier as a place s, and the stops near it."""
    s = with_count(spark, sf, table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("s")))
    return s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(near - 1)))).withColumn("stop", ((F.col("s") * step + F.col("k")) % F.col("n")).cast("long"))


def access(spark: SparkSession, sf: str) -> DataFrame:
    return seeds(spark, sf, 5, 2).select(F.col("s").alias("source"), "stop", (28800 + 120 * F.col("k")).cast("long").alias("arr"))


def foot_edges(spark: SparkSession, sf: str) -> DataFrame:
    return seeds(spark, sf, 1, 1).select(F.col("s").alias("a"), ((F.col("s") + 1) % F.col("n")).cast("long").alias("b"), F.lit(60).cast("long").alias("sec"))


def egress_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    near = seeds(spark, sf, 7, 3).select(F.col("s").alias("j"), "stop", (100 + 50 * F.col("k")).cast("long").alias("seconds"))
    walks = seeds(spark, sf, 1, 4).select(F.col("s").alias("i"), F.col("stop").alias("j"), (900 * F.col("k")).cast("long").alias("seconds"))
    return near, walks


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """(supplier, source): the node of the part graph that each supplier is at."""
    n = table(spark, sf, "part").agg(F.count("*").alias("n"))
    s = table(spark, sf, "supplier").crossJoin(F.broadcast(n))
    return s.select(F.col("s_suppkey").cast("long").alias("supplier"), ((F.col("s_suppkey") * 37) % F.col("n")).cast("long").alias("source"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """(source, target): every customer asks for a route from a supplier's node to a node of the part graph."""
    s = with_count(spark, sf, table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("c")))
    n = table(spark, sf, "part").agg(F.count("*").alias("parts"))
    at = s.crossJoin(F.broadcast(n)).select((F.col("c") % F.col("n")).alias("supplier"), ((F.col("c") * 7919) % F.col("parts")).alias("target"))
    return at.join(sources(spark, sf), "supplier").select("source", "target").distinct()


def _values(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _at(key: str) -> str:
    return f"47.5 + ({key} * 7919 % 2340) / 1e4 AS lat, -122.43 + ({key} * 104729 % 1900) / 1e4 AS lng"


CTE = {
    "anchors": f"SELECT CAST(s_suppkey AS BIGINT) AS id, {_at('s_suppkey')} FROM supplier",
    "stops": f"SELECT CAST(c_custkey AS BIGINT) AS id, {_at('c_custkey')} FROM customer",
    "readings": "SELECT reading, r_lat, r_lng, CASE WHEN v / 60 < 1 THEN 1.0 ELSE least(v / 60, 4.0) END AS factor FROM (SELECT user_id AS reading, 47.5 + (user_id * 6151 % 2340) / 1e4 AS r_lat, -122.43 + (user_id * 3571 % 1900) / 1e4 AS r_lng, floor(avg(value) * 10000.0 + 0.5) / 10000.0 AS v FROM events GROUP BY user_id)",
    "ways": f"""SELECT way, nodes, ({_values(CLASSES)})[(way // 8) % {len(CLASSES)} + 1] AS highway, ({_values(SPEED_TAGS)})[(way // 8) % {len(SPEED_TAGS)} + 1] AS maxspeed, ({_values(ONEWAY_TAGS)})[(way // 16) % {len(ONEWAY_TAGS)} + 1] AS oneway
      FROM (SELECT l_orderkey AS way, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nodes FROM lineitem GROUP BY l_orderkey)""",
    "links": "SELECT p_partkey AS src, (p_partkey * a + b) % n AS dst, CAST(p_size + c AS BIGINT) AS w FROM part, (SELECT count(*) AS n FROM part), (VALUES (1, 1, 3), (7, 5, 9), (13, 11, 20)) AS t(a, b, c) WHERE (p_partkey * a + b) % n > 0",
    "blocks": "SELECT p_partkey AS src, p_partkey + 1 AS dst FROM part WHERE p_partkey < (SELECT max(p_partkey) FROM part) UNION ALL SELECT p_partkey, 100 * (p_partkey // 100) FROM part WHERE p_partkey % 100 = 10 + 4 * (p_partkey // 100) AND p_partkey >= 100",
    "timetable": """SELECT p AS pattern, trip, pos, (p * 17 + pos * (3 + p % 5)) % n AS stop, 28800 + trip * 60 + (p % 13) * 40 + pos * (90 + p % 60) AS arr, 28810 + trip * 60 + (p % 13) * 40 + pos * (90 + p % 60) AS dep
      FROM (SELECT o_orderkey % 50 AS p, o_orderkey // 50 AS trip FROM orders), range(0, 6) AS r(pos), (SELECT count(*) AS n FROM supplier)""",
    "foot": "SELECT s_suppkey AS a, (s_suppkey + 1) % n AS b, CAST(60 AS BIGINT) AS sec FROM supplier, (SELECT count(*) AS n FROM supplier)",
    "access": "SELECT s_suppkey AS source, (s_suppkey * 5 + k) % n AS stop, CAST(28800 + 120 * k AS BIGINT) AS arr FROM supplier, range(0, 2) AS b(k), (SELECT count(*) AS n FROM supplier)",
    "egress": "SELECT s_suppkey AS j, (s_suppkey * 7 + k) % n AS stop, CAST(100 + 50 * k AS BIGINT) AS last FROM supplier, range(0, 3) AS b(k), (SELECT count(*) AS n FROM supplier)",
    "walks": "SELECT s_suppkey AS i, (s_suppkey + k) % n AS j, CAST(900 * k AS BIGINT) AS walk FROM supplier, range(0, 4) AS b(k), (SELECT count(*) AS n FROM supplier)",
    "sources": "SELECT CAST(s_suppkey AS BIGINT) AS supplier, CAST((s_suppkey * 37) % n AS BIGINT) AS source FROM supplier, (SELECT count(*) AS n FROM part)",
    "requests": "SELECT DISTINCT source, CAST((c_custkey * 7919) % parts AS BIGINT) AS target FROM customer, (SELECT count(*) AS n FROM supplier), (SELECT count(*) AS parts FROM part), sources WHERE supplier = c_custkey % n",
}


def with_ctes(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS MATERIALIZED ({CTE[n]})" for n in names)
