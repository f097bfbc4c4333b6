"""Transit feeds: from zip archives to one timetable of all of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import gtfs_seconds
from ..operators import transit
from ..operators.shared import settle
from .files import csv_table, lines_of, zip_lines

#: Degrees around the box in which a trip must have a stop.
PAD = 0.05


@dataclass
class Timetable:
    stops: DataFrame  # id, name, lat, lng; ids carry their feed
    trips: DataFrame  # pattern, trip, pos, stop, arr, dep
    patterns: DataFrame  # pattern, feed, stops, trips
    transfers: DataFrame  # a, b, sec


def load(spark: SparkSession, path: str | DataFrame, day: str, box: tuple[float, float, float, float] | None = None) -> Timetable:
    """Every feed under path, or of archives (path, content), on a service day (YYYYMMDD); box is south, north, west, east.

    All stops are kept; a trip is kept if it has two known stops with both times, and any of its
    stops is in the padded box. Calendars, exceptions and transfers may be missing.
    """
    lines = settle(zip_lines(spark, path) if isinstance(path, str) else lines_of(path))
    named = lambda c: F.concat_ws(":", "feed", c)
    stops = csv_table(lines, "stops.txt", ["stop_id", "stop_name", "stop_lat", "stop_lon"], 2)
    stops = stops.select(named("stop_id").alias("id"), F.col("stop_name").alias("name"), F.col("stop_lat").try_cast("double").alias("lat"), F.col("stop_lon").try_cast("double").alias("lng")).where("lat is not null and lng is not null")
    calendar = csv_table(lines, "calendar.txt", ["service_id", "start_date", "end_date", *transit.WEEKDAYS], 3).withColumn("service_id", named("service_id"))
    dates = csv_table(lines, "calendar_dates.txt", ["service_id", "date", "exception_type"], 3).withColumn("service_id", named("service_id"))
    live = transit.active_services(calendar, dates, day)
    trips = csv_table(lines, "trips.txt", ["trip_id", "service_id"], 3).select("feed", "trip_id", named("service_id").alias("service_id")).join(live, "service_id", "left_semi")
    times = csv_table(lines, "stop_times.txt", ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"], 5).join(trips.select("feed", "trip_id"), ["feed", "trip_id"], "left_semi")
    rows = times.select("feed", "trip_id", F.col("stop_sequence").try_cast("int").alias("seq"), named("stop_id").alias("stop"), gtfs_seconds(F.col("arrival_time")).alias("arr"), gtfs_seconds(F.col("departure_time")).alias("dep"))
    rows = rows.where("arr is not null and dep is not null").join(stops.select(F.col("id").alias("stop"), "lat", "lng"), "stop")
    if box is not None:
        south, north, west, east = box
        near = (F.col("lat") > south - PAD) & (F.col("lat") < north + PAD) & (F.col("lng") > west - PAD) & (F.col("lng") < east + PAD)
        rows = rows.join(rows.where(near).select("feed", "trip_id").distinct(), ["feed", "trip_id"], "left_semi")
    timed, patterns = transit.trip_patterns(rows.select("feed", "trip_id", "seq", "stop", "arr", "dep"))
    known = stops.select("id")
    said = csv_table(lines, "transfers.txt", ["from_stop_id", "to_stop_id", "min_transfer_time"], 2)
    said = said.select(named("from_stop_id").alias("a"), named("to_stop_id").alias("b"), transit.declared_seconds(F.col("min_transfer_time")).alias("sec"))
    said = said.join(known.withColumnRenamed("id", "a"), "a", "left_semi").join(known.withColumnRenamed("id", "b"), "b", "left_semi")
    return Timetable(stops, timed, patterns, said.unionByName(transit.near_transfers(stops.select("id", "lat", "lng"))))
