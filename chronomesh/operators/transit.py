"""Timetables: service days, patterns, transfers, and round-based earliest arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spatial
from .shared import settle

WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")


def active_services(calendar: DataFrame, exceptions: DataFrame, day: str) -> DataFrame:
    """(service_id) that run on day (YYYYMMDD): the calendar, then each service's last exception in file order."""
    runs = F.expr("CASE dayofweek(to_date('%s', 'yyyyMMdd')) %s END" % (day, " ".join(f"WHEN {i + 1} THEN {d}" for i, d in enumerate(WEEKDAYS))))
    regular = calendar.where((F.col("start_date") <= day) & (F.col("end_date") >= day) & (runs == "1")).select("service_id")
    last = exceptions.where(F.col("date") == day).groupBy("service_id").agg(F.max_by("exception_type", "line").alias("kind"))
    added, removed = last.where("kind = '1'").select("service_id"), last.where("kind <> '1'").select("service_id")
    return regular.unionByName(added).distinct().join(removed, "service_id", "left_anti")


def trip_patterns(stop_times: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trips (feed, trip_id, seq, stop, arr, dep) grouped by their sequence of stops within a feed.

    Gives (pattern, trip, pos, stop, arr, dep), trips numbered by their first departure and then
    id; and (pattern, feed, stops, trips). A pattern is named by a hash of feed and stops.
    """
    rows = F.struct("seq", "stop", "arr", "dep")
    trips = stop_times.where("arr is not null and dep is not null").groupBy("feed", "trip_id").agg(F.array_sort(F.collect_list(rows)).alias("s")).where(F.size("s") >= 2)
    named = trips.withColumn("stops", F.col("s.stop")).withColumn("pattern", F.xxhash64("feed", F.col("stops").cast("string")))
    order = Window.partitionBy("pattern").orderBy(F.col("s")[0]["dep"], "trip_id")
    ranked = named.withColumn("trip", F.row_number().over(order) - 1)
    rows = ranked.select("pattern", "trip", F.posexplode("s").alias("pos", "x")).select("pattern", "trip", "pos", "x.stop", "x.arr", "x.dep")
    return rows, named.groupBy("pattern").agg(F.first("feed").alias("feed"), F.first("stops").alias("stops"), F.count("*").alias("trips"))


def near_transfers(stops: DataFrame, km: float = 0.2) -> DataFrame:
    """(a, b, sec) between stops (id, lat, lng) at most km apart, both ways."""
    right = stops.select(F.col("id").alias("b"), F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"))
    pairs = spatial.within(stops, right, km).where(F.col("id") != F.col("b"))
    sec = F.greatest(F.lit(30), F.floor(1.3 * F.col("d") * 1000 / 1.35 + 0.5)).cast("long")
    return pairs.select(F.col("id").alias("a"), "b", sec.alias("sec"))


def declared_seconds(text) -> F.Column:
    """Seconds of a declared transfer: 120 where none is given, at least 30."""
    return F.greatest(F.coalesce(F.nullif(text, F.lit("")).try_cast("long"), F.lit(120)), F.lit(30))


def catches(labels: DataFrame, trips: DataFrame) -> DataFrame:
    """(stop, arr, pattern, pos, trip): the earliest trip of each pattern that can be caught by someone who is at a stop at a time.

    That depends on no source, so each time (arr) at a stop is looked up once, however many sources have it. Departures after a
    stop's last time are one row, and those before its first none; the others and the times are sorted together, so that a
    running minimum from the latest departure on gives each time its trip.
    """
    times = settle(labels.select("stop", "arr").distinct())
    kind = dict(times.dtypes)["arr"]
    span = times.groupBy("stop").agg(F.min("arr").alias("first"), F.max("arr").alias("last"))
    leave = trips.join(span, "stop").where(F.col("dep") >= F.col("first")).groupBy("pattern", "pos", "stop", F.least(F.col("dep").cast(kind), "last").alias("at")).agg(F.min("trip").cast("long").alias("trip"))
    leave = settle(leave)
    met = times.join(leave.select("pattern", "pos", "stop").distinct(), "stop").select("pattern", "pos", "stop", F.col("arr").alias("at"), F.lit(None).cast("long").alias("trip"), F.lit(0).alias("kind"))
    both = met.unionByName(leave.withColumn("kind", F.lit(1)))
    later = Window.partitionBy("pattern", "pos", "stop").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    caught = both.withColumn("next", F.min("trip").over(later)).where("kind = 0 and next is not null")
    return caught.select("stop", F.col("at").alias("arr"), "pattern", "pos", F.col("next").alias("trip"))


def board(labels: DataFrame, trips: DataFrame, caught: DataFrame | None = None) -> DataFrame:
    """(source, pattern, pos, trip): the earliest trip that can be caught at each stop of each pattern; caught are the catches of labels, if known."""
    found = catches(labels, trips) if caught is None else caught
    return labels.join(found, ["stop", "arr"]).groupBy("source", "pattern", "pos").agg(F.min("trip").alias("trip"))


def ride(boarded: DataFrame, trips: DataFrame) -> DataFrame:
    """(source, stop, arr): arrivals further along, by the least trip boarded at any earlier stop."""
    places = trips.select("pattern", F.col("pos").alias("to")).distinct()
    on = boarded.join(places, "pattern").where("pos < to").groupBy("source", "pattern", F.col("to").alias("pos")).agg(F.min("trip").alias("trip"))
    return on.join(trips.select("pattern", "pos", "trip", "stop", "arr"), ["pattern", "pos", "trip"]).groupBy("source", "stop").agg(F.min("arr").alias("arr"))


def ridden(labels: DataFrame, trips: DataFrame) -> DataFrame:
    """(source, stop, arr): where a vehicle takes those of labels. Only trips that someone catches are met; labels are dealt by source once, and the rest is done there."""
    caught = settle(catches(labels, trips))
    few = settle(trips.join(caught.select("pattern", "trip").distinct(), ["pattern", "trip"]))
    return ride(board(labels.repartition("source"), trips, caught), few)


def improve(labels: DataFrame, new: DataFrame, step: int) -> DataFrame:
    """labels (source, stop, arr, step) after new (source, stop, arr): step is that of the last strict improvement."""
    none = F.lit(None)
    both = labels.select("source", "stop", "arr", F.col("arr").alias("old"), "step").unionByName(new.select("source", "stop", "arr", none.cast("long").alias("old"), none.cast("int").alias("step")))
    best = both.groupBy("source", "stop").agg(F.min("arr").alias("arr"), F.min("old").alias("old"), F.max("step").alias("step"))
    return best.select("source", "stop", "arr", F.when(F.col("old").isNull() | (F.col("arr") < F.col("old")), F.lit(step)).otherwise(F.col("step")).alias("step"))


def on_foot(labels: DataFrame, foot: DataFrame, step: int) -> DataFrame:
    """One hop from the stops that this step improved."""
    return labels.where(F.col("step") == step).join(foot, F.col("stop") == F.col("a")).select("source", F.col("b").alias("stop"), (F.col("arr") + F.col("sec")).alias("arr"))


def first_labels(access: DataFrame) -> DataFrame:
    return access.groupBy("source", "stop").agg(F.min("arr").cast("long").alias("arr")).withColumn("step", F.lit(0))


def arrival_steps(trips: DataFrame, foot: DataFrame, access: DataFrame, rounds: int = 4) -> list[DataFrame]:
    """Labels (source, stop, arr, step) after each step: 0 is access, odd steps walk, even ones ride.

    A round boards from the labels of the round before, rides, and then walks one hop from
    what riding improved, so at most `rounds` vehicles are taken and walks don't chain.
    """
    steps = [settle(first_labels(access))]
    steps.append(settle(improve(steps[0], on_foot(steps[0], foot, 0), 1)))
    for step in range(2, 2 * rounds + 2, 2):
        fresh = steps[-1].where(F.col("step") >= step - 2)
        if fresh.isEmpty():
            break
        steps.append(settle(improve(steps[-1], ridden(fresh.select("source", "stop", "arr"), trips), step)))
        steps.append(settle(improve(steps[-1], on_foot(steps[-1], foot, step), step + 1)))
    return steps


def earliest_arrivals(trips: DataFrame, foot: DataFrame, access: DataFrame, rounds: int = 4) -> DataFrame:
    """(source, stop, arr) for all sources at once; access is (source, stop, arr)."""
    return arrival_steps(trips, foot, access, rounds)[-1].select("source", "stop", "arr")


def egress(arrivals: DataFrame, access: DataFrame, walks: DataFrame) -> DataFrame:
    """(i, j, seconds): the least of riding to a stop near j and walking all the way.

    arrivals are (i, stop, seconds), access (j, stop, seconds), walks (i, j, seconds).
    """
    rides = arrivals.join(access.withColumnRenamed("seconds", "last"), "stop").groupBy("i", "j").agg(F.min(F.col("seconds") + F.col("last")).alias("ride"))
    both = rides.join(walks.withColumnRenamed("seconds", "walk"), ["i", "j"], "full_outer")
    return both.select("i", "j", F.least("ride", "walk").alias("seconds"))


LEG = "array<struct<kind:string,start:bigint,stop:bigint,pattern:bigint,trip:bigint>>"


def journeys(trips: DataFrame, foot: DataFrame, access: DataFrame, targets: DataFrame, rounds: int = 4) -> DataFrame:
    """(source, target, arr, legs) of targets (source, target): how each was reached first. No row where a target is not reached.

    Walks back over the steps: what a step of riding improved was reached by a trip that was boarded at a stop as
    it was labelled before the round, what a step of walking improved by a hop from what was ridden to just before. Of several
    rides the one of smallest pattern, trip and boarding place counts, of several hops the one from the smallest stop.
    """
    steps = arrival_steps(trips, foot, access, rounds)
    history = steps[0]
    for step, labels in enumerate(steps[1:], 1):
        history = history.unionByName(labels.where(F.col("step") == step))
    history = settle(history)
    arrive = trips.select("pattern", "trip", F.col("pos").alias("last"), F.col("stop").alias("at"), "arr")
    leave = trips.select("pattern", "trip", "pos", F.col("stop").alias("from"), "dep")
    before = history.select("source", F.col("stop").alias("from"), F.col("arr").alias("then"), F.col("step").alias("past"))
    ends = steps[-1].withColumnRenamed("stop", "target")
    todo = settle(targets.join(ends, ["source", "target"]).select("source", "target", F.col("arr").alias("end"), F.col("target").alias("at"), "arr", "step", F.array().cast(LEG).alias("legs")))
    leg = lambda kind, pattern, trip: F.struct(F.lit(kind).alias("kind"), F.col("from").alias("start"), F.col("at").alias("stop"), pattern.cast("long").alias("pattern"), trip.cast("long").alias("trip"))
    none, found = F.lit(None), []
    while True:  # a step back lowers the step, so there are as many as steps at most
        found.append(todo.where("step = 0").select("source", "target", F.col("end").alias("arr"), "legs"))
        open_ = todo.where("step > 0")
        if open_.isEmpty():
            break
        # What few ends ask for is written before it meets a large table again, so that neither trips nor labels are moved for it.
        left = settle(open_.where("step % 2 = 0").join(arrive, ["at", "arr"]))
        left = settle(left.join(leave, ["pattern", "trip"]).where("pos < last"))
        rode = left.join(before, ["source", "from"]).where("past < step and then <= dep")
        rode = rode.select("source", "target", "end", "legs", "from", "then", "past", leg("ride", F.col("pattern"), F.col("trip")).alias("leg"), F.array("pattern", "trip", "pos", -F.col("past")).alias("rank"))
        hop = open_.where("step % 2 = 1").join(foot.select(F.col("a").alias("from"), F.col("b").alias("at"), "sec"), "at").join(before, ["source", "from"]).where("past = step - 1 and then + sec = arr")
        hop = hop.select("source", "target", "end", "legs", "from", "then", "past", leg("foot", none, none).alias("leg"), F.array("from").alias("rank"))
        both = rode.withColumn("rank", F.col("rank").cast("array<long>")).unionByName(hop.withColumn("rank", F.col("rank").cast("array<long>")))
        back = both.groupBy("source", "target").agg(F.min_by(F.struct("end", "legs", "from", "then", "past", "leg"), "rank").alias("s"))
        todo = settle(back.select("source", "target", "s.end", F.col("s.from").alias("at"), F.col("s.then").alias("arr"), F.col("s.past").alias("step"), F.concat(F.array("s.leg"), "s.legs").alias("legs")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def leg_stops(journeys: DataFrame, trips: DataFrame, stops: DataFrame) -> DataFrame:
    """(source, target, leg, kind, pattern, points): the stops that each leg of journeys passes, with their places (stop, lat, lng).

    A ride takes the first place of its trip that is its start's and the first after it that is its end's. stops are (id, lat, lng).
    """
    legs = journeys.select("source", "target", F.posexplode("legs").alias("leg", "l")).select("source", "target", "leg", "l.*")
    keys = ["source", "target", "leg", "kind", "pattern"]
    calls = trips.select("pattern", "trip", "pos", F.col("stop").alias("call"))
    on = legs.where("kind = 'ride'").join(calls, ["pattern", "trip"])
    leave = on.groupBy(*keys, "trip", "start", "stop").agg(F.min(F.when(F.col("call") == F.col("start"), F.col("pos"))).alias("a"))
    met = leave.join(calls, ["pattern", "trip"]).where("pos >= a")
    upto = Window.partitionBy(*keys)
    ends = met.withColumn("z", F.min(F.when((F.col("call") == F.col("stop")) & (F.col("pos") > F.col("a")), F.col("pos"))).over(upto)).where("pos <= z")
    walked = legs.where("kind = 'foot'").select(*keys, F.posexplode(F.array("start", "stop")).alias("pos", "call"))
    rows = ends.select(*keys, F.col("pos").cast("long").alias("pos"), "call").unionByName(walked.select(*keys, F.col("pos").cast("long").alias("pos"), "call"))
    placed = rows.join(stops.select(F.col("id").alias("call"), "lat", "lng"), "call")
    points = F.transform(F.array_sort(F.collect_list(F.struct("pos", "call", "lat", "lng"))), lambda x: F.struct(x["call"].alias("stop"), x["lat"].alias("lat"), x["lng"].alias("lng")))
    return placed.groupBy(*keys).agg(points.alias("points"))


def stop_access(anchors: DataFrame, walk: DataFrame, stops: DataFrame, nodes: DataFrame, cutoff: float = 720.0, gap_m: float = 300.0) -> DataFrame:
    """(anchor, stop, seconds): stops within a walk of `cutoff` seconds of each anchor.

    anchors are (id, node): already on the graph; walk is (src, dst, w) in seconds; stops (id, lat, lng) are snapped to
    the nearest of nodes (node, r_lat, r_lng) and dropped beyond `gap_m`. The cutoff holds for the walk on the graph, before
    the gap between the stop and its node is added. Seconds are whole.
    """
    from ..functions.geo import haversine_m
    from .graph import WALK_MS, sssp

    at = spatial.snap(stops, nodes, haversine_m).where(F.col("d") <= gap_m).select(F.col("id").alias("stop"), "node", (F.col("d") / WALK_MS).alias("gap"))
    at = settle(at)
    from_ = anchors.select(F.col("id").alias("anchor"), F.col("node").alias("source"))
    labels = sssp(walk, from_.select("source").distinct(), cutoff=cutoff, targets=at.select("node"))
    whole = F.floor(F.col("dist") + F.col("gap") + 0.5).cast("long")
    return labels.join(at, "node").join(from_, "source").select("anchor", "stop", whole.alias("seconds"))
