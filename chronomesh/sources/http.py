"""HTTP sources: street and water documents, timetable archives, congestion readings, matrices.

Requests go through `fetch`, a function from (url, body or None) to (status, headers, bytes); tests and
boxes without a network hand in their own. Rates hold for the whole job: its tasks take turns
by the clock, so a provider sees one rate however many of them ask.
"""

from __future__ import annotations

import json
import math
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not

from ..functions.geo import CLASS_MPH

Fetch = Callable[[str, bytes | None], tuple[int, dict, bytes]]


def fetch(url: str, body: bytes | None = None) -> tuple[int, dict, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=body), timeout=120) as answer:
            return answer.status, dict(answer.headers), answer.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


class Permanent(Exception):
    """An answer that asking again won't change."""


def retry(ask: Callable[[], object], attempts: int = 3, backoff_s: float = 0.3, sleep=time.sleep):
    """The first answer; waits grow in line with the attempts, and a permanent error ends them."""
    for n in range(1, attempts + 1):
        try:
            return ask()
        except Permanent:
            raise
        except Exception:
            if n == attempts:
                raise
            sleep(backoff_s * n)


class Pace:
    """Lets calls through at most `qps` times a second."""

    def __init__(self, qps: float, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.clock, self.sleep, self.next = 1 / qps, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


class Turns:
    """Lets the calls of all of a job's tasks through at most `qps` times a second.

    Time is cut into slots of 1 / qps seconds, the same for all tasks, and task k of n has every n-th slot from the k-th on. A call starts where
    a slot does, and a slot is used once, so no two calls of the job are closer than a slot, whenever tasks begin, wait or begin anew.
    Executors must have the same time of day, as clusters do.
    """

    def __init__(self, qps: float, task: int, tasks: int, clock=time.time, sleep=time.sleep):
        self.qps, self.task, self.tasks, self.clock, self.sleep, self.used = qps, task, tasks, clock, sleep, -1

    def wait(self) -> None:
        slot = max(math.floor(self.clock() * self.qps), self.used) + 1
        slot += (self.task - slot) % self.tasks
        self.used = slot
        while (now := self.clock()) < slot / self.qps:
            self.sleep(slot / self.qps - now)


def own_turns(qps: float, tasks: int) -> Turns:
    """The turns of the task that this runs in."""
    context = TaskContext.get()
    return Turns(qps, context.partitionId() if context else 0, tasks)


def first_answer(urls: Iterable[str], body: bytes | None, ask: Fetch = fetch) -> bytes:
    """The body of the first of several endpoints that answers with something."""
    failures = []
    for url in urls:
        try:
            status, _, data = ask(url, body)
            if status == 200 and data:
                return data
            failures.append(f"{url}: status {status}, {len(data)} bytes")
        except OSError as e:
            failures.append(f"{url}: {e}")
    raise OSError("; ".join(failures) or "no endpoint")


def _box(south: float, north: float, west: float, east: float) -> str:
    return f"{south},{west},{north},{east}"


def road_query(south: float, north: float, west: float, east: float) -> str:
    """Drivable ways without private ones, and their nodes; the filters run on the server."""
    classes = "|".join(CLASS_MPH)
    return f'[out:json][timeout:300];way["highway"~"^({classes})$"]["access"!~"^(no|private)$"]({_box(south, north, west, east)});(._;>;);out qt;'


def water_query(south: float, north: float, west: float, east: float) -> str:
    box = _box(south, north, west, east)
    kinds = [f'{what}["{key}"="{value}"]({box});' for key, value, whats in (("natural", "water", ("way", "relation")), ("waterway", "riverbank", ("way", "relation")), ("natural", "coastline", ("way",))) for what in whats]
    return f"[out:json][timeout:300];({''.join(kinds)});out geom;"


class OverpassSource(DataSource):
    """spark.read.format("overpass").option("query", ...).option("endpoints", "url url ...").load(): one JSON element a row."""

    @classmethod
    def name(cls) -> str:
        return "overpass"

    def schema(self) -> str:
        return "element string"

    def reader(self, schema):
        return OverpassReader(self.options)


class OverpassReader(DataSourceReader):
    """Asks each endpoint in turn; an answer without elements is an error."""

    def __init__(self, options):
        self.query, self.endpoints = options["query"], options["endpoints"].split()

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        body = urllib.parse.urlencode({"data": self.query}).encode()
        elements = json.loads(first_answer(self.endpoints, body))["elements"]
        if not elements:
            raise ValueError("the answer has no elements")
        for e in elements:
            yield (json.dumps(e),)


#: Tags of a way that are columns of the source, and so can be filtered on by the server.
WAY_TAGS = ("highway", "access", "maxspeed", "oneway", "name")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def tag_filter(f: Filter) -> str | None:
    """What the server calls a condition on a tag, with the same answer for ways without that tag; None if it has no word for it."""
    inner = f.child if isinstance(f, Not) else f
    if not hasattr(inner, "attribute") or len(inner.attribute) != 1 or inner.attribute[0] not in WAY_TAGS:
        return None
    key = json.dumps(inner.attribute[0])
    one = lambda value, sign: f"[{key}{sign}{json.dumps(value, ensure_ascii=False)}]"
    among = lambda values, sign: one(f"^({'|'.join(map(re.escape, sorted(values)))})$", sign)
    there, absent = f"[{key}]", f"[!{key}]"
    plain = isinstance(f, Filter) and inner is f
    if isinstance(inner, IsNull | IsNotNull):
        return there if plain == isinstance(inner, IsNotNull) else absent
    if isinstance(inner, EqualNullSafe) and isinstance(inner.value, str):
        return one(inner.value, "=" if plain else "!=")
    if isinstance(inner, EqualTo) and isinstance(inner.value, str):  # unknown is not unequal
        return one(inner.value, "=") if plain else there + one(inner.value, "!=")
    if isinstance(inner, In) and inner.value and all(isinstance(v, str) for v in inner.value):
        return among(inner.value, "~") if plain else there + among(inner.value, "!~")
    return None


class OverpassWays(DataSource):
    """spark.read.format("overpass_ways"): the ways of a box, a partition a tile of it; conditions on tags run on the server.

    Options: endpoints, south, north, west, east, and tiles, the number of rows and columns of tiles. A way that lies in several
    tiles is a row of each. A tile without ways has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "overpass_ways"

    def schema(self) -> str:
        return "id long, nodes array<long>, " + ", ".join(f"{t} string" for t in WAY_TAGS)

    def reader(self, schema):
        return OverpassWaysReader(self.options)


class Tile(InputPartition):
    def __init__(self, south: float, north: float, west: float, east: float):
        self.box = south, north, west, east


class OverpassWaysReader(DataSourceReader):
    def __init__(self, options):
        self.endpoints, self.tiles = options["endpoints"].split(), int(options.get("tiles", 1))
        self.box = tuple(float(options[k]) for k in ("south", "north", "west", "east"))
        self.filters: list[str] = []

    def pushFilters(self, filters):
        for f in filters:
            said = tag_filter(f)
            if said is None:
                yield f
            else:
                self.filters.append(said)

    def partitions(self):
        south, north, west, east = self.box
        edge = lambda a, b, k: a + (b - a) * k / self.tiles if k < self.tiles else b
        return [Tile(edge(south, north, y), edge(south, north, y + 1), edge(west, east, x), edge(west, east, x + 1)) for y in range(self.tiles) for x in range(self.tiles)]

    def read(self, partition):
        text = f"[out:json][timeout:300];way{''.join(self.filters)}({_box(*partition.box)});out qt;"
        answer = first_answer(self.endpoints, urllib.parse.urlencode({"data": text}).encode())
        for e in json.loads(answer)["elements"]:
            tags = e.get("tags", {})
            yield (e["id"], e.get("nodes", []), *(tags.get(t) for t in WAY_TAGS))


def overpass_ways(spark, endpoints: Iterable[str], south: float, north: float, west: float, east: float, tiles: int = 1) -> DataFrame:
    """Ways of a box as the source gives them. Turns the session's setting on by which conditions reach Python sources."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(OverpassWays)
    box = {"south": south, "north": north, "west": west, "east": east}
    return spark.read.format("overpass_ways").options(endpoints=" ".join(endpoints), tiles=str(tiles), **{k: repr(v) for k, v in box.items()}).load()


def public_roads(ways: DataFrame) -> DataFrame:
    """Ways of a drivable class whose access tag, if they have one, does not forbid; a way of several tiles once."""
    open_ = ~F.col("access").eqNullSafe("no") & ~F.col("access").eqNullSafe("private")
    return ways.where(F.col("highway").isin(*CLASS_MPH) & open_).dropDuplicates(["id"])


def kept(df_of: Callable[[], DataFrame], spark, folder: str, force: bool = False) -> DataFrame:
    """What df_of gives, written to a folder once and read from there afterwards; force asks again."""
    from .files import exists

    if force or not exists(spark, f"{folder}/_SUCCESS"):
        df_of().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def overpass(spark, query: str, endpoints: Iterable[str], folder: str, force: bool = False) -> DataFrame:
    """(element) of an Overpass query, one JSON text a row, kept in a folder."""
    spark.dataSource.register(OverpassSource)
    return kept(lambda: spark.read.format("overpass").option("query", query).option("endpoints", " ".join(endpoints)).load(), spark, folder, force)


def feed_archives(spark, feeds: dict[str, list[str]], folder: str, force: bool = False, ask: Fetch = fetch) -> DataFrame:
    """(path, content) of timetable archives, kept in a folder: each feed from the first of its mirrors that answers with a zip archive."""

    def run(batches):
        for batch in batches:
            for name, urls in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                failures = []
                for url in urls:
                    try:
                        data = first_answer([url], None, ask)
                        if data[:2] == b"PK":
                            break
                        failures.append(f"{url}: no archive")
                    except OSError as e:
                        failures.append(str(e))
                else:
                    raise OSError("; ".join(failures) or f"no mirror of {name}")
                yield pa.RecordBatch.from_arrays([pa.array([f"{name}.zip"]), pa.array([data], pa.binary())], ["path", "content"])

    rows = spark.createDataFrame(sorted(feeds.items()), "name string, urls array<string>")
    return kept(lambda: rows.repartition(len(feeds)).mapInArrow(run, "path string, content binary"), spark, folder, force)


def flow_reading(status: int, headers: dict, data: bytes, sleep=time.sleep, closure: float = 1.0) -> tuple[float, float | None, float | None]:
    """(factor, current, free flow) of one answer of a flow service.

    No road near the point (400) is free flow; too many requests (429) are asked again after the pause that
    the answer names. A closed road counts as `closure`, by default like a free one.
    """
    if status == 400:
        raise Permanent("no road near this point")
    if status == 429:
        sleep(float(headers.get("retry-after") or 1))
        raise OSError("too many requests")
    if status != 200:
        raise OSError(f"status {status}")
    flow = json.loads(data).get("flowSegmentData")
    if not flow:
        return 1.0, None, None
    if flow.get("roadClosure"):
        return closure, 0.0, flow.get("freeFlowSpeed")
    free = flow.get("freeFlowTravelTime")
    ratio = flow["currentTravelTime"] / free if free else 1.0
    return min(max(ratio, 1.0), 4.0), flow.get("currentSpeed"), flow.get("freeFlowSpeed")


def flow_readings(points: DataFrame, url: str, tasks: int = 4, qps: float = 4.0, ask: Fetch = fetch) -> DataFrame:
    """(id, lat, lng, factor, current_kmh, freeflow_kmh, status) of points (id, lat, lng); url has {lat} and {lng}.

    `tasks` tasks ask at once, together qps times a second at most.

    Points that fail are free flow, and status says why: it is 'ok', 'no road', or what went wrong.
    """

    def run(batches):
        pace = own_turns(qps, tasks)
        for batch in batches:
            rows = []
            for lat, lng in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):

                def one(lat=lat, lng=lng):
                    pace.wait()
                    return flow_reading(*ask(url.format(lat=lat, lng=lng), None))

                try:
                    rows.append((*retry(one), "ok"))
                except Permanent:
                    rows.append((1.0, None, None, "no road"))
                except Exception as e:  # one sample of many: it stays at free flow
                    rows.append((1.0, None, None, f"{type(e).__name__}: {e}"[:200]))
            kinds = (pa.float64(), pa.float64(), pa.float64(), pa.string())
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["id", "lat", "lng", "factor", "current_kmh", "freeflow_kmh", "status"])

    return points.select(F.col("id").cast("long"), "lat", "lng").repartition(tasks).mapInArrow(run, "id long, lat double, lng double, factor double, current_kmh double, freeflow_kmh double, status string")


def matrix_blocks(anchors: DataFrame, size: int = 25) -> DataFrame:
    """(bi, bj, origins, destinations): square blocks of the matrix of anchors (id, lat, lng), ids from 0 without gaps."""
    side = anchors.groupBy(F.floor(F.col("id") / size).alias("b")).agg(F.array_sort(F.collect_list(F.struct("id", "lat", "lng"))).alias("points"))
    a, b = side.select(F.col("b").alias("bi"), F.col("points").alias("origins")), side.select(F.col("b").alias("bj"), F.col("points").alias("destinations"))
    return a.crossJoin(b)


def block_seconds(data: bytes) -> list[list[int | None]]:
    """Seconds of a distance-matrix answer, with traffic where it is given; null where there is no route."""
    said = json.loads(data)
    if said.get("status") != "OK":
        raise OSError(f"matrix status {said.get('status')}")
    return [[(e.get("duration_in_traffic") or e["duration"])["value"] if e["status"] == "OK" else None for e in row["elements"]] for row in said["rows"]]


def matrix_seconds(blocks: DataFrame, url: str, qps: float = 0.8, ask: Fetch = fetch, tasks: int = 4) -> DataFrame:
    """(i, j, seconds) of matrix_blocks; url has {origins} and {destinations}. `tasks` tasks ask at once, together qps times a second at most."""

    def run(batches):
        pace = own_turns(qps, tasks)
        for batch in batches:
            for origins, destinations in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                said = ["|".join(f"{p['lat']},{p['lng']}" for p in side) for side in (origins, destinations)]

                def one(said=said):
                    pace.wait()
                    status, _, data = ask(url.format(origins=urllib.parse.quote(said[0]), destinations=urllib.parse.quote(said[1])), None)
                    if status != 200:
                        raise OSError(f"status {status}")
                    return block_seconds(data)

                rows = [(o["id"], d["id"], 0 if o["id"] == d["id"] else s) for o, row in zip(origins, retry(one), strict=True) for d, s in zip(destinations, row, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["i", "j", "seconds"])

    return blocks.select("origins", "destinations").repartition(tasks).mapInArrow(run, "i long, j long, seconds int")
