import gzip
import json
import math
import random
import zipfile

import pytest
from chronomesh.sources import documents, files, gtfs, http, providers, schemas
from pyspark.sql import functions as F


def test_json_plain_and_gzipped(spark, tmp_path):
    doc = {"elements": [{"type": "node", "id": 5_000_000_000, "lat": 1.0, "lon": 2.0}, {"type": "way", "id": 7, "nodes": [5_000_000_000, 6], "tags": {"highway": "primary", "maxspeed": "30 mph"}}]}
    path = f"{tmp_path}/roads.json"
    with open(path, "w") as f:
        json.dump(doc, f, indent=1)
    assert files.exists(spark, path) and not files.exists(spark, f"{tmp_path}/none.json")
    read = files.read_json(spark, path, schemas.ROADS)
    assert documents.road_nodes(read).collect() == [(5_000_000_000, 1.0, 2.0)]
    assert documents.road_ways(read).collect() == [(7, [5_000_000_000, 6], "primary", "30 mph", None, None)]
    with gzip.open(f"{path}.gz", "wt") as f:
        json.dump({"elements": []}, f)
    assert documents.road_nodes(files.read_json(spark, path, schemas.ROADS)).count() == 0
    files.write_json(spark.range(1).select(F.lit("a").alias("mode")), path)
    assert files.read_json(spark, path, "mode string").first().mode == "a"


def test_grid_traffic_matrix_documents(spark, tmp_path):
    docs = {
        "grid": (schemas.GRID, {"bounds": {}, "count": 1, "anchors": [{"id": 0, "lat": 1.5, "lng": 2.5}], "edges": [[0, 1, 1]], "water": [{"name": "bay", "ring": [[2.0, 1.0]]}]}),
        "traffic": (schemas.TRAFFIC, {"slice": "s", "capturedAt": "2024-05-01T12:00:00Z", "readings": [{"lat": 1.0, "lng": 2.0, "factor": 1.5, "currentKmh": None}]}),
        "matrix": (schemas.MATRIX, {"mode": "drive", "slice": "s", "n": 2, "seconds": [[0, None], [5, 0]]}),
    }
    read = {}
    for name, (schema, doc) in docs.items():
        with open(f"{tmp_path}/{name}.json", "w") as f:
            json.dump(doc, f)
        read[name] = files.read_json(spark, f"{tmp_path}/{name}.json", schema)
    assert documents.grid_anchors(read["grid"]).collect() == [(0, 1.5, 2.5)]
    assert documents.grid_mesh(read["grid"]).collect() == [(0, 1, 1)]
    assert documents.grid_water(read["grid"]).collect() == [("bay", 0, 1.0, 2.0)]
    assert documents.traffic_readings(read["traffic"]).collect() == [("s", 0, 1.0, 2.0, 1.5, None, None)]
    rows = documents.matrix_rows(read["matrix"])
    assert sorted(rows.where("seconds is null").collect()) == [("drive", "s", 0, 1, None)]
    files.write_slices(rows, f"{tmp_path}/m")
    files.write_slices(rows.where("i = 0"), f"{tmp_path}/m")
    assert files.read_slices(spark, f"{tmp_path}/m", "drive", "s").count() == 2


def test_a_matrix_in_lines_equals_the_whole_document(spark, tmp_path):
    m = spark.createDataFrame([(0, 0, 0), (0, 2, 7), (4, 1, 5), (2, 3, None)], "i long, j long, seconds int").repartition(3)
    path = f"{tmp_path}/m.json"
    lines = documents.matrix_lines(m, "drive", "x", "road")
    files.write_json_lines(lines, path)
    back = files.read_json(spark, path, schemas.MATRIX)
    assert back.count() == lines.count() == 5 and {r.n for r in back.collect()} == {5}  # no value holds more than a row
    rows = lambda doc: {(r.i, r.j): r.seconds for r in documents.matrix_rows(doc).collect()}
    assert rows(back) == rows(documents.matrix_document(m, "drive", "x", "road")) and len(rows(back)) == 25
    none = documents.matrix_lines(m.limit(0), "drive", "x", "road")
    assert none.first().seconds == [] and set(none.columns) == set(back.columns)


def test_csv_fields(spark):
    lines = ['a,"b,c","d""e",', "x", "", '"",1']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    got = {r.i: r.f for r in df.select("i", files.csv_fields(F.col("t")).alias("f")).collect()}
    assert got == {0: ["a", "b,c", 'd"e', ""], 1: ["x"], 2: [""], 3: ["", "1"]}


def feed(path, extra=()):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("stops.txt", "stop_id,stop_name,stop_lat,stop_lon\r\nA,\"One, north\",47.6,-122.33\r\nB,Two,47.61,-122.33\r\nC,Three,47.6005,-122.33\r\n")
        z.writestr("trips.txt", "route_id,trip_id,service_id\nr,t1,w\nr,t2,w\nr,t3,x\n")
        z.writestr("stop_times.txt", "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt1,08:00:00,08:00:30,A,1\nt1,25:30:00,25:31:00,B,2\nt2,07:00:00,07:00:00,A,2\nt2,07:10:00,07:10:00,B,10\nt3,07:00:00,07:00:00,A,1\nt3,07:10:00,07:10:00,B,2\n")
        z.writestr("calendar.txt", "service_id,start_date,end_date,monday,tuesday,wednesday,thursday,friday,saturday,sunday\nw,20240101,20241231,0,0,1,0,0,0,0\nx,20240101,20241231,0,0,1,0,0,0,0\n")
        for name, text in extra:
            z.writestr(name, text)


def test_feeds(spark, tmp_path):
    feed(f"{tmp_path}/one.zip", [("calendar_dates.txt", "service_id,date,exception_type\nx,20240605,2\n"), ("transfers.txt", "from_stop_id,to_stop_id,min_transfer_time\nA,B,\nA,Z,9\n")])
    feed(f"{tmp_path}/two.zip")
    t = gtfs.load(spark, str(tmp_path), "20240605", (47.59, 47.62, -122.4, -122.3))
    assert t.stops.count() == 6 and t.stops.where("id = 'one:A'").first().name == "One, north"
    assert {(r.feed, r.trips) for r in t.patterns.collect()} == {("one", 2), ("two", 3)}
    rows = sorted((r.trip, r.pos, r.stop, r.arr) for r in t.trips.collect() if r.stop.startswith("one"))
    assert rows == [(0, 0, "one:A", 25200), (0, 1, "one:B", 25800), (1, 0, "one:A", 28800), (1, 1, "one:B", 91800)]
    near = {(r.a, r.b): r.sec for r in t.transfers.where("a like 'one%'").collect() if r.b.startswith("one")}
    assert near[("one:A", "one:B")] == 120 and near[("one:A", "one:C")] == near[("one:C", "one:A")] == 54 and ("one:A", "one:Z") not in near
    assert gtfs.load(spark, str(tmp_path), "20240606").trips.count() == 0


def test_http_helpers():
    calls = []

    def ask(url, body):
        calls.append(url)
        return (500, {}, b"") if "bad" in url else (200, {}, b"ok")

    assert http.first_answer(["bad", "good"], None, ask) == b"ok" and calls == ["bad", "good"]
    with pytest.raises(OSError):
        http.first_answer(["bad"], None, ask)
    waits, tries = [], iter([ValueError(), ValueError(), 3])

    def flaky():
        x = next(tries)
        if isinstance(x, Exception):
            raise x
        return x

    assert http.retry(flaky, sleep=waits.append) == 3 and waits == [0.3, 0.6]
    with pytest.raises(http.Permanent):
        http.retry(lambda: http.flow_reading(400, {}, b""), sleep=waits.append)
    said = json.dumps({"flowSegmentData": {"currentTravelTime": 90, "freeFlowTravelTime": 10, "currentSpeed": 5, "freeFlowSpeed": 50, "roadClosure": False}}).encode()
    assert http.flow_reading(200, {}, said) == (4.0, 5, 50)
    closed = json.dumps({"flowSegmentData": {"roadClosure": True, "freeFlowSpeed": 50}}).encode()
    assert http.flow_reading(200, {}, closed) == (1.0, 0.0, 50) and http.flow_reading(200, {}, closed, closure=4.0)[0] == 4.0
    answer = json.dumps({"status": "OK", "rows": [{"elements": [{"status": "OK", "duration": {"value": 7}}, {"status": "OK", "duration": {"value": 7}, "duration_in_traffic": {"value": 9}}, {"status": "NOT_FOUND"}]}]}).encode()
    assert http.block_seconds(answer) == [[7, 9, None]]
    now = [0.0]
    pace = http.Pace(2, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(5):
        pace.wait()
    assert now[0] == 2.0
    assert "motorway" in http.road_query(1, 2, 3, 4) and http.water_query(1, 2, 3, 4).count("(1,3,2,4)") == 5


MEMBERS = ["", "\n\n", "a\n\nb\n\n\n", "\ufeffhead\r\nrow\r\n", "no end", "cr\rinside\nlast\r", "é日本😀\n" * 5_000, "x" * 100_000 + "\n\n" + "y", "\r\n\r\nz"]


def plain_lines(text):
    lines = text.encode().decode("utf-8-sig").replace("\r\n", "\n").split("\n")
    while lines and not lines[-1]:
        lines.pop()
    return lines


@pytest.mark.parametrize("packing", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_unpacked_lines(packing, step):
    import zlib

    for text in MEMBERS if step > 1 else MEMBERS[:6]:
        data = text.encode()
        pack = zlib.compressobj(wbits=-15)
        packed = data if packing == zipfile.ZIP_STORED else pack.compress(data) + pack.flush()
        assert list(files.unpacked_lines(packing, zlib.crc32(data), packed, step)) == plain_lines(text)
        with pytest.raises(ValueError):
            list(files.unpacked_lines(packing, zlib.crc32(data) ^ 1, packed, step))


def test_members_are_dealt_one_by_one(spark, tmp_path):
    """One archive of many members is unpacked by many tasks, to the same lines as by the library."""
    with zipfile.ZipFile(tmp_path / "all.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("folder")
        for i in range(40):
            z.writestr(f"folder/m{i}.txt", MEMBERS[i % len(MEMBERS)], zipfile.ZIP_STORED if i % 5 else zipfile.ZIP_DEFLATED)
    rows = files.zip_lines(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.member, r.line)):
        assert r.feed == "all" and r.line == len(got.setdefault(r.member, []))
        got[r.member].append(r.text)
    assert got == {f"folder/m{i}.txt": lines for i in range(40) if (lines := plain_lines(MEMBERS[i % len(MEMBERS)]))}
    packed = files.members_of(spark.read.format("binaryFile").load(f"{tmp_path}/all.zip"))
    assert packed.count() == 40 and packed.repartition(8, "feed", "member").withColumn("t", F.spark_partition_id()).select("t").distinct().count() > 4


@pytest.mark.parametrize("tasks", [1, 3, 8])
@pytest.mark.parametrize("qps", [0.8, 4.0, 7.3])
def test_one_rate_for_all_tasks(tasks, qps):
    """Tasks that begin at any time, and whose calls take any time, never ask sooner than a slot after another."""
    rng, calls = random.Random(tasks), []
    for task in range(tasks):
        now = [1.7e9 + rng.random() * 20]
        turns = http.Turns(qps, task, tasks, clock=lambda now=now: now[0], sleep=lambda s, now=now: now.__setitem__(0, now[0] + s))
        for _ in range(40):
            turns.wait()
            calls.append(now[0])
            now[0] += rng.choice((0, 0.01, 0.3, 5 * rng.random()))
    calls.sort()
    assert min(b - a for a, b in zip(calls, calls[1:], strict=False)) > 0.999 / qps
    for at in calls:
        assert sum(at <= c < at + 1 for c in calls) <= math.ceil(qps)


def test_tasks_take_their_own_turns(spark):
    """In a job each task has slots of its own, and all of them together keep the rate."""
    points = spark.createDataFrame([(i, 47.6, -122.3) for i in range(12)], "id long, lat double, lng double")

    def flow(url, body):
        import time

        return 200, {}, json.dumps({"flowSegmentData": {"currentTravelTime": 10, "freeFlowTravelTime": 10, "currentSpeed": time.time(), "freeFlowSpeed": 30}}).encode()

    rows = http.flow_readings(points, "http://x/{lat},{lng}", 4, 10.0, flow).collect()
    at = sorted(r.current_kmh for r in rows)
    assert len(at) == 12 and min(b - a for a, b in zip(at, at[1:], strict=False)) > 0.04 and at[-1] - at[0] >= 1.05


def test_http_sources(spark):
    points = spark.createDataFrame([(0, 47.6, -122.3), (1, 47.7, -122.3)], "id long, lat double, lng double")

    def flow(url, body):
        if "47.7" in url:
            return 400, {}, b""
        return 200, {}, b'{"flowSegmentData": {"currentTravelTime": 15, "freeFlowTravelTime": 10, "currentSpeed": 20, "freeFlowSpeed": 30}}'

    got = {r.id: (r.factor, r.current_kmh) for r in http.flow_readings(points, "http://x/{lat},{lng}", 2, 1000, flow).collect()}
    assert got == {0: (1.5, 20.0), 1: (1.0, None)}

    def matrix(url, body):
        return 200, {}, b'{"status": "OK", "rows": [{"elements": [{"status": "OK", "duration": {"value": 3}}]}]}'

    rows = http.matrix_seconds(http.matrix_blocks(points, 1), "http://x/{origins}/{destinations}", 1000, matrix).collect()
    assert sorted(map(tuple, rows)) == [(0, 0, 0), (0, 1, 3), (1, 0, 3), (1, 1, 0)]
    spark.dataSource.register(http.OverpassSource)
    assert spark.read.format("overpass").option("query", "q").option("endpoints", "http://127.0.0.1:9").load().columns == ["element"]


def test_providers(spark):
    assert providers.select(providers.DRIVE, {}).name == "synthetic" and providers.select(providers.DRIVE, {"GOOGLE_MAPS_API_KEY": "k"}).name == "google"
    assert providers.select(providers.SPEEDS, {"TOMTOM_API_KEY": "k"}, "modeled").name == "modeled"
    with pytest.raises(KeyError):
        providers.select(providers.SPEEDS, {}, "none")
    points = spark.createDataFrame([(0, 47.606, -122.335), (1, 47.7, -122.3)], "id long, lat double, lng double")
    assert providers.modeled_readings(points).where("id = 0").first().factor == pytest.approx(1.9)
    assert providers.synthetic_matrix(points).count() == 4


def test_road_matrix(spark):
    nodes = spark.createDataFrame([(i, 47.6 + i * 0.001, -122.33) for i in range(6)] + [(9, 47.7, -122.3), (10, 47.7001, -122.3)], "id long, lat double, lng double")
    ways = spark.createDataFrame([(1, [0, 1, 2, 3, 4, 5], "residential", None, None), (2, [9, 10], "residential", None, "yes"), (3, [0, 99], "primary", "0", None)], "way long, nodes array<long>, highway string, maxspeed string, oneway string")
    anchors = spark.createDataFrame([(0, 47.6001, -122.3301), (1, 47.7, -122.3)], "id long, lat double, lng double")
    rows = {(r.i, r.j): r.seconds for r in providers.road_matrix(anchors, ways, nodes).collect()}
    assert rows[0, 0] == 0 and rows[0, 1] == rows[1, 0] == round(5 * 111.19492664455873 / (25 * 0.44704))


def test_payload(spark):
    df = spark.range(1).select(F.struct(F.lit(3).alias("n")).alias("data"))
    made = files.payload(df)
    row = made.first()
    assert row.script == 'window.EMBEDDING = {"n":3};' and len(row.stamp) == 8
    assert files.read_payload(made, "n int").first().data.n == 3
    page = spark.range(1).select(files.stamped_page(F.lit('<script src="embedding.js?v=00aa">'), F.lit("12ab")).alias("p")).first().p
    assert page == '<script src="embedding.js?v=12ab">'


def test_transit_matrix(spark):
    from types import SimpleNamespace

    nodes = spark.createDataFrame([(i, 47.6 + i * 0.01, -122.33) for i in range(11)], "id long, lat double, lng double")
    ways = spark.createDataFrame([(1, list(range(11)), "residential", None, "yes")], "way long, nodes array<long>, highway string, maxspeed string, oneway string")
    anchors = spark.createDataFrame([(0, 47.6, -122.33), (1, 47.7, -122.33), (2, 47.65, -122.33)], "id long, lat double, lng double")
    stops = spark.createDataFrame([("f:A", "A", 47.6, -122.33), ("f:B", "B", 47.7, -122.33), ("f:C", "C", 40.0, -122.33)], "id string, name string, lat double, lng double")
    trips = spark.createDataFrame([(1, 0, 0, "f:A", 29000, 29000), (1, 0, 1, "f:B", 29600, 29600)], "pattern long, trip long, pos long, stop string, arr long, dep long")
    transfers = spark.createDataFrame([], "a string, b string, sec long")
    t = SimpleNamespace(stops=stops, trips=trips, transfers=transfers)
    got = {(r.i, r.j): r.seconds for r in providers.transit_matrix(anchors, ways, nodes, t, 28800).collect()}
    step = 0.01 * 111.32 * 1000 / 1.35
    assert got[0, 1] == 800 and got[1, 0] == round(10 * step) and got[0, 2] == round(5 * step) and got[0, 0] == 0
