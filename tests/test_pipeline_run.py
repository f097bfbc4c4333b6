"""The whole job on a small city, and the sources it needs."""

import io
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from chronomesh import pipeline
from chronomesh.operators import layout
from chronomesh.sources import documents, files, gtfs, http
from pyspark.sql import functions as F

BOX = (47.58, 47.62, -122.36, -122.3)


def city(folder, n=6):
    """A grid of two-way streets, a lake, and one bus line."""
    step_lat, step_lng = (BOX[1] - BOX[0]) / (n - 1), (BOX[3] - BOX[2]) / (n - 1)
    elements = [{"type": "node", "id": i * n + j + 1, "lat": BOX[0] + i * step_lat, "lon": BOX[2] + j * step_lng} for i in range(n) for j in range(n)]
    for i in range(n):
        elements.append({"type": "way", "id": 1000 + i, "nodes": [i * n + j + 1 for j in range(n)], "tags": {"highway": "primary"}})
        elements.append({"type": "way", "id": 2000 + i, "nodes": [j * n + i + 1 for j in range(n)] + [9999], "tags": {"highway": "residential"}})
    (folder / "osm.json").write_text(json.dumps({"elements": elements}))
    lake = [(47.59, -122.34), (47.6, -122.34), (47.6, -122.33), (47.59, -122.33), (47.59, -122.34)]
    (folder / "water.json").write_text(json.dumps({"elements": [{"id": 1, "type": "way", "tags": {"natural": "water"}, "geometry": [{"lat": a, "lon": b} for a, b in lake]}]}))
    (folder / "feeds").mkdir()
    with zipfile.ZipFile(folder / "feeds" / "bus.zip", "w") as z:
        z.writestr("stops.txt", "stop_id,stop_name,stop_lat,stop_lon\n" + "".join(f"s{j},Stop {j},{BOX[0]},{BOX[2] + j * step_lng}\n" for j in range(n)))
        z.writestr("calendar.txt", "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nwk,1,1,1,1,1,0,0,20260101,20261231\n")
        z.writestr("trips.txt", "route_id,service_id,trip_id\n" + "".join(f"r,wk,t{k}\n" for k in range(3)))
        z.writestr("stop_times.txt", "trip_id,arrival_time,departure_time,stop_id,stop_sequence\n" + "".join(f"t{k},08:{30 + 5 * k + j}:00,08:{30 + 5 * k + j}:30,s{j},{j}\n" for k in range(3) for j in range(n)))


def test_run(spark, tmp_path, monkeypatch):
    city(tmp_path)
    folder = str(tmp_path)
    monkeypatch.setattr(pipeline.prepare, "__defaults__", (BOX, 0.01))
    pipeline.prepare(spark, folder)
    pipeline.capture(spark, folder, "rush", "2026-07-22T17:00:00Z", env={})
    assert pipeline.plan(spark, folder) == [("drive", "freeflow"), ("drive", "rush"), ("transit", "weekday-0830")]
    script = pipeline.run(spark, folder, rounds=20, env={}).first()
    got = json.loads(script.script.removeprefix("window.EMBEDDING = ").removesuffix(";"))
    assert [(s["mode"], s["slice"]) for s in got["slices"]] == [("drive", "freeflow"), ("drive", "rush"), ("transit", "weekday-0830")]
    assert {s["tier"] for s in got["streets"]} == {1} and len(got["streets"]) == 6
    anchors, box = pipeline.read_grid(spark, folder)
    n = anchors.count()
    assert box == BOX and n > 10 and all(len(s["anchors"]) == n for s in got["slices"])
    free, rush = (documents.matrix_rows(files.read_json(spark, f"{folder}/matrix-drive-{s}.json", files.MATRIX)) for s in ("freeflow", "rush"))
    assert free.where("i = j and seconds <> 0").count() == 0 and free.where("seconds is not null").count() > n
    both = free.join(rush.withColumnRenamed("seconds", "slow"), ["i", "j"]).where("i <> j and seconds is not null")
    assert both.where("slow < seconds").count() == 0 and both.where("slow > seconds").count() > 0
    svg = spark.read.text(f"{folder}/card.svg").first()[0]
    assert svg.startswith("<svg") and svg.count("<polyline") == 6 and svg.endswith("</svg>")
    checks = pipeline.spot(spark, folder).collect()
    assert len(checks) == 5 and all(r.fits == (r.minutes is not None and r.low <= r.minutes <= r.high) for r in checks)
    with pytest.raises(ValueError):
        pipeline.capture(spark, folder, "freeflow", "")


def test_documents_come_back(spark, tmp_path):
    m = spark.createDataFrame([(0, 0, 0), (0, 2, 7), (2, 1, 5)], "i long, j long, seconds int")
    files.write_json(documents.matrix_document(m, "drive", "x", "road"), f"{tmp_path}/m.json")
    rows = {(r.i, r.j): r.seconds for r in documents.matrix_rows(files.read_json(spark, f"{tmp_path}/m.json", files.MATRIX)).collect()}
    assert len(rows) == 9 and {k: v for k, v in rows.items() if v is not None} == {(0, 0): 0, (0, 2): 7, (2, 1): 5}
    assert documents.matrix_document(m.limit(0), "drive", "x", "road").first().seconds == []
    with pytest.raises(ValueError):
        documents.traffic_document(spark.createDataFrame([], "id long, lat double, lng double, factor double, current_kmh double, freeflow_kmh double"), "freeflow", "x", "now")


class Answers(BaseHTTPRequestHandler):
    def do_POST(self):
        if self.path == "/bad":
            self.send_response(503)
            self.end_headers()
            return
        body = json.dumps({"elements": [{"type": "node", "id": i} for i in range(3)] if self.path == "/good" else []}).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_street_source_fails_over_and_is_kept(spark, tmp_path):
    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    got = http.overpass(spark, http.road_query(*BOX), [f"{base}/bad", f"{base}/good"], f"{tmp_path}/kept")
    assert sorted(json.loads(r.element)["id"] for r in got.collect()) == [0, 1, 2]
    with pytest.raises(Exception, match="no elements"):
        http.overpass(spark, "x", [f"{base}/empty"], f"{tmp_path}/other")
    server.shutdown()
    assert http.overpass(spark, "x", [f"{base}/bad"], f"{tmp_path}/kept").count() == 3  # from the folder


def test_feeds_come_from_the_first_mirror_that_has_them(spark, tmp_path):
    def archive(text):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            z.writestr("stops.txt", text)
        return held.getvalue()

    page = archive("stop_id,stop_name,stop_lat,stop_lon\n1,A,47.6,-122.3\n")

    def ask(url, body):
        return {"a://gone": (404, {}, b""), "a://page": (200, {}, b"<html>"), "a://zip": (200, {}, page)}[url]

    got = http.feed_archives(spark, {"one": ["a://gone", "a://page", "a://zip"], "two": ["a://zip"]}, f"{tmp_path}/feeds", ask=ask)
    assert sorted(r.path for r in got.collect()) == ["one.zip", "two.zip"]
    table = gtfs.load(spark, got, "20260722")
    assert sorted(r.id for r in table.stops.collect()) == ["one:1", "two:1"]
    with pytest.raises(Exception, match="no archive"):
        http.feed_archives(spark, {"x": ["a://page"]}, f"{tmp_path}/none", ask=ask)


def test_failed_readings_say_why(spark):
    flow = json.dumps({"flowSegmentData": {"currentTravelTime": 30, "freeFlowTravelTime": 20, "currentSpeed": 20.0, "freeFlowSpeed": 30.0}}).encode()

    def ask(url, body):
        return (200, {}, flow) if url.endswith("1.0") else (400, {}, b"") if url.endswith("2.0") else (403, {}, b"")

    points = spark.createDataFrame([(i, float(i), 0.0) for i in (1, 2, 3)], "id long, lat double, lng double")
    rows = {r.id: (r.factor, r.status) for r in http.flow_readings(points, "u://{lng}?{lat}", tasks=1, qps=1000, ask=ask).collect()}
    assert rows[1] == (1.5, "ok") and rows[2] == (1.0, "no road") and rows[3][0] == 1.0 and "403" in rows[3][1]


def test_slice_files(spark, tmp_path):
    for name in ("embedding-drive-a-b.json", "embedding-walk-x.json", "traffic-rush.json", "other.json", "embedding-transit-x.json"):
        (tmp_path / name).write_text("{}")
    got = {(r.kind, r.mode, r.slice) for r in files.slice_files(spark, str(tmp_path)).collect()}
    assert got == {("embedding", "drive", "a-b"), ("embedding", "transit", "x"), ("traffic", "drive", "rush")}


def test_embedding_equals_plain_loops(spark):
    """The whole driver against a few lines of numpy."""
    import numpy as np

    rng = np.random.default_rng(8)
    lat, lng = 47.5 + rng.random(12) * 0.2, -122.4 + rng.random(12) * 0.2
    x = np.stack([lng * 111.32 * np.cos(np.radians(47.61)), lat * 111.32], axis=1)
    d = np.hypot(*(x[:, None] - x).transpose(2, 0, 1)) * 60 * (1 + rng.random((12, 12)))
    np.fill_diagonal(d, 0)
    d[2, 5] = d[5, 2] = d[1, 7] = np.nan
    m = spark.createDataFrame([(i, j, None if np.isnan(d[i, j]) else float(d[i, j])) for i in range(12) for j in range(12)], "i long, j long, d double")
    a = spark.createDataFrame([(i, float(lat[i]), float(lng[i])) for i in range(12)], "id long, lat double, lng double")
    found, total = layout.embedding(m, a, "transit", 30)
    s = np.where(np.isnan(d), d.T, np.where(np.isnan(d.T), d, (d + d.T) / 2))
    s = np.where(np.isnan(s), np.nanmean(s, axis=1)[:, None], s)
    upper = np.triu_indices(12, 1)
    y = x * (s[upper].sum() / np.hypot(*(x[:, None] - x).transpose(2, 0, 1))[upper].sum())
    for _ in range(30):
        new = np.zeros_like(y)
        for i in range(12):
            w = [0 if i == j else 1 / max(s[i, j], 60) ** 2 for j in range(12)]
            gap = [np.hypot(*(y[i] - y[j])) or 1e-9 for j in range(12)]
            new[i] = sum(w[j] * (y[j] + s[i, j] / gap[j] * (y[i] - y[j])) for j in range(12)) / sum(w)
        y = new
    gap = np.hypot(*(y[:, None] - y).transpose(2, 0, 1))
    assert total.first().stress == pytest.approx(np.sqrt(((gap - s)[upper] ** 2).sum() / (s[upper] ** 2).sum()), abs=1e-4)
    rows = {r.id: r for r in found.collect()}
    c, g = y - y.mean(axis=0), x - x.mean(axis=0)
    u, sv, vt = np.linalg.svd(g.T @ c)
    best = (c @ (u @ vt).T) * sv.sum() / (c**2).sum() + x.mean(axis=0)
    assert all(abs(rows[i].tx - best[i][0]) < 2e-3 and abs(rows[i].ty - best[i][1]) < 2e-3 for i in range(12))
    error = [sum((gap[i, j] - s[min(i, j), max(i, j)]) ** 2 for j in range(12) if j != i) for i in range(12)]
    assert all(rows[i].stress == pytest.approx(np.sqrt(error[i] / 12), abs=0.06) for i in range(12))
    assert found.where(F.col("stress").isNull()).count() == 0
