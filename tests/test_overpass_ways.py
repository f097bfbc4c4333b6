"""Ways from a server that keeps what it was asked, and answers only what its filters let through."""

import json
import re
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from chronomesh.sources import http

TAGS = [("primary", None), ("primary", "no"), ("residential", "private"), ("residential", "yes"), ("footway", None), ("tertiary", "permissive"), (None, None), ("prim|ary", 'a "b"')]
WAYS = [(i, 47.5 + (i % 10) / 100, -122.4 + (i // 10) / 100, *TAGS[i % len(TAGS)]) for i in range(80)]


def lets_through(text, tags):
    for negative, key, sign, value in re.findall(r'\[(!?)"(\w+)"(?:(!?[=~])("(?:[^"\\]|\\.)*"))?\]', text):
        own, value = tags.get(key), json.loads(value) if value else None
        fine = {"": (own is None) if negative else own is not None, "=": own == value, "!=": own != value, "~": own is not None and bool(re.search(value or "", own)), "!~": own is None or not re.search(value or "", own)}[sign]
        if not fine:
            return False
    return True


@pytest.fixture(scope="module")
def server():
    asked = []

    class Answers(BaseHTTPRequestHandler):
        def do_POST(self):
            text = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["data"][0]
            asked.append(text)
            south, west, north, east = map(float, re.search(r"\(([-\d.,e]+)\);out", text)[1].split(","))
            found = []
            for i, lat, lng, highway, access in WAYS:
                tags = {k: v for k, v in (("highway", highway), ("access", access)) if v is not None}
                if south <= lat <= north and west <= lng <= east and lets_through(text, tags):
                    found.append({"type": "way", "id": i, "nodes": [i, i + 1], "tags": tags})
            data = json.dumps({"elements": found}).encode()
            self.send_response(200), self.end_headers(), self.wfile.write(data)

        def log_message(self, *args):
            pass

    at = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=at.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{at.server_port}/", asked
    at.shutdown()


BOX = (47.5, 47.59, -122.4, -122.33)


def test_conditions_reach_the_server(spark, server):
    url, asked = server
    asked.clear()
    got = {r.id: (r.nodes, r.highway, r.access) for r in http.public_roads(http.overpass_ways(spark, [url], *BOX, tiles=3)).collect()}
    want = {i: ([i, i + 1], h, a) for i, _, _, h, a in WAYS if h in http.CLASS_MPH and a not in ("no", "private")}
    assert got == want and len(asked) == 9
    assert all('["access"!="no"]' in a and '["access"!="private"]' in a for a in asked)
    assert all(re.search(r'\["highway"~"\^\(.*primary.*\)\$"\]', a) for a in asked)


def test_ways_on_the_border_of_tiles_come_once(spark, server):
    url, _ = server
    ways = http.overpass_ways(spark, [url], *BOX, tiles=3)
    assert ways.count() > len(WAYS) == ways.dropDuplicates(["id"]).count() and ways.rdd.getNumPartitions() == 9


CONDITIONS = [
    "highway = 'primary'", "highway <> 'primary'", "not highway <=> 'primary'", "access is null", "access is not null", "highway in ('primary', 'tertiary', 'prim|ary')",
    "highway not in ('primary', 'tertiary')", "highway like 'r%'", """highway = 'prim|ary' and access = 'a "b"'""", "highway = 'primary' or access is null", "id > 40 and highway = 'primary'",
]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_conditions_mean_the_same_on_both_sides(spark, server, condition):
    url, _ = server
    plain = spark.createDataFrame([(w[0], w[3], w[4]) for w in WAYS], "id long, highway string, access string")
    pushed = http.overpass_ways(spark, [url], *BOX).where(condition).select("id").distinct()
    assert sorted(r.id for r in pushed.collect()) == sorted(r.id for r in plain.where(condition).collect())


def test_words_of_the_server():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, Not, StringContains

    say = http.tag_filter
    assert say(EqualTo(("highway",), "a\"b")) == '["highway"="a\\"b"]' and say(Not(EqualTo(("access",), "no"))) == '["access"]["access"!="no"]'
    assert say(In(("access",), ("x.y", "z"))) == '["access"~"^(x\\\\.y|z)$"]' and say(Not(IsNull(("name",)))) == '["name"]'
    assert say(GreaterThan(("id",), 3)) is None and say(StringContains(("name",), "x")) is None and say(EqualTo(("id",), 3)) is None
