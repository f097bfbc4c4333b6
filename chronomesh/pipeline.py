"""The whole job over a folder of documents, and its commands: python -m chronomesh.pipeline COMMAND FOLDER ...

A folder holds osm.json (streets), water.json, traffic-NAME.json captures and feeds/ of timetable archives, each plain or
gzipped, and gets grid.json, matrix-MODE-SLICE.json, embedding-MODE-SLICE.json, embedding.js (the viewer's payload) and card.svg.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import grid, layout, polygons, reports
from .operators.shared import settle
from .sources import documents, files, gtfs, providers

DAY, DEPART = "20260722", 8 * 3600 + 30 * 60
#: Transit slices and when they leave (fixed values).
TRANSIT_SLICES = {"weekday-0830": DEPART}


def prepare(spark: SparkSession, folder: str, box=grid.BOX, row: float = grid.ROW) -> DataFrame:
    """Write grid.json: anchors on land, the mesh between them and the water, in one pass."""
    none = spark.createDataFrame([], "ring string, k int, lat double, lng double")
    water = none
    if files.exists(spark, f"{folder}/water.json"):
        found = files.read_json(spark, f"{folder}/water.json", files.WATER).select(F.inline("elements"))
        water = settle(polygons.build_water(found, box))
    anchors = settle(grid.land_anchors(grid.grid_points(spark, box, row), water))
    files.write_json(documents.grid_document(anchors, grid.mesh(anchors, water, row), water, box), f"{folder}/grid.json")
    return anchors


def read_grid(spark: SparkSession, folder: str) -> tuple[DataFrame, tuple[float, float, float, float]]:
    doc = files.read_json(spark, f"{folder}/grid.json", files.GRID)
    b = doc.select("bounds.*").first()
    return documents.grid_anchors(doc), (b["south"], b["north"], b["west"], b["east"])


def plan(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """Modes and slices to build: free flow, every capture, and transit where there are feeds and streets."""
    captured = sorted(r["slice"] for r in files.slice_files(spark, folder).where("kind = 'traffic'").select("slice").collect())
    out = [("drive", files.FREEFLOW), *(("drive", files.capture_name(s)) for s in captured)]
    if files.exists(spark, f"{folder}/feeds") and files.exists(spark, f"{folder}/osm.json"):
        out += [("transit", s) for s in TRANSIT_SLICES]
    return out


def streets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    if not files.exists(spark, f"{folder}/osm.json"):
        return None
    doc = files.read_json(spark, f"{folder}/osm.json", files.ROADS)
    return documents.road_ways(doc), documents.road_nodes(doc)


def captured(spark: SparkSession, folder: str, slice: str) -> DataFrame | None:
    return None if slice == files.FREEFLOW else documents.traffic_readings(files.read_json(spark, f"{folder}/traffic-{slice}.json", files.TRAFFIC))


def fetch_matrix(spark: SparkSession, folder: str, mode: str, slice: str, env: Mapping[str, str] = os.environ) -> None:
    """Write the matrix of one mode and slice, by the provider that is named or the first that can."""
    anchors, box = read_grid(spark, folder)
    known = streets(spark, folder)
    if mode == "transit":
        provider = "transit"
        found = providers.transit_matrix(anchors, *known, gtfs.load(spark, f"{folder}/feeds", env.get("CHRONOMESH_DAY", DAY), box), TRANSIT_SLICES[slice])
    else:
        provider = providers.select(providers.DRIVE, dict(env) | ({"CHRONOMESH_ROADS": "1"} if known else {}), env.get("MATRIX_PROVIDER")).name
        if provider == "road":
            found = providers.road_matrix(anchors, *known, captured(spark, folder, slice))
        elif provider == "google":
            found = providers.google_matrix(anchors, env, int(env["CHRONOMESH_DEPARTURE"]))
        else:
            found = providers.synthetic_matrix(anchors)
    files.write_json_lines(documents.matrix_lines(found, mode, slice, provider), f"{folder}/matrix-{mode}-{slice}.json")


def embed(spark: SparkSession, folder: str, mode: str, slice: str, rounds: int = 150) -> None:
    """Write the layout of one mode and slice."""
    anchors, _ = read_grid(spark, folder)
    doc = files.read_json(spark, f"{folder}/matrix-{mode}-{slice}.json", files.MATRIX)
    matrix = settle(documents.matrix_rows(doc).select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("seconds").cast("double").alias("d")))
    found, total = layout.embedding(matrix, anchors, mode, rounds)
    files.write_json(documents.embedding_document(found, mode, slice, doc.first()["provider"], total), f"{folder}/embedding-{mode}-{slice}.json")


def build_viewer(spark: SparkSession, folder: str) -> DataFrame:
    """Write the payload and the card; gives the payload's row (script, stamp)."""
    anchors, _ = read_grid(spark, folder)
    shown = files.slice_files(spark, folder).where("kind = 'embedding'").select("mode", "slice").distinct().collect()
    parts = [documents.embedding_rows(files.read_json(spark, f"{folder}/embedding-{r['mode']}-{r['slice']}.json", files.EMBEDDING)) for r in shown]
    if not parts:
        raise FileNotFoundError(f"no layout in {folder}")
    layouts = parts[0]
    for p in parts[1:]:
        layouts = layouts.unionByName(p)
    layouts = settle(layouts)
    known = streets(spark, folder)
    base = settle(reports.basemap(*known)) if known else spark.createDataFrame([], "tier long, chain int, points array<struct<lat double, lng double>>")
    one = layouts.groupBy("mode", "slice").agg(F.array_sort(F.collect_list(F.struct("id", "tx", "ty", "stress"))).alias("anchors"))
    slices = one.agg(F.array_sort(F.collect_list(F.struct("mode", "slice", "anchors"))).alias("slices"))
    drawn = base.agg(F.array_sort(F.collect_list(F.struct("tier", "chain", "points"))).alias("streets"))
    script = settle(files.payload(slices.crossJoin(drawn).select(F.struct("slices", "streets").alias("data"))))
    script.select("script").coalesce(1).write.mode("overwrite").text(f"{folder}/embedding.js")
    first = layouts.where((F.col("mode") == "drive") & (F.col("slice") == files.FREEFLOW))
    reports.svg_card(reports.drawn_lines(base, anchors, first)).coalesce(1).write.mode("overwrite").text(f"{folder}/card.svg")
    return script


def run(spark: SparkSession, folder: str, rounds: int = 150, env: Mapping[str, str] = os.environ) -> DataFrame:
    """Grid, then matrix and layout of every mode and slice, then the viewer."""
    prepare(spark, folder)
    for mode, slice in plan(spark, folder):
        fetch_matrix(spark, folder, mode, slice, env)
        embed(spark, folder, mode, slice, rounds)
    return build_viewer(spark, folder)


def spot(spark: SparkSession, folder: str, slice: str = "weekday-0830") -> DataFrame:
    """Trips by transit whose minutes are known."""
    anchors, _ = read_grid(spark, folder)
    rows = documents.matrix_rows(files.read_json(spark, f"{folder}/matrix-transit-{slice}.json", files.MATRIX))
    return reports.spot_checks(anchors, rows)


def capture(spark: SparkSession, folder: str, slice: str, captured_at: str, env: Mapping[str, str] = os.environ) -> None:
    """Write the readings of now as a capture."""
    anchors, _ = read_grid(spark, folder)
    name = files.capture_name(slice)
    found = providers.select(providers.SPEEDS, env, env.get("TRAFFIC_PROVIDER"))
    readings = found.build(anchors, env) if found.name == "tomtom" else found.build(anchors)
    files.write_json(documents.traffic_document(settle(readings), name, found.name, captured_at), f"{folder}/traffic-{name}.json")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m chronomesh.pipeline", description=__doc__.splitlines()[0])
    parser.add_argument("command", choices=("prepare", "capture", "matrix", "embed", "viewer", "spot", "run"))
    parser.add_argument("folder")
    parser.add_argument("--mode", default="drive", choices=("drive", "transit"))
    parser.add_argument("--slice", default=files.FREEFLOW)
    parser.add_argument("--at", help="when a capture was made, ISO 8601")
    parser.add_argument("--rounds", type=int, default=150)
    said = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if said.command == "prepare":
        prepare(spark, said.folder)
    elif said.command == "capture":
        capture(spark, said.folder, said.slice, said.at or "")
    elif said.command == "matrix":
        fetch_matrix(spark, said.folder, said.mode, said.slice)
    elif said.command == "embed":
        embed(spark, said.folder, said.mode, said.slice, said.rounds)
    elif said.command == "viewer":
        build_viewer(spark, said.folder)
    elif said.command == "spot":
        spot(spark, said.folder, said.slice).show(truncate=False)
    else:
        run(spark, said.folder, said.rounds)


if __name__ == "__main__":
    main()
