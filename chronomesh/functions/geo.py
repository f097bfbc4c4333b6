"""Column functions of the travel-time domain: distances, parsing, clamping, rounding.

Four metrics are kept apart on purpose; see each function.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
KM_PER_DEG = 111.32
#: Latitudes whose cosine scales longitudes: of the city, and of the grid's middle.
CITY_LAT, GRID_LAT = 47.61, 47.617
KM_PER_LNG = KM_PER_DEG * math.cos(math.radians(CITY_LAT))
KM_PER_LNG_GRID = KM_PER_DEG * math.cos(math.radians(GRID_LAT))
MPH = 0.44704

#: Default speed in mph of each drivable road class (fixed values).
CLASS_MPH = {
    "motorway": 60, "motorway_link": 45, "trunk": 55, "trunk_link": 40, "primary": 40, "primary_link": 30, "secondary": 35,
    "secondary_link": 30, "tertiary": 30, "tertiary_link": 25, "unclassified": 25, "residential": 25, "living_street": 12,
}
OTHER_MPH = 25

Num = Column | float


def rounded(x: Column, digits: int = 0) -> Column:
    """Half up towards plus infinity, alike on every engine."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)


def _col(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine_m(lat1: Num, lng1: Num, lat2: Num, lng2: Num) -> Column:
    """Great-circle metres: road lengths and snapping."""
    lat1, lng1, lat2, lng2 = map(_col, (lat1, lng1, lat2, lng2))
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlng) * F.sin(dlng)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def flat_km(lat1: Num, lng1: Num, lat2: Num, lng2: Num, per_lng: float = KM_PER_LNG) -> Column:
    """Equirectangular kilometres: walking, traffic radius, layouts; per_lng differs for the grid."""
    lat1, lng1, lat2, lng2 = map(_col, (lat1, lng1, lat2, lng2))
    dy, dx = (lat1 - lat2) * KM_PER_DEG, (lng1 - lng2) * per_lng
    return F.sqrt(dy * dy + dx * dx)


def degrees_squared(lat1: Num, lng1: Num, lat2: Num, lng2: Num) -> Column:
    """Squared degrees without a cosine: nearest anchor and landmark weights."""
    lat1, lng1, lat2, lng2 = map(_col, (lat1, lng1, lat2, lng2))
    return (lat1 - lat2) * (lat1 - lat2) + (lng1 - lng2) * (lng1 - lng2)


def clamp_factor(x: Column, cap: float = 4.0, closure: float = 1.0) -> Column:
    """Slowdown of at least 1 and at most cap; a null or value that isn't finite counts as `closure`."""
    odd = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(odd, F.lit(closure)).when(x < 1, F.lit(1.0)).otherwise(F.least(x, F.lit(cap)))


def maxspeed_mph(tag: Column, highway: Column) -> Column:
    """First number of the tag, read as mph whatever its unit; else the class's default."""
    number = F.nullif(F.regexp_extract(tag, r"(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")
    classes = F.create_map(*(F.lit(v) for k, mph in CLASS_MPH.items() for v in (k, float(mph))))
    return F.coalesce(number, F.try_element_at(classes, highway), F.lit(float(OTHER_MPH)))


def drivable(highway: Column) -> Column:
    return highway.isin(*CLASS_MPH)


def directions(oneway: Column, highway: Column) -> Column:
    """1 for forward, -1 for reverse: the ways along which a road can be driven."""
    return (
        F.when(oneway == "-1", F.array(F.lit(-1)))
        .when(F.coalesce(oneway.isin("yes", "true", "1"), F.lit(False)) | highway.isin("motorway", "motorway_link"), F.array(F.lit(1)))
        .otherwise(F.array(F.lit(1), F.lit(-1)))
    )


def edge_seconds(metres: Column, mph: Column) -> Column:
    """Null where the speed is zero: such an edge is never driven."""
    return F.when(mph > 0, metres / (mph * MPH))


def gtfs_seconds(text: Column) -> Column:
    """Seconds after midnight of H:MM or H:MM:SS; hours may pass 24."""
    part = F.split(text, ":")
    second = F.coalesce(F.try_element_at(part, F.lit(3)).try_cast("int"), F.lit(0))
    return F.try_element_at(part, F.lit(1)).try_cast("int") * 3600 + F.try_element_at(part, F.lit(2)).try_cast("int") * 60 + second


def service_date(day: Column) -> Column:
    """The next Wednesday, or the day itself if it is one."""
    return F.next_day(F.date_sub(day, 1), "WED")


def strictly_next_wednesday(day: Column) -> Column:
    return F.next_day(day, "WED")


def modeled_slowdown(lat: Column, lng: Column, peak: float = 0.9, scale_km: float = 4.0, core: tuple[float, float] = (47.606, -122.335)) -> Column:
    """Peak at the core that falls off with distance."""
    d = flat_km(lat, lng, *core) / scale_km
    return clamp_factor(1 + peak * F.exp(-(d * d)))


#: south, north, west, east of the two lakes that cost a detour (fixed values).
LAKES = ((47.62, 47.655, -122.345, -122.305), (47.673, 47.687, -122.345, -122.325))


def middle_in(lat1: Column, lng1: Column, lat2: Column, lng2: Column, rect: tuple[float, float, float, float]) -> Column:
    south, north, west, east = rect
    lat, lng = (lat1 + lat2) / 2, (lng1 + lng2) / 2
    return (lat > south) & (lat < north) & (lng > west) & (lng < east)


def synthetic_seconds(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Drive time without data: 45 km/h north-south, 22 km/h east-west, canal and lake penalties."""
    north = F.abs(lat2 - lat1) * KM_PER_DEG / 45 * 3600
    east = F.abs(lng2 - lng1) * KM_PER_LNG / 22 * 3600
    canal = F.when((lat1 - 47.655) * (lat2 - 47.655) < 0, 240.0).otherwise(0.0)
    lake = middle_in(lat1, lng1, lat2, lng2, LAKES[0]) | middle_in(lat1, lng1, lat2, lng2, LAKES[1])
    return rounded((north + east + canal) * F.when(lake, 1.25).otherwise(1.0) + 90)


def crosses_ray(lat: Column, lng: Column, lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Whether an edge crosses the ray to the east of a point; half-open in latitude."""
    at = (lng2 - lng1) * (lat - lat1) / F.when(lat1 != lat2, lat2 - lat1) + lng1
    return ((lat1 > lat) != (lat2 > lat)) & (lng < at)


def segment_km(lat: Column, lng: Column, lat1: Column, lng1: Column, lat2: Column, lng2: Column, per_lng: float = KM_PER_LNG_GRID) -> Column:
    """Distance of a point to a segment; a segment without length is a point.

    Steps are those of the SQL that checks it, one by one: places that are equally far differ by rounding alone, and which is nearer must not depend on the engine.
    """
    dx, dy = lng2 - lng1, lat2 - lat1
    east, north = dx * per_lng, dy * KM_PER_DEG
    size = east * east + north * north
    along = (lng - lng1) * dx * (per_lng * per_lng) + (lat - lat1) * dy * (KM_PER_DEG * KM_PER_DEG)
    t = F.when(size == 0, 0.0).otherwise(along / F.when(size != 0, size))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    x, y = (lng1 + t * dx - lng) * per_lng, (lat1 + t * dy - lat) * KM_PER_DEG
    return F.sqrt(x * x + y * y)


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def drawn_text(factor: Column) -> Column:
    """How a drawn distance compares with the true one."""
    share = F.abs(rounded((factor - 1) * 100)).cast("int").cast("string")
    return F.when(factor < 0.97, F.concat(share, F.lit("% closer"))).when(factor > 1.03, F.concat(share, F.lit("% farther"))).otherwise("close to true")


def round_trip(there: Column, back: Column) -> Column:
    return F.when(there.isNotNull() & back.isNotNull(), (there + back) / 2).otherwise(F.coalesce(there, back))
