"""A query is registered under a name with the SQL that checks it, if there is any."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def sql_round(x: str, digits: int = 0) -> str:
    return f"floor(({x}) * {10**digits}.0 + 0.5) / {10**digits}.0" if digits else f"CAST(floor(({x}) + 0.5) AS BIGINT)"


def sql_haversine(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371000.0 * asin(sqrt(least(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2), 1.0)))"


def sql_km(a: str, b: str, c: str, d: str, lat: float = 47.61) -> str:
    return f"sqrt(pow(({a} - {c}) * 111.32, 2) + pow(({b} - {d}) * 111.32 * cos(radians({lat})), 2))"
