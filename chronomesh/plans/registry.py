"""Every query on the driver's tables, with the SQL that checks it."""

from __future__ import annotations

from . import archives, feeds, layouts, scalar, spatial  # noqa: F401  they register their queries
from .catalog import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
