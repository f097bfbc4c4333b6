"""Segments that run along the line of two bridges, which are equally far from both but for rounding."""

import duckdb
from chronomesh.plans.registry import oracle_sql, queries

from .oracle import compare

KEYS = (48, 66, 144, 147, 165, 246, 264, 469, 794, 2235, 2334, 3180, 3279, 3297, 3378, 3396, 4079, 4224, 4242, 4323, 4440, 5286, 5385)


def test_bridges_that_are_equally_far_are_told_apart_as_in_the_sql(spark, tmp_path):
    duckdb.connect().execute(f"COPY (SELECT CAST(unnest({list(KEYS)}) AS BIGINT) AS s_suppkey) TO '{tmp_path}/supplier.parquet'")
    for name in ("j16_nearest_bridge", "t3_two_crossings"):
        assert compare(spark, name, queries()[name], oracle_sql()[name], str(tmp_path))
