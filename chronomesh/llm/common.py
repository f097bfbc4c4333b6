"""Helpers that several of the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import forget, settle, shared_dir  # noqa: F401  used by the operators

#: Rows and bytes in one Arrow batch; texts can be long, so batches are kept short.
ROWS_A_BATCH, BYTES_A_BATCH = 256, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = ROWS_A_BATCH) -> DataFrame:
    """mapInArrow over batches of at most `rows` rows and, but for a single row, BYTES_A_BATCH bytes, however large the session's batches are."""

    def light(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows > 1 and batch.nbytes > BYTES_A_BATCH:
            half = batch.num_rows // 2
            yield from light(batch.slice(0, half))
            yield from light(batch.slice(half))
        else:
            yield batch

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield from light(batch.slice(at, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(cut(batches))

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """name, made longer until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, in whatever case."""
    gone = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in gone))


def small_batches(spark: SparkSession) -> None:
    """Bound what the JVM hands to Python at once, unless the session has a tighter bound."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= 1024:
        spark.conf.set(name, "1024")
