"""Shared plumbing: tables, Arrow batches bounded in bytes, and empty-safe Arrow output; staging is foldlight.staging's."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foldlight.shipping import ship
from foldlight.staging import discard, new_path, release, staged

__all__ = ["bounded_batches", "discard", "in_arrow", "new_path", "record", "release", "staged", "table", "unused"]

#: Bytes of an Arrow batch: a task holds a few of them, in the JVM and in Python.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lets workers import the operators, and bounds Arrow batches in bytes, not only in rows: texts may be very long.

    The bound is a setting of the session, which has no form for a single plan.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) over bounded batches."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch with the columns of `schema` from arrays."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)
