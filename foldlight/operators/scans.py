"""Scans and lookups over journals and checkpoints, for one execution or for many at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def execution_events(events: DataFrame, execution_id: str) -> DataFrame:
    return events.where(F.col("execution_id") == execution_id).orderBy("sequence")


def tail(events: DataFrame, offsets: DataFrame) -> DataFrame:
    """Events strictly after each execution's offset; offsets: (execution_id, after), all events without one."""
    return events.join(offsets, "execution_id", "left").where(F.col("sequence") > F.coalesce("after", F.lit(0))).drop("after")


def prefix(events: DataFrame, limits: DataFrame) -> DataFrame:
    """Events up to each execution's limit; limits: (execution_id, upto)."""
    return events.join(limits, "execution_id").where("sequence <= upto").drop("upto")


def point(events: DataFrame, execution_id: str, sequence: int) -> DataFrame:
    return events.where((F.col("execution_id") == execution_id) & (F.col("sequence") == sequence))


def last_sequences(events: DataFrame) -> DataFrame:
    return events.groupBy("execution_id").agg(F.max("sequence").alias("last_sequence"))


def last_events(events: DataFrame) -> DataFrame:
    """The event of the highest sequence of each execution; partial aggregates, no sort."""
    rest = [c for c in events.columns if c != "execution_id"]
    return events.groupBy("execution_id").agg(F.max_by(F.struct(*rest), "sequence").alias("e")).select("execution_id", "e.*")


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("execution_id").agg(F.count("*").alias("n_events"))


def execution_ids(events: DataFrame) -> DataFrame:
    return events.select("execution_id").distinct().orderBy("execution_id")


def existing(keys: DataFrame, events: DataFrame) -> DataFrame:
    """The execution_ids of `keys` that have a journal."""
    return keys.join(events.select("execution_id"), "execution_id", "left_semi")


def latest_checkpoints(checkpoints: DataFrame) -> DataFrame:
    return last_events(checkpoints)


def checkpoint_at(checkpoints: DataFrame, execution_id: str, sequence: int) -> DataFrame:
    return point(checkpoints, execution_id, sequence)


def checkpoint_counts(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.groupBy("execution_id").agg(F.count("*").alias("n_checkpoints"))


def checkpoints_of(checkpoints: DataFrame, execution_id: str) -> DataFrame:
    """An execution's checkpoints in order."""
    return execution_events(checkpoints, execution_id)


def checkpointed_ids(checkpoints: DataFrame) -> DataFrame:
    """The executions that have a checkpoint, in order; `existing` says which of given ones have."""
    return execution_ids(checkpoints)
