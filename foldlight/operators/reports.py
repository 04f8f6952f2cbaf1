"""States and mismatches as text, one row an execution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlight.operators import recovery


def _section(rows: DataFrame, title: str, order: Column, line: Column, name: str) -> DataFrame:
    """(execution_id, name): a titled list of lines."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("line")))), lambda x: F.concat(F.lit("\n  "), x["line"]))
    return rows.groupBy("execution_id").agg(F.concat(F.lit(f"\n{title}"), F.array_join(listed, "")).alias(name))


def recovery_report(states: DataFrame, calls: DataFrame, unresolved: DataFrame | None = None, details: bool = False, snapshot_at: DataFrame | None = None) -> DataFrame:
    """(execution_id, report): status and last event, then the open calls, scheduled retries and unresolved keys that there are.

    details: what the state was recovered from, and the open calls' arguments and start times.  snapshot_at: (execution_id,
    sequence) of the checkpoints that it was recovered from.
    """
    more = [F.concat(F.lit("since "), "started_at"), F.concat(F.lit("with "), "arguments")] if details else []
    started = F.when(F.col("was_started"), "started").otherwise("requested")
    open_ = _section(recovery.incomplete_tools(calls, *(("started_at", "arguments") if details else ())), "Open calls:", F.col("sequence"), F.concat_ws(" ", "call_id", "tool", started, F.lit("at"), "sequence", *more), "_open")
    waits = _section(recovery.pending_retries(calls), "Scheduled retries:", F.col("sequence"), F.concat_ws(" ", "call_id", "tool", F.lit("attempt"), "attempt", F.lit("after"), F.concat(F.col("delay").cast("string"), F.lit("s"))), "_waits")
    joined = states.join(open_, "execution_id", "left").join(waits, "execution_id", "left")
    if unresolved is not None:
        keys = _section(unresolved, "Unresolved keys:", F.col("idempotency_key"), F.concat_ws(" ", "idempotency_key", F.lit("claimed by"), "call_id"), "_keys")
        joined = joined.join(keys, "execution_id", "left")
    sections = ["_open", "_waits", *(["_keys"] if unresolved is not None else [])]
    head = F.concat(F.lit("Execution: "), "execution_id", F.lit("\nStatus: "), "status", F.lit("\nLast event: "), F.col("last_sequence").cast("string"))
    if details:
        at = states.select("execution_id").limit(0).withColumn("sequence", F.lit(0)) if snapshot_at is None else snapshot_at
        joined = joined.join(at.select("execution_id", F.col("sequence").alias("_at")), "execution_id", "left")
        checkpoint = F.concat(F.lit("checkpoint at "), F.col("_at").cast("string"), F.lit(", events after it: "), (F.col("last_sequence") - F.col("_at")).cast("string"))
        head = F.concat(head, F.lit("\nRecovered from: "), F.coalesce(checkpoint, F.lit("the whole journal")))
    return joined.select("execution_id", F.concat(head, *[F.coalesce(c, F.lit("")) for c in sections]).alias("report"))


def mismatch_report(mismatches: DataFrame) -> DataFrame:
    """(execution_id, report) of replay.first_mismatches with its `expected` and `received`."""
    side = lambda title, c: F.coalesce(F.concat(F.lit(f"\n{title}: "), c), F.lit(""))
    return mismatches.select("execution_id", F.concat(F.lit("Execution: "), "execution_id", F.lit("\nCall: "), F.col("index").cast("string"), F.lit("\nMismatch: "), "kind", side("Expected", "expected"), side("Received", "received")).alias("report"))
