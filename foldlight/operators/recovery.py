"""What a restart should do: open work, pending retries, and the class of each execution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlight.functions.predicates import is_ambiguous, is_incomplete_status, is_stop_status, timeout_enforced
from foldlight.operators import fold


def incomplete_tools(calls: DataFrame, *more: str) -> DataFrame:
    """Calls without an outcome; sequence is that of the start, if there was one.  more: further columns of the calls."""
    started = F.col("status") == "STARTED"
    sequence = F.when(started, F.col("started_sequence")).otherwise(F.col("requested_sequence"))
    return calls.where(is_incomplete_status(F.col("status"))).select("execution_id", "call_id", "tool", "status", sequence.alias("sequence"), "attempt", started.alias("was_started"), *more)


def pending_retries(calls: DataFrame) -> DataFrame:
    return calls.where("pending_retry is not null").select("execution_id", "call_id", "tool", F.col("pending_retry.attempt").alias("attempt"), F.col("pending_retry.failed_attempt").alias("failed_attempt"), F.col("pending_retry.delay").alias("delay"), F.col("pending_retry.sequence").alias("sequence"))


def stopped_calls(calls: DataFrame) -> DataFrame:
    """Failed, timed-out and cancelled calls; enforced is null but for timeouts."""
    return calls.where(is_stop_status(F.col("status"))).select("execution_id", "call_id", "tool", "status", "error", timeout_enforced(F.col("status"), F.col("enforced")).alias("enforced"))


def ambiguous_timeouts(calls: DataFrame) -> DataFrame:
    """Timeouts that may have left a side effect; with a key, the effect itself is ambiguous."""
    return calls.where(is_ambiguous(F.col("status"), F.col("enforced"))).select("execution_id", "call_id", "tool", F.col("completed_sequence").alias("sequence"), F.col("idempotency_key").isNotNull().alias("ambiguous_effect"))


def deduplicated_calls(calls: DataFrame) -> DataFrame:
    return calls.where("deduplicated").select("execution_id", "call_id", "tool", "status", "result", "started_sequence", "completed_sequence")


def open_calls(calls: DataFrame) -> DataFrame:
    """The first started call without an outcome of each execution."""
    return calls.where("status = 'STARTED'").groupBy("execution_id").agg(F.min_by(F.struct("call_id", "tool", "started_sequence"), "requested_sequence").alias("c")).select("execution_id", "c.*")


def recovery_class(status: Column, unresolved_keys: Column, pending: Column) -> Column:
    return F.when(status.isin("COMPLETED", "FAILED", "CANCELLED"), status).when((status == "RECOVERY_REQUIRED") | (unresolved_keys > 0), "RECOVERY_REQUIRED").when(pending > 0, "RETRYABLE").otherwise("RUNNING")


def status_with_keys(status: Column, unresolved_keys: Column) -> Column:
    """RUNNING becomes RECOVERY_REQUIRED if a key has no outcome; a recorded end stays."""
    return F.when((status == "RUNNING") & (unresolved_keys > 0), "RECOVERY_REQUIRED").otherwise(status)


def classify(states: DataFrame, unresolved: DataFrame | None = None) -> DataFrame:
    """(execution_id, status, recovery_class, n_incomplete, n_pending, n_unresolved_keys); unresolved: ledger records without outcome."""
    if unresolved is None:
        keyed = states.withColumn("n_unresolved_keys", F.lit(0).cast("long"))
    else:
        counts = unresolved.groupBy("execution_id").agg(F.count("*").alias("n_unresolved_keys"))
        keyed = states.join(counts, "execution_id", "left").withColumn("n_unresolved_keys", F.coalesce("n_unresolved_keys", F.lit(0)))
    return keyed.select("execution_id", status_with_keys(F.col("status"), F.col("n_unresolved_keys")).alias("status"), recovery_class(F.col("status"), F.col("n_unresolved_keys"), F.col("n_pending")).alias("recovery_class"), "n_incomplete", "n_pending", "n_unresolved_keys")


def flags(classified: DataFrame, replayed: DataFrame | None = None) -> DataFrame:
    """(execution_id, needs_resolution, needs_key_resolution, has_pending_retries, events_replayed) of classify's rows.

    replayed: checkpoints.replayed_counts; without it nothing was replayed after a snapshot.
    """
    rows = classified.select("execution_id", (F.col("n_incomplete") > 0).alias("needs_resolution"), (F.col("n_unresolved_keys") > 0).alias("needs_key_resolution"), (F.col("n_pending") > 0).alias("has_pending_retries"))
    if replayed is None:
        return rows.withColumn("events_replayed", F.lit(0).cast("long"))
    return rows.join(replayed.select("execution_id", F.col("n_replayed").alias("events_replayed")), "execution_id", "left").withColumn("events_replayed", F.coalesce("events_replayed", F.lit(0)))


def snapshots(states: DataFrame, calls: DataFrame, attempts: DataFrame, checkpoints: DataFrame | None = None) -> DataFrame:
    """(execution_id, snapshot): the state of each execution as one JSON text, with its calls, open calls and scheduled retries.

    checkpoints: (execution_id, sequence), for the latest one's place.  For executions of ordinary size, as checkpoint rows are.
    """
    by = lambda rows, order, name: rows.groupBy("execution_id").agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in rows.columns if c not in ("execution_id", order)]))).alias(name))
    joined = states.join(by(fold.with_attempts(calls, attempts), "requested_sequence", "tool_calls"), "execution_id", "left")
    joined = joined.join(by(incomplete_tools(calls), "sequence", "incomplete_tools"), "execution_id", "left").join(by(pending_retries(calls), "sequence", "pending_retries"), "execution_id", "left")
    if checkpoints is None:
        joined = joined.withColumn("latest_checkpoint", F.lit(None).cast("long"))
    else:
        joined = joined.join(checkpoints.groupBy("execution_id").agg(F.max("sequence").alias("latest_checkpoint")), "execution_id", "left")
    lists = [F.coalesce(c, F.array()).alias(c) for c in ("tool_calls", "incomplete_tools", "pending_retries")]
    return joined.select("execution_id", F.to_json(F.struct("execution_id", "status", "goal", "last_sequence", "result", "error", "latest_checkpoint", *lists)).alias("snapshot"))


def listing(states: DataFrame, checkpoints: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(execution_id, status, n_events, n_checkpoints, n_unresolved_keys)."""
    saved = checkpoints.groupBy("execution_id").agg(F.count("*").alias("n_checkpoints"))
    keys = unresolved.groupBy("execution_id").agg(F.count("*").alias("n_unresolved_keys"))
    joined = states.join(saved, "execution_id", "left").join(keys, "execution_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("execution_id", status_with_keys(F.col("status"), F.coalesce("n_unresolved_keys", F.lit(0))).alias("status"), "n_events", zero("n_checkpoints"), zero("n_unresolved_keys"))


def resolutions(decisions: DataFrame, calls: DataFrame, states: DataFrame) -> DataFrame:
    """Event rows that settle open calls; decisions: (execution_id, call_id, action, result, error), action as below.

    Decisions on calls that are not open give no row.  Several for one execution follow each other by call_id.
    """
    from pyspark.sql import Window

    # Actions and the events that they record.
    event = F.when(F.col("action") == "mark_completed", "ToolCompleted").when(F.col("action") == "mark_failed", "ToolFailed").when(F.col("action") == "cancel", "ToolCancelled")
    open_ = calls.where(is_incomplete_status(F.col("status"))).select("execution_id", "call_id", "tool", "attempt")
    rows = decisions.join(open_, ["execution_id", "call_id"]).join(states.select("execution_id", "last_sequence"), "execution_id").withColumn("event_type", event).where("event_type is not null")
    n = F.row_number().over(Window.partitionBy("execution_id").orderBy("call_id"))
    return rows.select("execution_id", (F.col("last_sequence") + n).cast("long").alias("sequence"), "event_type", "call_id", "tool", F.greatest("attempt", F.lit(1)).alias("attempt"), F.when(F.col("action") == "mark_completed", F.col("result")).alias("result"), F.when(F.col("action") != "mark_completed", F.col("error")).alias("error"), F.col("action").alias("resolution"))
