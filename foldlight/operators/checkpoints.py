"""Checkpoints: stored partial folds, and state from a checkpoint plus the events after it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlight import schemas as S
from foldlight.operators import fold, validation
from foldlight.operators.scans import prefix, tail
from foldlight.sources import journal
from foldlight.staging import staged


@dataclass(frozen=True)
class Snapshot:
    """Partial folds of a prefix of each execution; `at`: (execution_id, sequence), where each was taken.

    Kept as tables by call, so that no execution's state has to fit in one row.
    """

    at: DataFrame
    calls: DataFrame
    attempts: DataFrame
    executions: DataFrame

    def write(self, path: str) -> None:
        for name in ("at", "calls", "attempts", "executions"):
            getattr(self, name).write.parquet(f"{path}/{name}")

    @staticmethod
    def read(spark, path: str) -> "Snapshot":
        return Snapshot(*(spark.read.parquet(f"{path}/{name}") for name in ("at", "calls", "attempts", "executions")))


@dataclass(frozen=True)
class States:
    calls: DataFrame
    attempts: DataFrame
    executions: DataFrame


def take(events: DataFrame, limits: DataFrame | None = None) -> Snapshot:
    """A snapshot at each execution's end, or at its limit; limits: (execution_id, upto)."""
    part = events if limits is None else prefix(events, limits)
    at = part.groupBy("execution_id").agg(F.max("sequence").alias("sequence"))
    return Snapshot(at, fold.partial_calls(part), fold.partial_attempts(part), fold.partial_executions(part))


def recover(events: DataFrame, snapshot: Snapshot | None = None) -> States:
    """States from a snapshot and the events after it; executions without a snapshot are folded whole."""
    if snapshot is None:
        calls = fold.fold_calls(events)
        return States(calls, fold.fold_attempts(events), fold.finish_executions(fold.partial_executions(events), calls))
    return recover_after(tail(events, snapshot.at.withColumnRenamed("sequence", "after")), snapshot)


def recover_after(later: DataFrame, snapshot: Snapshot) -> States:
    """States from a snapshot and the events after it, of which none is in the snapshot."""
    calls = fold.finish_calls(fold.merge_calls(snapshot.calls.unionByName(fold.partial_calls(later))))
    attempts = fold.finish_attempts(fold.merge_attempts(snapshot.attempts.unionByName(fold.partial_attempts(later, snapshot.calls))))
    executions = fold.merge_executions(snapshot.executions.unionByName(fold.partial_executions(later)))
    return States(calls, attempts, fold.finish_executions(executions, calls))


def ahead_of_journal(snapshot: Snapshot, events: DataFrame) -> DataFrame:
    """Executions whose snapshot stands after their journal's end: their state must not be recovered from it."""
    last = events.groupBy("execution_id").agg(F.max("sequence").alias("last_sequence"))
    return snapshot.at.join(last, "execution_id", "left").where("sequence > coalesce(last_sequence, 0)")


def replayed_counts(events: DataFrame, snapshot: Snapshot) -> DataFrame:
    """(execution_id, snapshot_sequence, n_replayed): events that a recovery reads after the snapshot."""
    later = events.join(snapshot.at.select("execution_id", F.col("sequence").alias("snapshot_sequence")), "execution_id", "left").withColumn("snapshot_sequence", F.coalesce("snapshot_sequence", F.lit(0)))
    return later.groupBy("execution_id", "snapshot_sequence").agg(F.count_if(F.col("sequence") > F.col("snapshot_sequence")).alias("n_replayed"))


def state_as_of(events: DataFrame, limits: DataFrame) -> States:
    """States after each execution's first events; limits: (execution_id, upto)."""
    return recover(prefix(events, limits))


def difference(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of either that the other lacks; empty if both hold the same rows."""
    return one.exceptAll(other).withColumn("side", F.lit("one")).unionByName(other.exceptAll(one).withColumn("side", F.lit("other")))


def rows(events: DataFrame) -> DataFrame:
    """Checkpoint rows at each execution's end: execution_id, sequence, state (JSON).

    The stored status is RUNNING where open calls make it RECOVERY_REQUIRED: that is derived again on reading.  The state
    of an execution is one JSON text, so this suits executions of ordinary size; `take` has no such bound.
    """
    return state_rows(recover(events))


def state_rows(states: States) -> DataFrame:
    """The checkpoint rows of states; see rows."""
    calls = fold.with_attempts(states.calls, states.attempts)
    listed = calls.groupBy("execution_id").agg(F.array_sort(F.collect_list(F.struct("requested_sequence", *[c for c in calls.columns if c not in ("execution_id", "requested_sequence")]))).alias("tool_calls"))
    joined = states.executions.join(listed, "execution_id", "left")
    state = F.to_json(F.struct("execution_id", F.col("stored_status").alias("status"), "goal", "tool_calls", "last_sequence", "result", "error"))
    return joined.select("execution_id", F.col("last_sequence").alias("sequence"), state.alias("state"))


def _state_type(result: str, error: str) -> str:
    outcome = f"result: {result}, error: {error}"
    retry = f"struct<attempt: int, failed_attempt: int, delay: double, reason: string, error: {error}, sequence: bigint>"
    attempts = f"array<struct<first_sequence: bigint, attempt: int, status: string, started_sequence: bigint, started_at: string, completed_sequence: bigint, {outcome}, retry_sequence: bigint, retry_attempt: int, retry_delay: double>>"
    call = (
        "requested_sequence: bigint, call_id: string, tool: string, arguments: string, idempotency_key: string, timeout: double, timeout_mode: string, deduplicated: boolean, retry_policy: string, "
        f"status: string, attempt: int, {outcome}, enforced: boolean, started_sequence: bigint, started_at: string, completed_sequence: bigint, pending_retry: {retry}, attempts: {attempts}"
    )
    return f"struct<execution_id: string, status: string, goal: string, tool_calls: array<struct<{call}>>, last_sequence: bigint, {outcome}>"


def decode(stored: DataFrame, result: str = "string", error: str = "string") -> DataFrame:
    """Checkpoint rows with their state (JSON) as a struct; result and error: types of the journal's columns.  For rows that
    validation.checkpoint_violations lets pass."""
    return stored.withColumn("state", F.from_json("state", _state_type(result, error)))


def from_rows(stored: DataFrame, result: str = "string", error: str = "string") -> Snapshot:
    """A snapshot from stored checkpoint rows, one an execution: what `recover` continues with the events after it.

    A call's state names the last event of each kind, which is all that the fold of later events needs; sequences are
    gapless, so an execution has as many events as its last sequence says.
    """
    rows_ = decode(stored, result, error).select("execution_id", "sequence", "state")
    event = lambda status, table: F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair[::-1]]), status)
    when = lambda at, *fields: F.when(at > 0, F.struct(at.alias("sequence"), *fields))
    c = lambda name: F.col(f"c.{name}")
    each = rows_.select("execution_id", F.explode("state.tool_calls").alias("c"))
    retry = c("pending_retry")
    first = each.select(
        "execution_id",
        c("call_id").alias("call_id"),
        c("requested_sequence").alias("requested_sequence"),
        F.struct(F.greatest(c("requested_sequence"), c("started_sequence"), c("completed_sequence"), retry["sequence"]).alias("sequence"), event(c("status"), S.CALL_STATUS).alias("event_type")).alias("last"),
        F.when(c("attempt") > 0, F.struct(F.greatest(c("started_sequence"), c("completed_sequence")).alias("sequence"), c("attempt").alias("attempt"))).alias("tried"),
        when(c("completed_sequence"), c("result").alias("result"), c("error").alias("error"), F.when(c("enforced").isNotNull(), c("timeout")).alias("timeout"), c("enforced").alias("enforced")).alias("settled"),
        when(c("started_sequence"), c("started_at").alias("timestamp")).alias("started"),
        F.when(retry.isNotNull(), F.struct(retry["sequence"].alias("sequence"), F.lit(True).alias("pending"), retry["attempt"].alias("attempt"), retry["failed_attempt"].alias("failed_attempt"), retry["delay"].alias("delay"), retry["reason"].alias("reason"), retry["error"].alias("error"))).alias("retry"),
        F.struct(c("requested_sequence").alias("sequence"), *[c(x).alias(x) for x in fold._REQUEST]).alias("request"),
    )
    # Later requests of a known call_id add their request only.
    names = ("last", "tried", "settled", "started", "retry")
    calls = first.groupBy(*fold.CALL).agg(F.min_by(F.struct(*names), "requested_sequence").alias("f"), F.array_sort(F.collect_list("request")).alias("requests")).select(*fold.CALL, *[F.col(f"f.{x}").alias(x) for x in names], "requests")
    a = lambda name: F.col(f"a.{name}")
    tried = each.select("execution_id", c("call_id").alias("call_id"), c("enforced").alias("enforced"), F.explode(c("attempts")).alias("a"))
    attempts = tried.select(
        *fold.CALL,
        a("attempt").alias("number"),
        F.struct(F.greatest(a("started_sequence"), a("completed_sequence")).alias("sequence"), event(a("status"), S.CALL_STATUS).alias("event_type")).alias("last"),
        a("first_sequence").alias("first_sequence"),
        when(a("started_sequence"), a("started_sequence").alias("at"), a("started_at").alias("timestamp")).alias("started"),
        when(a("completed_sequence"), a("result").alias("result"), a("error").alias("error"), F.when(a("status") == "TIMED_OUT", F.col("enforced")).alias("enforced")).alias("settled"),
        when(a("retry_sequence"), a("retry_delay").alias("delay"), F.lit(None).cast("string").alias("reason"), a("retry_attempt").alias("attempt")).alias("scheduled"),
    ).dropDuplicates([*fold.CALL, "number"])
    s = lambda name: F.col(f"state.{name}")
    last = s("last_sequence")
    executions = rows_.select(
        "execution_id",
        last.alias("last_sequence"),
        last.alias("n_events"),
        F.struct(last.alias("sequence"), event(s("status"), S.EXECUTION_STATUS).alias("event_type")).alias("lifecycle"),
        F.struct(F.lit(1).cast("long").alias("sequence"), s("goal").alias("goal")).alias("begun"),
        # Kept whatever the status: an execution that was started again still has the outcome of its first run.
        F.struct(last.alias("sequence"), s("result").alias("result")).alias("ended"),
        F.struct(last.alias("sequence"), s("error").alias("error")).alias("failed"),
    )
    return Snapshot(rows_.select("execution_id", "sequence"), calls, attempts, executions)


def guarded(candidates: DataFrame, stored: DataFrame, events: DataFrame) -> DataFrame:
    """Candidate rows (execution_id, sequence, state) with a verdict: `store`, `already stored`, or why they must not be stored.

    A checkpoint holds a whole state (validation.state_fault), stands at its journal's last event, its state says so, and no other
    state is stored for that sequence.
    """
    return guarded_at(candidates, stored, events.groupBy("execution_id").agg(F.max("sequence").alias("last_sequence")))


def guarded_at(candidates: DataFrame, stored: DataFrame, last: DataFrame) -> DataFrame:
    """`guarded` where the journals' last sequences are known: (execution_id, last_sequence)."""
    known = last.select("execution_id", F.col("last_sequence").alias("_last"))
    there = stored.groupBy("execution_id", "sequence").agg(F.collect_set(F.coalesce(F.to_json(F.try_parse_json("state")), "state", F.lit(""))).alias("_stored"))
    stated = F.expr("try_cast(get_json_object(state, '$.last_sequence') as bigint)")
    fault = validation.state_fault("state", "execution_id")
    verdict = (
        F.when(F.col("sequence") < 1, "no event")
        .when(fault.isNotNull(), fault)
        .when(stated != F.col("sequence"), "state is at another sequence")
        .when(F.coalesce("_last", F.lit(0)) < F.col("sequence"), "ahead of journal")
        .when(F.col("_last") > F.col("sequence"), "behind journal")
        .when(F.col("_stored") == F.array(F.to_json(F.try_parse_json("state"))), "already stored")
        .when(F.size("_stored") > 0, "another state is stored")
        .otherwise("store")
    )
    joined = candidates.join(known, "execution_id", "left").join(there, ["execution_id", "sequence"], "left")
    return joined.withColumn("verdict", verdict).drop("_last", "_stored")


def store(candidates: DataFrame, path: str, last: DataFrame) -> DataFrame:
    """Appends the candidates that the guards let pass to the checkpoint rows at `path`; returns all with their verdicts.

    One writer at a time, as for events.  The same candidates stored again are `already stored`.
    """
    spark = candidates.sparkSession
    stored = journal.read_checkpoints(spark, path) if journal.has_rows(spark, path) else spark.createDataFrame([], S.CHECKPOINTS)
    verdicts = staged(guarded_at(candidates, stored, last), "checkpoint-verdicts")
    name = F.concat(F.lit("ckpt_"), "execution_id", F.lit("_"), F.col("sequence").cast("string"))
    new = verdicts.where("verdict = 'store'").select(name.alias("checkpoint_id"), "execution_id", "sequence", "state", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_at"))
    new.write.mode("append").parquet(path)
    return verdicts


def boundaries(events: DataFrame) -> DataFrame:
    """(execution_id, sequence): where an automatic checkpoint is due: ends of executions, and outcomes recorded by a resolution."""
    resolved = F.col("resolution").isNotNull() if "resolution" in events.columns else F.lit(False)
    return events.where(F.col("event_type").isin(*S.TERMINAL_EVENTS) | resolved).select("execution_id", "sequence")


def corrupt(stored: DataFrame, events: DataFrame) -> DataFrame:
    """Stored rows that must stop a recovery, with the reason: none is left out and folded over."""
    return validation.checkpoint_violations(stored, events)
