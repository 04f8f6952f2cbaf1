"""The fold of a journal into call, attempt and execution state.

Every field of the state belongs to the last event of some types, so the fold is a grouped maximum over structs that
start with the sequence.  Maxima merge: `partial_*` of two parts of a journal, united and merged, is that of the whole.
This makes checkpoints plus later events and the full fold the same plan.  One field hangs on the order of a call's events:
an outcome of the attempt that the call is on takes over the call's last start (`carried`, a window by call).

Events are decoded journals (see sources.journal.decode); missing columns count as null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlight import schemas as S
from foldlight.functions.predicates import attempt_number, is_incomplete_status, mapped

CALL = ("execution_id", "call_id")
_REQUEST = ("tool", "arguments", "idempotency_key", "timeout", "timeout_mode", "deduplicated", "retry_policy")


def conform(events: DataFrame) -> DataFrame:
    """The decoded journal's columns, with nulls for those that it lacks."""
    missing = {k: F.lit(None).cast(t) for k, t in (S.PAYLOAD | {"timestamp": "string"}).items() if k not in events.columns}
    return events.withColumns(missing) if missing else events


def _last(condition: Column, *fields: Column | str) -> Column:
    """The fields at the highest sequence among rows that meet the condition."""
    return F.max(F.when(condition, F.struct("sequence", *fields)))


def _of(*types: str) -> Column:
    return F.col("event_type").isin(*types)


_CALL_MAXIMA = ("last", "tried", "settled", "started", "retry")
_ATTEMPT_MAXIMA = ("last", "started", "settled", "scheduled")


def _settled(*also: Column | str) -> Column:
    completed = F.col("event_type") == "ToolCompleted"
    return _last(_of(*S.SETTLING_EVENTS), F.when(completed, F.col("result")).alias("result"), F.when(~completed, F.col("error")).alias("error"), *also)


def carried(events: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The events with what each finds of its call: _before, the attempt of the last start or outcome, and _begun, the last start.

    base: partial calls of all events before these.  Events that have the columns stay as they are.
    """
    if "_before" in events.columns:
        return events
    earlier = Window.partitionBy(*CALL).orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda condition, value: F.last(F.when(condition, value), ignorenulls=True).over(earlier)
    trying = _of("ToolStarted", *S.SETTLING_EVENTS)
    e = conform(events).withColumns({"_before": last(trying, attempt_number(F.col("attempt"))), "_begun": last(_of("ToolStarted"), F.struct("sequence", "timestamp"))})
    if base is None:
        return e
    at = base.groupBy(*CALL).agg(F.max("tried").alias("_tried"), F.max("started").alias("_started"))
    found = {"_before": F.coalesce("_before", "_tried.attempt"), "_begun": F.coalesce("_begun", F.struct("_started.sequence", "_started.timestamp"))}
    return e.join(at, list(CALL), "left").withColumns(found).drop("_tried", "_started")


def _call_partials() -> dict[str, Column]:
    timed = _of("ToolTimedOut")
    retry = (F.col("event_type") == "ToolRetryScheduled").alias("pending"), attempt_number(F.col("attempt")).alias("attempt"), "failed_attempt", "delay", "reason", "error"
    return {
        "last": _last(F.lit(True), "event_type"),
        "tried": _last(~_of("ToolRequested", "ToolRetryScheduled"), attempt_number(F.col("attempt")).alias("attempt")),
        "settled": _settled(F.when(timed, F.col("timeout")).alias("timeout"), F.when(timed, F.col("enforced")).alias("enforced")),
        "started": _last(_of("ToolStarted"), "timestamp"),
        "retry": _last(_of("ToolRetryScheduled", "ToolStarted", "ToolCancelled"), *retry),
        "requests": F.collect_list(F.when(_of("ToolRequested"), F.struct("sequence", *_REQUEST))),
    }


def partial_calls(events: DataFrame) -> DataFrame:
    """One row per call and part of a journal: the last events of each kind, and all its requests."""
    e = conform(events).where(_of(*S.TOOL_EVENTS))
    return e.groupBy(*CALL).agg(*[v.alias(k) for k, v in _call_partials().items()])


def _merged_calls() -> list[Column]:
    return [*[F.max(c).alias(c) for c in _CALL_MAXIMA], F.flatten(F.collect_list("requests")).alias("requests")]


def merge_calls(partials: DataFrame) -> DataFrame:
    """One row per call from the partials of parts of a journal."""
    return partials.groupBy(*CALL).agg(*_merged_calls())


def finish_calls(partials: DataFrame, *also: Column) -> DataFrame:
    """Call state, one row per request; a later request of a known call_id is a row of its own that stays REQUESTED.

    Calls without a request are left out: see validation.orphan_call_events.  also: further columns of the partials.
    """
    each = partials.select("*", F.posexplode(F.array_sort("requests")).alias("nth", "request"))
    first = F.col("nth") == 0
    mine = lambda c: F.when(first, c)
    retry = F.when(first & F.col("retry.pending"), F.col("retry"))
    return each.select(
        *CALL,
        *[F.col(f"request.{c}").alias(c) for c in _REQUEST],
        F.when(first, mapped(F.col("last.event_type"), S.CALL_STATUS)).otherwise("REQUESTED").alias("status"),
        F.coalesce(mine(F.col("tried.attempt")), F.lit(0)).alias("attempt"),
        mine(F.col("settled.result")).alias("result"),
        mine(F.col("settled.error")).alias("error"),
        mine(F.col("settled.enforced")).alias("enforced"),
        F.col("request.sequence").alias("requested_sequence"),
        F.coalesce(mine(F.col("started.sequence")), F.lit(0)).cast("long").alias("started_sequence"),
        mine(F.col("started.timestamp")).alias("started_at"),
        F.coalesce(mine(F.col("settled.sequence")), F.lit(0)).cast("long").alias("completed_sequence"),
        F.when(retry.isNotNull(), F.struct(retry["attempt"].alias("attempt"), F.coalesce(retry["failed_attempt"], F.greatest(retry["attempt"] - 1, F.lit(0))).alias("failed_attempt"), F.coalesce(retry["delay"], F.lit(0.0)).alias("delay"), F.coalesce(retry["reason"], F.lit("")).alias("reason"), retry["error"].alias("error"), retry["sequence"].alias("sequence"))).alias("pending_retry"),
        *also,
    )


def fold_calls(events: DataFrame) -> DataFrame:
    return finish_calls(partial_calls(events))


def _attempt_of() -> Column:
    """The attempt that an event belongs to: a retry to the one that failed."""
    number = attempt_number(F.col("attempt"))
    failed = F.coalesce(F.nullif("failed_attempt", F.lit(0)), F.greatest(number - 1, F.lit(1)))
    return F.when(_of("ToolRetryScheduled"), failed).otherwise(number)


def _attempt_start() -> Column:
    """The last event that set an attempt's start, with that start: a start, or an outcome that found the call on this attempt, for
    which the call's last start stands, be it another attempt's."""
    took = _of(*S.SETTLING_EVENTS) & (F.col("_before") == attempt_number(F.col("attempt"))) & (F.col("_begun.sequence") > 0)
    own = F.struct("sequence", F.col("sequence").alias("at"), "timestamp")
    return F.max(F.when(_of("ToolStarted"), own).when(took, F.struct("sequence", F.col("_begun.sequence").alias("at"), F.col("_begun.timestamp").alias("timestamp"))))


def _attempt_partials() -> dict[str, Column]:
    trying = ~_of("ToolRequested", "ToolRetryScheduled")
    return {
        "last": _last(trying, "event_type"),
        "first_sequence": F.min(F.when(trying, F.col("sequence"))),
        "started": _attempt_start(),
        "settled": _settled("enforced"),
        "scheduled": _last(_of("ToolRetryScheduled"), "delay", "reason", attempt_number(F.col("attempt")).alias("attempt")),
    }


def partial_attempts(events: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """One row per call, attempt and part of a journal; base: partial calls of the parts before it."""
    e = carried(conform(events).where(_of(*S.TOOL_EVENTS[1:])), base)
    return e.withColumn("number", _attempt_of()).groupBy(*CALL, "number").agg(*[v.alias(k) for k, v in _attempt_partials().items()])


def merge_attempts(partials: DataFrame) -> DataFrame:
    return partials.groupBy(*CALL, "number").agg(*[F.max(c).alias(c) for c in _ATTEMPT_MAXIMA], F.min("first_sequence").alias("first_sequence"))


def _attempt_fields(partial: Callable[[str], Column]) -> list[Column]:
    """An attempt's state from its partial, of which `partial` gives the columns."""
    last, started, settled, scheduled = (partial(c) for c in _ATTEMPT_MAXIMA)
    mine = lambda c: F.when(last["event_type"] != "ToolStarted", settled[c])
    return [
        partial("number").alias("attempt"),
        mapped(last["event_type"], S.CALL_STATUS).alias("status"),
        F.coalesce(started["at"], F.lit(0)).cast("long").alias("started_sequence"),
        started["timestamp"].alias("started_at"),
        F.coalesce(mine("sequence"), F.lit(0)).cast("long").alias("completed_sequence"),
        mine("result").alias("result"),
        mine("error").alias("error"),
        scheduled["sequence"].alias("retry_sequence"),
        scheduled["attempt"].alias("retry_attempt"),
        scheduled["delay"].alias("retry_delay"),
    ]


def finish_attempts(partials: DataFrame) -> DataFrame:
    """Attempt state; the settled fields are those of a settling last event only.  A retry of an attempt never made is left out."""
    return partials.where("last is not null").select(*CALL, *_attempt_fields(F.col), "first_sequence")


def fold_attempts(events: DataFrame) -> DataFrame:
    return finish_attempts(partial_attempts(events))


def with_attempts(calls: DataFrame, attempts: DataFrame) -> DataFrame:
    """Calls with an array of their attempts in order of appearance."""
    rest = [c for c in attempts.columns if c not in (*CALL, "first_sequence")]
    listed = attempts.groupBy(*CALL).agg(F.array_sort(F.collect_list(F.struct("first_sequence", *rest))).alias("attempts"))
    return calls.join(listed, list(CALL), "left").withColumn("attempts", F.coalesce("attempts", F.array()))


def fold_whole_calls(events: DataFrame) -> DataFrame:
    """with_attempts(fold_calls, fold_attempts) in one pass: events are folded by attempt, and attempts, which are few, by call.

    A call's requests are a part of their own, with the number 0 that no attempt has.
    """
    e = carried(conform(events).where(_of(*S.TOOL_EVENTS))).withColumn("number", F.when(_of("ToolRequested"), F.lit(0)).otherwise(_attempt_of()))
    tried = {f"try_{k}": v for k, v in _attempt_partials().items()}
    parts = e.groupBy(*CALL, "number").agg(*[v.alias(k) for k, v in (_call_partials() | tried).items()])
    field = lambda c: F.col("number" if c == "number" else f"try_{c}")
    attempt = F.when(F.col("try_last").isNotNull(), F.struct(F.col("try_first_sequence").alias("first_sequence"), *_attempt_fields(field)))
    return finish_calls(parts.groupBy(*CALL).agg(*_merged_calls(), F.array_sort(F.collect_list(attempt)).alias("attempts")), F.col("attempts"))


def partial_executions(events: DataFrame) -> DataFrame:
    e = conform(events)
    return e.groupBy("execution_id").agg(
        F.max("sequence").alias("last_sequence"),
        F.count("*").alias("n_events"),
        _last(_of(*S.LIFECYCLE_EVENTS), "event_type").alias("lifecycle"),
        _last(_of("ExecutionStarted"), "goal").alias("begun"),
        _last(_of("ExecutionCompleted", "ExecutionCancelled"), "result").alias("ended"),
        _last(_of("ExecutionFailed"), "error").alias("failed"),
    )


def merge_executions(partials: DataFrame) -> DataFrame:
    return partials.groupBy("execution_id").agg(F.max("last_sequence").alias("last_sequence"), F.sum("n_events").alias("n_events"), *[F.max(c).alias(c) for c in ("lifecycle", "begun", "ended", "failed")])


def finish_executions(partials: DataFrame, calls: DataFrame) -> DataFrame:
    """Execution state: a RUNNING execution with an incomplete call is RECOVERY_REQUIRED."""
    counted = calls.groupBy("execution_id").agg(F.count("*").alias("n_calls"), F.count_if(is_incomplete_status(F.col("status"))).alias("n_incomplete"), F.count_if(F.col("pending_retry").isNotNull()).alias("n_pending"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    stored = F.coalesce(mapped(F.col("lifecycle.event_type"), S.EXECUTION_STATUS), F.lit("RUNNING"))
    joined = partials.join(counted, "execution_id", "left").withColumn("stored_status", stored)
    status = F.when((F.col("stored_status") == "RUNNING") & (F.coalesce("n_incomplete", F.lit(0)) > 0), "RECOVERY_REQUIRED").otherwise(F.col("stored_status"))
    return joined.select("execution_id", status.alias("status"), "stored_status", F.col("begun.goal").alias("goal"), F.col("ended.result").alias("result"), F.col("failed.error").alias("error"), F.col("last_sequence").cast("long").alias("last_sequence"), F.col("n_events").cast("long").alias("n_events"), zero("n_calls"), zero("n_incomplete"), zero("n_pending"))


def fold_executions(events: DataFrame) -> DataFrame:
    return finish_executions(partial_executions(events), fold_calls(events))


def sequential_calls(events: DataFrame) -> DataFrame:
    """The same call state (status, attempt, result, error, sequences, pending) by a literal walk over each call's events.

    A higher-order function over the sorted events of a call: for comparison with fold_calls, not for large calls.
    """
    e = conform(events).where(_of(*S.TOOL_EVENTS))
    result_type, error_type = e.schema["result"].dataType.simpleString(), e.schema["error"].dataType.simpleString()
    listed = e.groupBy(*CALL).agg(F.array_sort(F.collect_list(F.struct("sequence", "event_type", attempt_number(F.col("attempt")).alias("attempt"), "result", "error"))).alias("events"))
    start = f"named_struct('status', cast(null as string), 'attempt', 0, 'result', cast(null as {result_type}), 'error', cast(null as {error_type}), 'requested', 0L, 'started', 0L, 'completed', 0L, 'pending', cast(null as bigint))"
    settle = "('ToolCompleted','ToolFailed','ToolTimedOut','ToolCancelled')"
    step = f"""named_struct(
      'status', case when x.event_type = 'ToolRequested' and s.status is not null then s.status {" ".join(f"when x.event_type = '{k}' then '{v}'" for k, v in S.CALL_STATUS.items())} end,
      'attempt', if(x.event_type in ('ToolRequested', 'ToolRetryScheduled'), s.attempt, x.attempt),
      'result', if(x.event_type in {settle}, if(x.event_type = 'ToolCompleted', x.result, null), s.result),
      'error', if(x.event_type in {settle}, if(x.event_type = 'ToolCompleted', null, x.error), s.error),
      'requested', if(x.event_type = 'ToolRequested' and s.status is null, x.sequence, s.requested),
      'started', if(x.event_type = 'ToolStarted', x.sequence, s.started),
      'completed', if(x.event_type in {settle}, x.sequence, s.completed),
      'pending', case when x.event_type = 'ToolRetryScheduled' then x.sequence when x.event_type in ('ToolStarted', 'ToolCancelled') then null else s.pending end)"""
    state = F.expr(f"aggregate(events, {start}, (s, x) -> {step})")
    return listed.select(*CALL, state.alias("s")).select(*CALL, "s.status", "s.attempt", "s.result", "s.error", F.col("s.requested").alias("requested_sequence"), F.col("s.started").alias("started_sequence"), F.col("s.completed").alias("completed_sequence"), F.col("s.pending").alias("pending_sequence"))
