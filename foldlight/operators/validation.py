"""Integrity rules as queries that return the violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlight import schemas as S
from foldlight.operators import blocks


def sequence_gaps(events: DataFrame) -> DataFrame:
    """(execution_id, sequence, expected): events that do not follow the one before by 1, or stand below 1."""
    checked = blocks.previous(events.select("execution_id", "sequence"), "before")
    return checked.select("execution_id", "sequence", (F.coalesce("before", F.lit(0)) + 1).cast("long").alias("expected")).where("sequence <> expected or sequence < 1")


def duplicate_sequences(events: DataFrame) -> DataFrame:
    return events.groupBy("execution_id", "sequence").agg(F.count("*").alias("n")).where("n > 1")


def duplicate_event_ids(events: DataFrame) -> DataFrame:
    return events.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1")


def unknown_event_types(events: DataFrame) -> DataFrame:
    return events.where(~F.coalesce(F.col("event_type").isin(*S.EVENT_TYPES), F.lit(False)))


def orphan_call_events(events: DataFrame) -> DataFrame:
    """Events of a call before, or without, its request."""
    first = events.where(F.col("event_type") == "ToolRequested").groupBy("execution_id", "call_id").agg(F.min("sequence").alias("requested"))
    later = events.where(F.col("event_type").isin(*S.TOOL_EVENTS[1:])).select("execution_id", "call_id", "sequence", "event_type")
    return later.join(first, ["execution_id", "call_id"], "left").where("requested is null or sequence < requested").drop("requested")


def blank_keys(ops: DataFrame) -> DataFrame:
    return ops.where(F.coalesce(F.trim("idempotency_key"), F.lit("")) == "")


def _present(path: str) -> str:
    """SQL: whether variant lambda variable or column path `v$.k` is there and no JSON null."""
    v, k = path.split("$")
    return f"(try_variant_get({v}, '${k}', 'variant') is not null and not is_variant_null(try_variant_get({v}, '${k}', 'variant')))"


def _get(path: str, kind: str) -> str:
    v, k = path.split("$")
    return f"try_variant_get({v}, '${k}', '{kind}')"


def _no_number(path: str, least: int, most: str | None = None, required: bool = False) -> str:
    """SQL: whether a whole number is unreadable or out of bounds; one that is missing is so if it is required."""
    at = _get(path, "bigint")
    bad = f"coalesce({at} < {least}" + (f" or {at} > {most}" if most else "") + ", true)"
    return bad if required else f"({_present(path)} and {bad})"


def _none_of(path: str, known, required: bool) -> str:
    bad = f"not coalesce({_get(path, 'string')} in ({', '.join(repr(x) for x in known)}), false)"
    return f"({bad})" if required else f"({_present(path)} and {bad})"


def state_fault(state: str, execution_id: str) -> Column:
    """What makes a checkpoint's state (JSON, by its column's name) no state of this execution; null for one that can be folded on.

    One expression over the parsed text: required fields, closed sets, types, and sequences from 1 to the state's last one.  It
    says nothing of the journal: see checkpoint_violations.
    """
    last = _get("v$.last_sequence", "bigint")
    calls, list_of = _get("v$.tool_calls", "array<variant>"), "array<variant>"
    attempt = f"{_none_of('a$.status', S.CALL_STATUS.values(), True)} or {_no_number('a$.attempt', 1, None, True)} or {_no_number('a$.started_sequence', 0, 'last')} or {_no_number('a$.completed_sequence', 0, 'last')}"
    retry = f"{_present('c$.pending_retry')} and ({_no_number('c$.pending_retry.attempt', 1, None, True)} or {_no_number('c$.pending_retry.sequence', 1, 'last', True)} or {_no_number('c$.pending_retry.failed_attempt', 0)} or ({_present('c$.pending_retry.delay')} and {_get('c$.pending_retry.delay', 'double')} is null))"
    rules = [
        ("v is null or try_variant_get(v, '$', 'map<string,variant>') is null", "unreadable state"),
        (f"{last} is null", "state without a last sequence"),
        (f"not {_present('v$.execution_id')}", "state without an execution"),
        (f"{_get('v$.execution_id', 'string')} <> execution", "state of another execution"),
        (_none_of("v$.status", (*S.EXECUTION_STATUS.values(), "RECOVERY_REQUIRED"), True), "unknown status"),
        (f"{_present('v$.tool_calls')} and {calls} is null", "calls are no list"),
        (f"exists({calls}, c -> not {_present('c$.call_id')} or not {_present('c$.tool')})", "call without its name"),
        (f"exists({calls}, c -> {_none_of('c$.status', S.CALL_STATUS.values(), True)})", "unknown call status"),
        (f"exists({calls}, c -> {_no_number('c$.requested_sequence', 1, 'last', True)} or {_no_number('c$.started_sequence', 0, 'last')} or {_no_number('c$.completed_sequence', 0, 'last')} or {_no_number('c$.attempt', 0)})", "call outside of its history"),
        (f"exists({calls}, c -> {_present('c$.attempts')} and ({_get('c$.attempts', list_of)} is null or exists({_get('c$.attempts', list_of)}, a -> {attempt})))", "damaged attempt"),
        (f"exists({calls}, c -> {retry})", "damaged retry"),
    ]
    cases = " ".join(f"when {rule} then '{name}'" for rule, name in rules)
    # Lambda variables hold what is looked at many times: the parsed text, and its last sequence.
    judged = f"element_at(transform(array({last}), last -> case {cases} end), 1)"
    return F.expr(f"element_at(transform(array(named_struct('v', try_parse_json({state}), 'execution', {execution_id})), s -> element_at(transform(array(s.v), v -> element_at(transform(array(s.execution), execution -> {judged}), 1)), 1)), 1)")


def checkpoint_violations(checkpoints: DataFrame, events: DataFrame) -> DataFrame:
    """(execution_id, sequence, reason): checkpoints that their journal does not support.

    checkpoints: execution_id, sequence, state (JSON).  Reasons, in this order: the state is damaged (see state_fault), it stands
    at another sequence, the journal ends before it, the journal has no such event.
    """
    return _with_reasons(checkpoints, events).select("execution_id", "sequence", "reason").where("reason is not null")


def _with_reasons(checkpoints: DataFrame, events: DataFrame) -> DataFrame:
    last = events.groupBy("execution_id").agg(F.max("sequence").alias("_last"))
    at = events.select("execution_id", "sequence").distinct().withColumn("_at", F.lit(True))
    stated = F.expr("try_cast(get_json_object(state, '$.last_sequence') as bigint)")
    told = checkpoints.withColumns({"_fault": state_fault("state", "execution_id"), "_stated": stated})
    joined = told.join(last, "execution_id", "left").join(at, ["execution_id", "sequence"], "left")
    reason = (
        F.when(F.col("_fault").isNotNull(), F.col("_fault"))
        .when(F.col("_stated") != F.col("sequence"), "state is at another sequence")
        .when(F.coalesce("_last", F.lit(0)) < F.col("sequence"), "ahead of journal")
        .when(F.col("_at").isNull(), "no such event")
    )
    return joined.select(*checkpoints.columns, reason.alias("reason"))


def sorted_out(checkpoints: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The checkpoint rows that can be read on, and the others with the reason."""
    judged = _with_reasons(checkpoints, events)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def conflicting_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """Sequences that are checkpointed with different states; equal states are one checkpoint."""
    state = F.coalesce(F.to_json(F.try_parse_json("state")), "state", F.lit(""))
    return checkpoints.groupBy("execution_id", "sequence").agg(F.countDistinct(state).alias("n_states")).where("n_states > 1")


#: Events that may follow each event of a call; deduplicated calls complete without a start.
GRAMMAR = {
    "ToolRequested": ("ToolStarted", "ToolCompleted", "ToolCancelled"),
    "ToolStarted": ("ToolCompleted", "ToolFailed", "ToolTimedOut", "ToolCancelled"),
    "ToolFailed": ("ToolRetryScheduled",),
    "ToolTimedOut": ("ToolRetryScheduled",),
    "ToolRetryScheduled": ("ToolStarted", "ToolCancelled"),
}

#: Outcomes that an operator may record for an open call.
RESOLVED = ("ToolCompleted", "ToolFailed", "ToolCancelled")


def grammar_violations(events: DataFrame) -> DataFrame:
    """(execution_id, call_id, sequence, before, event_type): an event that may not follow the call's one before.

    An outcome that an operator recorded for an open call (a resolution) is no violation.
    """
    resolution = F.col("resolution") if "resolution" in events.columns else F.lit(None).cast("string")
    calls = events.where(F.col("event_type").isin(*S.TOOL_EVENTS)).withColumn("resolution", resolution)
    w = Window.partitionBy("execution_id", "call_id").orderBy("sequence")
    paired = calls.select("execution_id", "call_id", "sequence", "event_type", F.lag("event_type").over(w).alias("before"), "resolution")
    allowed = F.col("before").isNull() & (F.col("event_type") == "ToolRequested")
    allowed = allowed | (F.col("resolution").isNotNull() & F.col("before").isin(*S.INCOMPLETE_EVENTS) & F.col("event_type").isin(*RESOLVED))
    for before, after in GRAMMAR.items():
        allowed = allowed | ((F.col("before") == before) & F.col("event_type").isin(*after))
    return paired.where(~F.coalesce(allowed, F.lit(False))).drop("resolution")


def after_the_end(events: DataFrame) -> DataFrame:
    """Events of an execution after its terminal event, other than a new start; `ended`: the terminal event's sequence."""
    marked = blocks.last_marked(events, F.col("event_type").isin(*S.TERMINAL_EVENTS), "ended")
    return marked.where(F.col("ended").isNotNull() & (F.col("event_type") != "ExecutionStarted"))


def while_a_call_is_open(events: DataFrame) -> DataFrame:
    """(execution_id, sequence, event_type, n_open): requests and completions recorded while calls of the execution were open.

    A call is open from its request, or a further attempt's start, to its outcome; one that waits for a retry is not.
    """
    w = Window.partitionBy("execution_id", "call_id").orderBy("sequence")
    was_open = F.coalesce(F.lag("event_type").over(w).isin(*S.INCOMPLETE_EVENTS), F.lit(False)).cast("int")
    calls = events.where(F.col("event_type").isin(*S.TOOL_EVENTS)).select("execution_id", "sequence", "event_type", (F.col("event_type").isin(*S.INCOMPLETE_EVENTS).cast("int") - was_open).alias("change"))
    ends = events.where(F.col("event_type") == "ExecutionCompleted").select("execution_id", "sequence", "event_type", F.lit(0).alias("change"))
    counted = blocks.running_sum(calls.unionByName(ends), F.col("change"), "n_open")
    return counted.where("n_open > 0").where(F.col("event_type").isin("ToolRequested", "ExecutionCompleted")).select("execution_id", "sequence", "event_type", "n_open")


def illegal_transitions(events: DataFrame) -> DataFrame:
    """(execution_id, sequence, event_type, reason): what an execution's status did not allow."""
    late = after_the_end(events).select("execution_id", "sequence", "event_type", F.lit("after the end").alias("reason"))
    return late.unionByName(while_a_call_is_open(events).select("execution_id", "sequence", "event_type", F.lit("a call is open").alias("reason")))


def repeated_cancellations(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "ToolCancelled").groupBy("execution_id", "call_id").agg(F.count("*").alias("n")).where("n > 1")


def unreadable_ops(ops: DataFrame) -> DataFrame:
    """(idempotency_key, op_seq, column): ledger operations whose JSON cannot be read; the ledger must not be folded from them."""
    bad = F.array(*[F.when(F.col(c).isNotNull() & F.try_parse_json(F.col(c).cast("string")).isNull(), F.lit(c)) for c in ("arguments", "result", "error") if c in ops.columns])
    return ops.select("idempotency_key", "op_seq", F.explode(F.array_compact(bad)).alias("column"))
