"""The call and attempt fold over a stream of decoded journal events, keyed by execution.

State per execution: its last sequence, status and number of open calls, a map with one entry per call and one with an entry
per attempt, so that an event reads and writes its own call and attempt only, however many the execution has.  Events that
do not follow the last sequence are answered with a rejection (late, or a gap) and change nothing, as an append to the journal
would be.  Each accepted event of a call gives the call's state after it, and that of the attempt it belongs to (null where there is
none); a sink keyed by (execution_id, sequence) is thus exactly-once.

The state may start from a stored snapshot, so that a stream goes on where a batch fold ended.  With `evict` the calls and
attempts of an execution are dropped when it ends: state grows with the executions that run, not with all that ever ran (of an ended
one the last sequence and status stay, to tell repeats; should it start again, events of its earlier calls are unknown).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from foldlight import schemas as S
from foldlight.functions.predicates import mapped
from foldlight.operators import fold
from foldlight.operators.checkpoints import Snapshot
from foldlight.shipping import ship

OUTPUT = (
    "execution_id string, sequence long, kind string, reason string, call_id string, status string, attempt int, started_sequence long, completed_sequence long, pending_sequence long, execution_status string, "
    "result string, error string, enforced boolean, attempt_number int, attempt_status string, attempt_started long, attempt_completed long, attempt_result string, attempt_error string, "
    "first_sequence long, retry_sequence long, retry_attempt int, retry_delay double"
)
INPUT = ("execution_id", "sequence", "event_type", "call_id", "attempt", "result", "error", "enforced", "failed_attempt", "delay")
HEAD = "last_sequence long, status string, n_open long"
#: Sequences start at 1: 0 stands for none.
CALL = "status string, attempt int, started long, completed long, pending long, result string, error string, enforced boolean"
ATTEMPT = "last string, first long, started long, completed long, result string, error string, retry_sequence long, retry_attempt int, retry_delay double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _number(attempt) -> int:
    return max(int(attempt or 1), 1)


def step(call: tuple | None, event_type: str, sequence: int, attempt: int | None, result: str | None = None, error: str | None = None, enforced: bool | None = None) -> tuple | None:
    """A call's state (as in CALL) after one of its events; None for an event of a call that was never requested."""
    if event_type == "ToolRequested":
        return call or ("REQUESTED", 0, 0, 0, 0, None, None, None)
    if call is None:
        return None
    _, tried, started, completed, pending, *outcome = call
    status = S.CALL_STATUS[event_type]
    if event_type == "ToolRetryScheduled":
        return status, tried, started, completed, sequence, *outcome
    tried = _number(attempt)
    if event_type == "ToolStarted":
        return status, tried, sequence, completed, 0, *outcome
    outcome = (result, None) if event_type == "ToolCompleted" else (None, error)
    return status, tried, started, sequence, 0 if event_type == "ToolCancelled" else pending, *outcome, enforced if event_type == "ToolTimedOut" else None


def attempt_step(kept: tuple | None, event, call: tuple | None = None) -> tuple[int, tuple]:
    """(number, state as in ATTEMPT) of the attempt that an event other than a request belongs to; kept: its state before; call: the
    call's before (as in CALL), whose last start an outcome of the attempt that the call is on takes over."""
    last, first, started, completed, result, error, *retry = kept or (None, 0, 0, 0, None, None, 0, None, None)
    if event.event_type == "ToolRetryScheduled":
        return attempt_of(event), (last, first, started, completed, result, error, int(event.sequence), _number(event.attempt), event.delay)
    first = first or int(event.sequence)
    if event.event_type == "ToolStarted":
        started = int(event.sequence)
    else:
        done = event.event_type == "ToolCompleted"
        completed, result, error = int(event.sequence), event.result if done else None, None if done else event.error
        if call is not None and call[1] == attempt_of(event):
            started = call[2] or started
    return attempt_of(event), (event.event_type, first, started, completed, result, error, *retry)


def attempt_of(event) -> int:
    if event.event_type == "ToolRetryScheduled":
        return int(event.failed_attempt or 0) or max(_number(event.attempt) - 1, 1)
    return _number(event.attempt)


def _shown_attempt(number: int, state: tuple) -> dict:
    """An attempt's columns: while it is open, an earlier outcome of its number is not its own.  None of a retry of one never made."""
    last, first, started, completed, result, error, retry_sequence, retry_attempt, retry_delay = state
    if last is None:
        return {}
    settled = last != "ToolStarted"
    return {
        "attempt_number": number, "attempt_status": S.CALL_STATUS[last], "attempt_started": started, "attempt_completed": completed if settled else 0, "attempt_result": result if settled else None,
        "attempt_error": error if settled else None, "first_sequence": first, "retry_sequence": retry_sequence or None, "retry_attempt": retry_attempt, "retry_delay": retry_delay,
    }


class CallFold(StatefulProcessor):
    def __init__(self, evict: bool = False):
        self.evict = evict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", HEAD)
        self.calls = handle.getMapState("calls", "call_id string", CALL)
        self.attempts = handle.getMapState("attempts", "call_id string, number int", ATTEMPT)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Rows of initial_rows: where a stored snapshot stands."""
        rows = initialState.astype(object)
        for r in rows.where(rows.notna(), None).itertuples(index=False):
            if r.what == "head":
                self.head.update((int(r.sequence), r.status, int(r.n_open)))
            elif r.what == "call":
                self.calls.updateValue((r.call_id,), (r.status, int(r.attempt), int(r.started), int(r.completed), int(r.pending), r.result, r.error, r.enforced))
            else:
                retry = (int(r.retry_sequence or 0), None if r.retry_attempt is None else int(r.retry_attempt), r.retry_delay)
                self.attempts.updateValue((r.call_id, int(r.attempt)), (r.status, int(r.first or 0), int(r.started), int(r.completed), r.result, r.error, *retry))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """The events of one execution in one trigger, in order of sequence."""
        last, status, n_open = self.head.get() if self.head.exists() else (0, "RUNNING", 0)
        out = []
        events = pd.concat(list(rows)).sort_values("sequence").astype(object)
        for e in events.where(events.notna(), None).itertuples(index=False):
            sequence, reason, call, attempt = int(e.sequence), None, None, {}
            if sequence <= last:
                reason = "late or duplicate"
            elif sequence > last + 1:
                reason = "gap"
            elif e.event_type not in S.EVENT_TYPES:
                reason = "unknown event type"
            elif e.event_type in S.TOOL_EVENTS:
                before = tuple(self.calls.getValue((e.call_id,))) if self.calls.containsKey((e.call_id,)) else None
                call = step(before, e.event_type, sequence, e.attempt, e.result, e.error, e.enforced)
                if call is None:
                    reason = "unknown call"
                else:
                    self.calls.updateValue((e.call_id,), call)
                    n_open += (call[0] in S.INCOMPLETE_STATUSES) - (before is not None and before[0] in S.INCOMPLETE_STATUSES)
                    if e.event_type != "ToolRequested":
                        at = e.call_id, attempt_of(e)
                        number, state = attempt_step(tuple(self.attempts.getValue(at)) if self.attempts.containsKey(at) else None, e, before)
                        self.attempts.updateValue(at, state)
                        attempt = _shown_attempt(number, state)
            if reason is None:
                last, status = sequence, S.EXECUTION_STATUS.get(e.event_type, status)
            whole = "RECOVERY_REQUIRED" if status == "RUNNING" and n_open else status
            shared = {"execution_id": key[0], "sequence": sequence, "call_id": e.call_id, "execution_status": whole}
            names = ("status", "attempt", "started_sequence", "completed_sequence", "pending_sequence", "result", "error", "enforced")
            shown = dict(zip(names, (*call[:4], call[4] or None, *call[5:]), strict=True)) if call else {}
            out.append(shared | {"kind": "rejected" if reason else "call" if call else "execution", "reason": reason} | shown | attempt)
            if self.evict and reason is None and e.event_type in S.TERMINAL_EVENTS:
                self.calls.clear(), self.attempts.clear()
                n_open = 0
        self.head.update((last, status, n_open))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype(object)
        numbers = ("attempt", "started_sequence", "completed_sequence", "pending_sequence", "attempt_number", "attempt_started", "attempt_completed", "first_sequence", "retry_sequence", "retry_attempt")
        yield frame.where(frame.notna(), None).astype({**dict.fromkeys(numbers, "Int64"), "retry_delay": "float64"})

    def close(self) -> None:
        pass


def initial_rows(snapshot: Snapshot) -> DataFrame:
    """A snapshot's partial folds as the state that the stream starts from: a row per execution, call and attempt."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    text = lambda c: F.col(c).cast("string")
    calls = fold.merge_calls(snapshot.calls).where(F.size("requests") > 0).select(
        "execution_id", F.lit("call").alias("what"), "call_id", mapped(F.col("last.event_type"), S.CALL_STATUS).alias("status"), F.coalesce("tried.attempt", F.lit(0)).alias("attempt"),
        zero("started.sequence").alias("started"), zero("settled.sequence").alias("completed"), F.when(F.col("retry.pending"), F.col("retry.sequence")).otherwise(0).cast("long").alias("pending"),
        text("settled.result").alias("result"), text("settled.error").alias("error"), F.col("settled.enforced").alias("enforced"),
    )
    opened = calls.groupBy("execution_id").agg(F.count_if(F.col("status").isin(*S.INCOMPLETE_STATUSES)).alias("n_open"))
    status = F.coalesce(mapped(F.col("lifecycle.event_type"), S.EXECUTION_STATUS), F.lit("RUNNING"))
    heads = snapshot.executions.join(opened, "execution_id", "left").select("execution_id", F.lit("head").alias("what"), F.col("last_sequence").cast("long").alias("sequence"), status.alias("status"), zero("n_open").alias("n_open"))
    attempts = snapshot.attempts.select(
        "execution_id", F.lit("attempt").alias("what"), "call_id", F.col("last.event_type").alias("status"), F.col("number").cast("int").alias("attempt"), zero("first_sequence").alias("first"),
        zero("started.at").alias("started"), zero("settled.sequence").alias("completed"), text("settled.result").alias("result"), text("settled.error").alias("error"),
        F.col("scheduled.sequence").alias("retry_sequence"), F.col("scheduled.attempt").cast("int").alias("retry_attempt"), F.col("scheduled.delay").alias("retry_delay"),
    )
    return heads.unionByName(calls, allowMissingColumns=True).unionByName(attempts, allowMissingColumns=True)


def call_updates(events: DataFrame, snapshot: Snapshot | None = None, evict: bool = False) -> DataFrame:
    """Call and attempt states and rejections for a streaming frame of decoded events, from a stored snapshot on if there is one.

    Keeps its state in RocksDB: sets the session's state store provider.
    """
    ship(events.sparkSession)
    events.sparkSession.conf.set(_PROVIDER, _ROCKSDB)
    typed = fold.conform(events).select(*INPUT).withColumns({c: F.col(c).cast("string") for c in ("result", "error")})
    begin = None if snapshot is None else initial_rows(snapshot).groupBy("execution_id")
    return typed.groupBy("execution_id").transformWithStateInPandas(statefulProcessor=CallFold(evict), outputStructType=StructType.fromDDL(OUTPUT), outputMode="Update", timeMode="None", initialState=begin)
