"""The idempotency ledger over a stream of operations: one record of state per key, one decision per operation.

Built on applyInPandasWithState, so a key's log is never held: only its record is.  A key's
operations of one trigger are taken in order of op_seq; one that does not come after the last is answered `late` and
changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foldlight.shipping import ship

_RECORD = "status string, attempts int, retry_authorized int, result string, error string, execution_id string, call_id string, tool_name string, arguments string, created_at string, updated_at string, resolution string, resolution_note string, resolved_at string"
STATE = f"op_seq long, {_RECORD}"
#: `result` is what a deduplicated claim is served; the record after the operation follows.
OUTPUT = "idempotency_key string, op_seq long, op string, decision string, result string, " + ", ".join(("record_" if f.startswith(("result", "error")) else "") + f for f in _RECORD.split(", "))
INPUT = ("op_seq", "op", "result", "error", "execution_id", "by_execution", "call_id", "tool_name", "arguments", "note", "ts")
NEW = (None, 0, 0, *[None] * 11)


def step(record: tuple, op: str, result: str | None, error: str | None) -> tuple[tuple, str, str | None]:
    """(record, decision, served result) after one operation; record: (status, attempts, authorized, result, error)."""
    status, attempts, authorized, kept, failure = record
    if op == "claim":
        if status is None:
            return ("PENDING", 1, 0, kept, None), "execute", None
        if status == "COMPLETED":
            return record, "deduplicated", kept
        if authorized > 0:
            return ("PENDING", attempts + 1, authorized - 1, kept, None), "execute", None
        return record, "refused_failed" if status == "FAILED" else "refused_pending", None
    if status is None:
        return record, "unknown_key", None
    if op not in ("complete", "fail", "authorize_retry"):
        return record, "unknown_op", None
    if status == "COMPLETED":
        return record, "refused_completed", None
    if op == "complete":
        return ("COMPLETED", attempts, 0, result, None), "ok", None
    if op == "fail":
        return ("FAILED", attempts, 0, None, error), "ok", None
    return (status, attempts, authorized + 1, kept, failure), "ok", None


#: How a settlement is recorded.
RESOLUTIONS = {"complete": "completed", "fail": "failed", "authorize_retry": "retry"}


def apply_operation(record: tuple, o) -> tuple[tuple, str, str | None]:
    """(record, decision, served result) after one operation, for whole records (see STATE), which an execution may settle for itself only."""
    holder, status = record[5], record[0]
    if o.op != "claim" and status is not None and o.by_execution is not None and holder is not None and o.by_execution != holder:
        return record, "foreign_execution", None
    core, decision, served = step(record[:5], o.op, o.result, o.error)
    claim, (created, updated), settlement = record[5:9], record[9:11], record[11:]
    if decision == "execute":
        claim, created, updated = (o.execution_id, o.call_id, o.tool_name, o.arguments), created if status else o.ts, o.ts
    elif decision == "ok":
        updated, settlement = o.ts, (RESOLUTIONS[o.op], o.note, o.ts)
    return (*core, *claim, created, updated, *settlement), decision, served


def _apply(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, *record = state.get if state.exists else (-1, *NEW)
    record, out = tuple(record), []
    ops = pd.concat(list(frames)).sort_values("op_seq")[list(INPUT)].astype(object)
    for o in ops.where(ops.notna(), None).itertuples(index=False):
        served = None
        if o.op_seq <= last:
            decision = "late"
        else:
            last = int(o.op_seq)
            record, decision, served = apply_operation(record, o)
        out.append((key[0], int(o.op_seq), o.op, decision, served, *record))
    state.update((last, *record))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def decisions(ops: DataFrame) -> DataFrame:
    """ops: idempotency_key, op_seq, op and, where given, the other columns of INPUT (a streaming frame); blank and missing keys are left out.

    An operation with `by_execution` is asked for by that execution, which settles its own keys only.
    """
    ship(ops.sparkSession)
    given = [F.col(c) if c in ops.columns else F.lit(None).cast("string").alias(c) for c in INPUT]
    named = ops.where(F.trim("idempotency_key") != "").select("idempotency_key", *given)
    return named.groupBy("idempotency_key").applyInPandasWithState(_apply, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
