"""Idempotency ledger: an append-only operation log per key, folded in order.

Whether a claim is accepted depends on what came before, so a key's operations are walked in sequence by a higher-order
function inside the JVM: records carry the state alone; decisions walk chunks of CHUNK operations, so that a log of any length is
built in time proportional to it.

A key with more than LONG_LOG operations is not walked in one row: its log is cut in stretches, each stretch is summed up as a
function of the state before it (operators.ledger_stretches), the few functions are applied one after the other, and all
stretches are walked at once from the states that this gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlight.functions.predicates import all_of, is_unresolved_key
from foldlight.operators import ledger_stretches
from foldlight.staging import staged

#: Operations between which a key's decision log is set down.
CHUNK = 256
#: Operations of a key beyond which its log is cut, and those of a stretch.
LONG_LOG, STRETCH = 1 << 14, 1 << 10
_FIELDS = ("op_seq", "op", "execution_id", "call_id", "tool_name", "arguments", "result", "error", "note", "ts", "by_execution")
_RECORD = "status string, execution_id string, call_id string, tool_name string, arguments string, result string, error string, created_at string, updated_at string, attempts int, retry_authorized int, resolution string, resolution_note string, resolved_at string"
_NAMES = [f.split()[0] for f in _RECORD.split(", ")]


def _walk(with_log: bool, begin: dict[str, str] | None = None) -> str:
    """SQL: the last record of a key and, if asked for, the decision on each of its operations in `logs`, by chunk.

    begin: what is known of the record before the first operation.
    """
    decision = """case
      when x.op = 'claim' then case
        when s.status is null then 'execute'
        when s.status = 'COMPLETED' then 'deduplicated'
        when s.retry_authorized > 0 then 'execute'
        when s.status = 'FAILED' then 'refused_failed'
        else 'refused_pending' end
      when s.status is null then 'unknown_key'
      when x.by_execution is not null and x.by_execution <> s.execution_id then 'foreign_execution'
      when x.op not in ('complete', 'fail', 'authorize_retry') or x.op is null then 'unknown_op'
      when s.status = 'COMPLETED' then 'refused_completed'
      else 'ok' end"""
    claimed, settled = "d = 'execute'", "d = 'ok'"
    new = {
        "status": f"case when {claimed} then 'PENDING' when {settled} and x.op = 'complete' then 'COMPLETED' when {settled} and x.op = 'fail' then 'FAILED' else s.status end",
        **{c: f"if({claimed}, x.{c}, s.{c})" for c in ("execution_id", "call_id", "tool_name", "arguments")},
        "result": f"case when {settled} and x.op = 'complete' then x.result when {settled} and x.op = 'fail' then null else s.result end",
        "error": f"case when {claimed} then null when {settled} and x.op = 'complete' then null when {settled} and x.op = 'fail' then x.error else s.error end",
        "created_at": f"if({claimed} and s.status is null, x.ts, s.created_at)",
        "updated_at": f"if({claimed} or {settled}, x.ts, s.updated_at)",
        "attempts": f"if({claimed}, coalesce(s.attempts, 0) + 1, s.attempts)",
        "retry_authorized": f"case when {claimed} and s.status is null then 0 when {claimed} then s.retry_authorized - 1 when {settled} and x.op = 'authorize_retry' then s.retry_authorized + 1 when {settled} then 0 else s.retry_authorized end",
        "resolution": f"if({settled}, case x.op when 'complete' then 'completed' when 'fail' then 'failed' else 'retry' end, s.resolution)",
        "resolution_note": f"if({settled}, x.note, s.resolution_note)",
        "resolved_at": f"if({settled}, x.ts, s.resolved_at)",
    }
    fields = ", ".join(f"'{k}', {v}" for k, v in new.items())
    kinds = dict(f.split() for f in _RECORD.split(", "))
    empty = ", ".join(f"'{k}', cast({(begin or {}).get(k, 'null')} as {t})" for k, t in kinds.items())
    entry = "array<struct<op_seq:bigint,op:string,decision:string,result:string>>"
    if not with_log:
        step = f"element_at(transform(array({decision}), d -> named_struct({fields})), 1)"
        return f"aggregate(ops, named_struct({empty}), (s, x) -> {step})"
    log = "concat(s.log, array(named_struct('op_seq', x.op_seq, 'op', x.op, 'decision', d, 'result', if(d = 'deduplicated', s.result, null))))"
    step = f"element_at(transform(array({decision}), d -> named_struct({fields}, 'log', {log})), 1)"
    carried = ", ".join(f"'{k}', c.{k}" for k in kinds)
    inner = f"aggregate(slice(ops, k * {CHUNK} + 1, {CHUNK}), named_struct({carried}, 'log', cast(array() as {entry})), (s, x) -> {step})"
    after = ", ".join(f"'{k}', i.{k}" for k in kinds)
    outer = f"element_at(transform(array({inner}), i -> named_struct({after}, 'logs', concat(c.logs, array(i.log)))), 1)"
    return f"aggregate(sequence(0, int((size(ops) - 1) div {CHUNK})), named_struct({empty}, 'logs', cast(array() as array<{entry}>)), (c, k) -> {outer})"


def _typed(ops: DataFrame) -> DataFrame:
    """(idempotency_key, x).  Operations without a key are left out: see validation.blank_keys.  A key is kept as it was given, blanks included."""
    named = ops.where(F.trim("idempotency_key") != "")
    for c in _FIELDS:
        if c not in ops.columns:
            named = named.withColumn(c, F.lit(None).cast("string"))
    return named.select("idempotency_key", F.struct(F.col("op_seq").cast("long").alias("op_seq"), *[F.col(c).cast("string").alias(c) for c in _FIELDS[1:]]).alias("x"))


def _split(ops: DataFrame, long_log: int | None) -> tuple[DataFrame, DataFrame | None]:
    """The typed operations of ordinary keys, and those of keys with a long log, None if there is no such key."""
    typed = _typed(ops)
    long = staged(typed.groupBy("idempotency_key").agg(F.count("*").alias("n")).where(F.col("n") > (LONG_LOG if long_log is None else long_log)).select("idempotency_key"), "long-logs")
    if long.isEmpty():
        return typed, None
    return typed.join(long, "idempotency_key", "left_anti"), typed.join(long, "idempotency_key", "left_semi")


def _folded(typed: DataFrame, with_log: bool = False) -> DataFrame:
    return typed.groupBy("idempotency_key").agg(F.array_sort(F.collect_list("x")).alias("ops")).select("idempotency_key", F.expr(_walk(with_log)).alias("s"))


def _long_folded(typed: DataFrame) -> DataFrame:
    """(idempotency_key, part, nth, last, d): the operations of long logs with their decisions, walked stretch by stretch.

    (part, nth) orders a key's stretches; last: authorisations left after the stretch.
    """
    cut = ledger_stretches.cut(typed, STRETCH)
    begin = ledger_stretches.states_before(cut)
    each = cut.groupBy("idempotency_key", "part", "nth").agg(F.array_sort(F.collect_list("x")).alias("ops"))
    known = each.join(begin, ["idempotency_key", "part", "nth"])
    fields = {"status": "status", "retry_authorized": "authorized", "execution_id": "owner", "result": "served"}
    walked = known.select("idempotency_key", "part", "nth", "ops", F.expr(_walk(True, fields)).alias("s"))
    zipped = F.arrays_zip(F.col("ops").alias("x"), F.flatten("s.logs").alias("d"))
    return walked.select("idempotency_key", "part", "nth", F.col("s.retry_authorized").alias("last"), F.explode(zipped).alias("z")).select("idempotency_key", "part", "nth", "last", F.col("z.x").alias("x"), F.col("z.d").alias("d"))


def _long_records(typed: DataFrame) -> DataFrame:
    """Records of long logs: each field is that of the last operation which sets it, so decided operations are aggregated."""
    x, d = (lambda c: F.col(f"x.{c}")), F.col("d.decision")
    execute, ok = d == "execute", d == "ok"
    outcome = ok & x("op").isin("complete", "fail")
    place = F.struct("part", "nth", F.col("x.op_seq"), F.col("x"))
    last = lambda when, c: F.max(F.when(when, F.struct(place.alias("at"), c.alias("v"))))["v"]
    changed = execute | ok
    completed, failed = ok & (x("op") == "complete"), ok & (x("op") == "fail")
    columns = {
        "status": last(execute | outcome, F.when(execute, "PENDING").when(completed, "COMPLETED").otherwise("FAILED")),
        **{c: last(execute, x(c)) for c in ("execution_id", "call_id", "tool_name", "arguments")},
        "result": last(outcome, F.when(completed, x("result"))),
        "error": last(execute | outcome, F.when(failed, x("error"))),
        "created_at": F.min(F.when(execute, F.struct(place.alias("at"), x("ts").alias("v"))))["v"],
        "updated_at": last(changed, x("ts")),
        "attempts": F.count_if(execute).cast("int"),
        "retry_authorized": F.max_by("last", F.struct("part", "nth")),
        "resolution": last(ok, F.when(completed, "completed").when(failed, "failed").otherwise("retry")),
        "resolution_note": last(ok, x("note")),
        "resolved_at": last(ok, x("ts")),
    }
    return _long_folded(typed).groupBy("idempotency_key").agg(*[v.alias(k) for k, v in columns.items()]).where("status is not null")


def records(ops: DataFrame, long_log: int | None = None) -> DataFrame:
    """The ledger: one record per key that was ever claimed.  long_log: operations beyond which a key's log is cut, LONG_LOG if not given."""
    ordinary, long = _split(ops, long_log)
    found = _folded(ordinary).where("s.status is not null").select("idempotency_key", *[F.col(f"s.{c}").alias(c) for c in _NAMES])
    return found if long is None else found.unionByName(_long_records(long).select("idempotency_key", *_NAMES))


def decisions(ops: DataFrame, long_log: int | None = None) -> DataFrame:
    """(idempotency_key, op_seq, op, decision, result): what became of each operation; result: of a deduplicated claim.

    An operation with `by_execution` is asked for by that execution, which settles its own keys only.
    """
    ordinary, long = _split(ops, long_log)
    found = _folded(ordinary, with_log=True).select("idempotency_key", F.explode(F.flatten("s.logs")).alias("d")).select("idempotency_key", "d.*")
    return found if long is None else found.unionByName(_long_folded(long).select("idempotency_key", "d.*"))


def listed(ledger: DataFrame, execution_id: str | None = None, status: str | None = None) -> DataFrame:
    """Records that match the given filters, oldest first."""
    chosen = all_of(execution=(F.col("execution_id"), execution_id), status=(F.col("status"), status))
    return ledger.where(chosen).orderBy("created_at", "idempotency_key")


def pending(ledger: DataFrame) -> DataFrame:
    return ledger.where("status = 'PENDING'")


def unresolved(ledger: DataFrame) -> DataFrame:
    """Claimed, without outcome, and with no retry authorized."""
    return ledger.where(is_unresolved_key(F.col("status"), F.col("retry_authorized")))


def record_of(ledger: DataFrame, key: str) -> DataFrame:
    return ledger.where(F.col("idempotency_key") == key)


def counts(ledger: DataFrame) -> DataFrame:
    """(execution_id, status, n): records by execution and status."""
    return ledger.groupBy("execution_id", "status").agg(F.count("*").alias("n"))


def error_payload(error: Column) -> Column:
    """The stored form of an error (JSON text): an object as it is, a bare text as a message, none as an unspecified failure."""
    wrap = lambda message: F.to_json(F.struct(F.lit("ExecutionError").alias("type"), message.alias("message")))
    return F.when(error.isNull(), wrap(F.lit("unspecified failure"))).when(F.startswith(F.ltrim(error), F.lit("{")), error).otherwise(wrap(error))
