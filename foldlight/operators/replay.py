"""Replay as comparison of histories: recorded calls, candidate calls, regenerated events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldlight import schemas as S
from foldlight.functions.canonical import equal_form
from foldlight.functions.predicates import is_incomplete_status, is_settled, mapped
from foldlight.operators import blocks, fold
from foldlight.operators.scans import prefix
from foldlight.staging import staged


def recorded_calls(calls: DataFrame) -> DataFrame:
    """Calls with their index (from 0) in request order of their execution."""
    return blocks.running_sum(calls, F.lit(1), "index", order="requested_sequence")


def recorded_with_requests(calls: DataFrame, attempts: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """What a replay serves: recorded calls with index, policy, deadline and flags of their request, and their attempts in order.

    after: (execution_id, start): only calls requested after it, indexed from there.
    """
    if after is not None:
        calls = calls.join(after, "execution_id").where("requested_sequence > start").drop("start")
    return fold.with_attempts(recorded_calls(calls), attempts)


def can_attempt(attempts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(execution_id, call_id, attempt, can_attempt): whether the history holds an outcome of each wanted attempt; where it ends at a
    scheduled retry, or at a start, a replay ends too."""
    known = attempts.where(~is_incomplete_status(F.col("status"))).select("execution_id", "call_id", "attempt").distinct().withColumn("_known", F.lit(True))
    return wanted.join(known, ["execution_id", "call_id", "attempt"], "left").select("execution_id", "call_id", "attempt", F.coalesce("_known", F.lit(False)).alias("can_attempt"))


def retry_decisions(attempts: DataFrame) -> DataFrame:
    """(execution_id, call_id, failed_attempt, attempt, delay): the retries that the journal recorded; a replay serves these, whatever
    policy it holds itself."""
    return attempts.where("retry_sequence is not null").select("execution_id", "call_id", F.col("attempt").alias("failed_attempt"), F.col("retry_attempt").alias("attempt"), F.col("retry_delay").alias("delay"))


def guard_decisions(calls: DataFrame) -> DataFrame:
    """(execution_id, call_id, decision, result): how a replay answers keyed calls: from the history, without a ledger."""
    served = F.coalesce(F.col("deduplicated"), F.lit(False))
    return calls.where("idempotency_key is not null").select("execution_id", "call_id", F.when(served, "deduplicated").otherwise("execute").alias("decision"), F.when(served, F.col("result")).alias("result"))


def first_mismatches(recorded: DataFrame, candidate: DataFrame) -> DataFrame:
    """(execution_id, index, kind, expected, received): where a candidate's calls first leave the recorded ones; no row if they never do.

    recorded: execution_id, index, call_id, tool, arguments, status, attempt, idempotency_key; candidate: the same without status, and call_id and
    attempt (attempts made) only if they are to be compared.  Arguments are compared as JSON values (canonical.equal_form): 1, 1.0 and true are equal.
    """
    r, c = recorded.alias("r"), candidate.alias("c")
    joined = r.join(c, F.expr("r.execution_id = c.execution_id and r.index = c.index"), "full")
    settled = is_settled(F.col("r.status")) & (F.col("r.status") != "RETRYING")
    differ = lambda name: ~F.col(f"r.{name}").eqNullSafe(F.col(f"c.{name}"))
    given = lambda name: differ(name) if name in candidate.columns else F.lit(False)
    text = lambda side, name: F.col(f"{side}.{name}").cast("string")
    cases = [
        (F.col("r.index").isNull(), "unexpected_tool_call", None, text("c", "tool")),
        (F.col("c.index").isNull(), "missing_recorded_call", text("r", "tool"), None),
        (differ("tool"), "tool_name", text("r", "tool"), text("c", "tool")),
        (~equal_form(text("r", "arguments")).eqNullSafe(equal_form(text("c", "arguments"))), "arguments", text("r", "arguments"), text("c", "arguments")),
        (differ("idempotency_key"), "arguments", text("r", "idempotency_key"), text("c", "idempotency_key")),
        (given("call_id"), "call_id", text("r", "call_id"), text("c", "call_id") if "call_id" in candidate.columns else None),
        (~settled, "missing_recorded_outcome", text("r", "status"), None),
        (given("attempt"), "attempt", text("r", "attempt"), text("c", "attempt") if "attempt" in candidate.columns else None),
    ]
    none = F.lit(None).cast("string")
    kind, expected, received = none, none, none
    for condition, name, one, other in reversed(cases):
        kind, expected, received = F.when(condition, name).otherwise(kind), F.when(condition, none if one is None else one).otherwise(expected), F.when(condition, none if other is None else other).otherwise(received)
    found = joined.select(F.coalesce("r.execution_id", "c.execution_id").alias("execution_id"), F.coalesce("r.index", "c.index").alias("index"), kind.alias("kind"), expected.alias("expected"), received.alias("received")).where("kind is not null")
    return found.groupBy("execution_id").agg(F.min(F.struct("index", "kind", "expected", "received")).alias("m")).select("execution_id", "m.*")


def regenerate(events: DataFrame, calls: DataFrame) -> DataFrame:
    """A journal made again from folded calls with their attempts (fold.fold_whole_calls) and the recorded lifecycle, numbered from 1.

    Each call's events stand together, at its request's place; a cancellation during a backoff is written after the
    retry that it called off.
    """
    result, error = calls.schema["result"].dataType, calls.schema["error"].dataType
    null = lambda t: F.lit(None).cast(t)

    def step(event, attempt, result_=None, error_=None, failed=None, delay=None, timeout=None, enforced=None):
        fields = {"event_type": (event, "string"), "attempt": (attempt, "int"), "result": (result_, result), "error": (error_, error), "failed_attempt": (failed, "int"), "delay": (delay, "double"), "timeout": (timeout, "double"), "enforced": (enforced, "boolean")}
        return F.struct(*[(null(t) if v is None else v.cast(t)).alias(k) for k, (v, t) in fields.items()])

    def made(t):
        """The events of an attempt, in order."""
        outcome = mapped(t["status"], {"COMPLETED": "ToolCompleted", "FAILED": "ToolFailed", "TIMED_OUT": "ToolTimedOut", "CANCELLED": "ToolCancelled"})
        timed, off = t["status"] == "TIMED_OUT", (t["status"] == "CANCELLED") & t["retry_sequence"].isNotNull()  # off: cancelled while it waited for a retry
        a = t["attempt"]
        return F.array_compact(F.array(
            F.when(t["started_sequence"] > 0, step(F.lit("ToolStarted"), a)),
            F.when(~is_incomplete_status(t["status"]) & ~off, step(outcome, a, t["result"], t["error"], timeout=F.when(timed, F.col("timeout")), enforced=F.when(timed, F.col("enforced")))),
            # What the attempt failed with was overwritten by the cancellation; that it failed is known.
            F.when(off, step(F.lit("ToolFailed"), a)),
            F.when(t["retry_sequence"].isNotNull(), step(F.lit("ToolRetryScheduled"), t["retry_attempt"], None, F.when(~off, t["error"]), a, t["retry_delay"])),
            F.when(off, step(outcome, a, None, t["error"])),
        ))

    in_order = F.array_sort("attempts", lambda x, y: (x["attempt"] - y["attempt"]).cast("int"))
    # One row per call or lifecycle event with the steps that follow it, so that a row's place in the whole is a sum over rows.
    requests = ("tool", "arguments", "idempotency_key", "timeout", "timeout_mode", "deduplicated", "retry_policy")
    asked = calls.select("execution_id", F.col("requested_sequence").alias("place"), F.lit("ToolRequested").alias("first"), "call_id", *requests, F.when(F.col("attempt") > 0, F.flatten(F.transform(in_order, made))).alias("steps"))
    e = fold.conform(events)
    lifecycle = e.where(F.col("event_type").isin(*S.LIFECYCLE_EVENTS)).select("execution_id", F.col("sequence").alias("place"), F.col("event_type").alias("first"), F.col("result").cast(result).alias("ended"), F.col("error").cast(error).alias("failed"), "goal")
    every = asked.unionByName(lifecycle, allowMissingColumns=True).withColumn("steps", F.concat(F.array(step(None, None)), F.coalesce("steps", F.array())))
    placed = blocks.running_sum(every, F.size("steps"), "before", order="place")
    each = placed.select("*", F.posexplode("steps").alias("pos", "s"))
    is_first = F.col("pos") == 0
    own = {c: F.when(is_first, F.col(c)) for c in requests if c not in ("tool", "timeout")}
    return each.select(
        "execution_id",
        (F.col("before") + F.col("pos") + 1).cast("long").alias("sequence"),
        F.when(is_first, F.col("first")).otherwise(F.col("s.event_type")).alias("event_type"),
        "call_id", "tool",
        *[v.alias(c) for c, v in own.items()],
        F.when(is_first, F.col("timeout")).otherwise(F.col("s.timeout")).alias("timeout"),
        F.when(is_first, F.col("ended")).otherwise(F.col("s.result")).alias("result"),
        F.when(is_first, F.col("failed")).otherwise(F.col("s.error")).alias("error"),
        "goal", "s.attempt", "s.failed_attempt", "s.delay", "s.enforced",
    )


def regenerate_from(events: DataFrame, allowed: DataFrame) -> DataFrame:
    """The events after each execution's start made again, numbered on from it; event_id and timestamp are those recorded at the position.

    allowed: (execution_id, start) of `starts` with verdict ok: no call is open or waiting there.
    """
    start = F.col("start")
    wanted = events.join(allowed.select("execution_id", "start"), "execution_id")
    later = wanted.where(F.col("sequence") > start).drop("start")
    again = regenerate(later, fold.fold_whole_calls(later))
    again = again.join(allowed.select("execution_id", "start"), "execution_id").withColumn("sequence", F.col("sequence") + start).drop("start")
    mirrored = [c for c in ("event_id", "timestamp") if c in events.columns]
    return again.drop(*mirrored).join(later.select("execution_id", "sequence", *mirrored), ["execution_id", "sequence"], "left") if mirrored else again


_COMPARED = ("call_id", "tool", "arguments", "status", "attempt", "result", "error", "requested_sequence", "started_sequence", "completed_sequence")
_TRIED = ("attempt", "status", "started_sequence", "completed_sequence", "result", "retry_sequence", "retry_attempt", "retry_delay")


def _digest(events: DataFrame, calls: DataFrame) -> DataFrame:
    """(execution_id, digest, n, n_events): the sum of the hashes of an execution's calls with their attempts, and of its end."""
    tried = F.array_sort(F.transform("attempts", lambda t: F.struct(*[t[c].alias(c) for c in _TRIED])))
    called = calls.select("execution_id", F.xxhash64(*_COMPARED, tried).alias("h"), F.lit(0).cast("long").alias("n_events"))
    ends = fold.partial_executions(events).select("execution_id", F.xxhash64("last_sequence", "lifecycle.event_type").alias("h"), "n_events")
    return called.unionByName(ends).groupBy("execution_id").agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("digest"), F.count("*").alias("n"), F.sum("n_events").alias("n_events"))


def matched(events: DataFrame) -> DataFrame:
    """(execution_id, matched, events_replayed): whether calls, attempts and end of the regenerated journal are those of the recorded one,
    and their events as many (events of calls that nothing requested are not made again)."""
    # Each is read by several branches.
    calls = staged(fold.fold_whole_calls(events), "calls")
    again = staged(regenerate(events, calls), "regenerated")
    other = _digest(again, fold.fold_whole_calls(again)).select("execution_id", *[F.col(c).alias(f"{c}_again") for c in ("digest", "n", "n_events")])
    same = [F.col(c).eqNullSafe(F.col(f"{c}_again")) for c in ("digest", "n", "n_events")]
    return _digest(events, calls).join(other, "execution_id", "left").select("execution_id", (same[0] & same[1] & same[2]).alias("matched"), F.col("n_events").alias("events_replayed"))


def journal_mutated(before: DataFrame, events: DataFrame) -> DataFrame:
    """(execution_id, before, after): journals that did not keep their number of events while they were replayed.

    before: (execution_id, n_events), counted when the replay began.
    """
    after = events.groupBy("execution_id").agg(F.count("*").alias("after"))
    joined = before.select("execution_id", F.col("n_events").alias("before")).join(after, "execution_id", "full")
    counts = joined.select("execution_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("before", "after")])
    return counts.where("before <> after")


def steps(calls: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row per recorded call: index, outcome, number of attempts, and the time its backoffs would have taken."""
    counted = attempts.groupBy("execution_id", "call_id").agg(F.count("*").alias("n_attempts"), F.coalesce(F.sum("retry_delay"), F.lit(0.0)).alias("delay"))
    joined = recorded_calls(calls).join(counted, ["execution_id", "call_id"], "left")
    n = F.coalesce("n_attempts", F.lit(0))
    return joined.select("execution_id", "index", "call_id", "tool", "status", n.alias("n_attempts"), F.coalesce("delay", F.lit(0.0)).alias("delay"), (F.col("status") == "COMPLETED").alias("succeeded"), (n > 1).alias("retried"))


def summary(events: DataFrame, calls: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per execution: events, calls, scheduled retries, their delays, and calls that stopped with an error."""
    counts = events.groupBy("execution_id").agg(F.count("*").alias("events_replayed"))
    tools = calls.groupBy("execution_id").agg(F.count("*").alias("tools_replayed"), F.count_if(F.col("status").isin(*S.STOP_STATUSES)).alias("errors"))
    retries = attempts.where("retry_sequence is not null").groupBy("execution_id").agg(F.count("*").alias("retries_replayed"), F.sum("retry_delay").alias("delay"))
    joined = counts.join(tools, "execution_id", "left").join(retries, "execution_id", "left")
    return joined.select("execution_id", "events_replayed", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tools_replayed", "retries_replayed", "errors")], F.coalesce("delay", F.lit(0.0)).alias("delay"))


def starts(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """(execution_id, start, verdict, events_replayed): whether a replay can start after each execution's sequence.

    wanted: (execution_id, start).  Verdicts: ok, out_of_range, open_call, pending_retry (a call waits for its next attempt
    there), inside_call (a call that had settled there was retried later): a replay could not place the events that such a call still has.
    """
    last = events.groupBy("execution_id").agg(F.max("sequence").alias("last"))
    calls = fold.fold_calls(prefix(events, wanted.select("execution_id", F.col("start").alias("upto"))))
    there = calls.groupBy("execution_id").agg(F.count_if(is_incomplete_status(F.col("status"))).alias("open"), F.count_if(F.col("pending_retry").isNotNull()).alias("waiting"))
    spans = events.where("call_id is not null").groupBy("execution_id", "call_id").agg(F.min("sequence").alias("a"), F.max("sequence").alias("b"))
    inside = spans.join(wanted.select("execution_id", "start"), "execution_id").where("a <= start and b > start").groupBy("execution_id").agg(F.count("*").alias("inside"))
    joined = wanted.join(last, "execution_id").join(there, "execution_id", "left").join(inside, "execution_id", "left")
    verdict = F.when((F.col("start") < 0) | (F.col("start") > F.col("last")), "out_of_range").when(F.coalesce("open", F.lit(0)) > 0, "open_call").when(F.coalesce("waiting", F.lit(0)) > 0, "pending_retry").when(F.coalesce("inside", F.lit(0)) > 0, "inside_call").otherwise("ok")
    return joined.select("execution_id", "start", verdict.alias("verdict"), F.when(verdict == "ok", F.col("last") - F.col("start")).otherwise(0).cast("long").alias("events_replayed"))
