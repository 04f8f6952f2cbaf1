import pytest
from journals import JOURNALS, event, frame, repeated_outcomes, walked_attempts
from pyspark.sql import functions as F

from foldlight.operators import asof, checkpoints, fold, recovery, replay, validation


@pytest.fixture(scope="module")
def calls(spark):
    return {(r["execution_id"], r["requested_sequence"]): r for r in fold.fold_calls(frame(spark, JOURNALS)).collect()}


def test_call_states(calls):
    seen = {k: (r["status"], r["attempt"], r["result"], r["error"], r["started_sequence"], r["completed_sequence"], r["pending_retry"] is not None) for k, r in calls.items()}
    assert seen == {
        ("happy", 2): ("COMPLETED", 1, "5", None, 3, 4, False),
        ("retries", 2): ("COMPLETED", 3, "1", None, 9, 10, False),
        ("terminal_open", 2): ("STARTED", 1, None, None, 3, 0, False),
        ("cancel", 2): ("CANCELLED", 1, None, "stop", 3, 4, False),
        ("cancel_in_backoff", 2): ("CANCELLED", 1, None, "stop", 3, 6, False),
        ("unenforced", 2): ("TIMED_OUT", 1, None, "late", 3, 4, False),
        ("dedup", 2): ("COMPLETED", 1, "7", None, 0, 3, False),
        ("no_attempt", 2): ("COMPLETED", 1, "5", None, 3, 4, False),
        ("same_call_id", 2): ("STARTED", 1, None, None, 4, 0, False),
        ("same_call_id", 3): ("REQUESTED", 0, None, None, 0, 0, False),
        ("two_calls", 2): ("COMPLETED", 1, "1", None, 3, 4, False),
        ("two_calls", 5): ("STARTED", 1, None, None, 6, 0, False),
    }


def test_execution_states_and_classes(spark):
    states = fold.fold_executions(frame(spark, JOURNALS))
    found = {r["execution_id"]: (r["status"], r["recovery_class"]) for r in recovery.classify(states).collect()}
    assert found == {
        "happy": ("RUNNING", "RUNNING"), "retries": ("RUNNING", "RUNNING"), "terminal_open": ("FAILED", "FAILED"), "cancel": ("CANCELLED", "CANCELLED"), "cancel_in_backoff": ("RUNNING", "RUNNING"),
        "unenforced": ("RUNNING", "RUNNING"), "dedup": ("RUNNING", "RUNNING"), "no_attempt": ("RUNNING", "RUNNING"), "same_call_id": ("RECOVERY_REQUIRED",) * 2, "two_calls": ("RECOVERY_REQUIRED",) * 2,
    }
    by = {r["execution_id"]: r for r in states.collect()}
    assert by["cancel"]["result"] == "why" and by["terminal_open"]["error"] == "boom" and by["happy"]["goal"] == "g" and by["terminal_open"]["n_incomplete"] == 1


def test_unresolved_key_needs_recovery(spark):
    keys = spark.createDataFrame([("unenforced",), ("cancel",)], "execution_id string")
    found = {r["execution_id"]: (r["status"], r["recovery_class"]) for r in recovery.classify(fold.fold_executions(frame(spark, JOURNALS)), keys).collect()}
    assert found["unenforced"] == ("RECOVERY_REQUIRED",) * 2 and found["cancel"] == ("CANCELLED",) * 2


@pytest.mark.parametrize(("cut", "status", "kind"), [(1, "RUNNING", "RUNNING"), (2, "RECOVERY_REQUIRED", "RECOVERY_REQUIRED"), (3, "RECOVERY_REQUIRED", "RECOVERY_REQUIRED"), (4, "RUNNING", "RUNNING"), (5, "RUNNING", "RETRYABLE")])
def test_every_crash_point_of_a_retried_call(spark, cut, status, kind):
    found = recovery.classify(fold.fold_executions(frame(spark, {"retries": JOURNALS["retries"]}, cut))).collect()[0]
    assert (found["status"], found["recovery_class"]) == (status, kind)


def test_attempts(spark):
    found = {(r["execution_id"], r["attempt"]): (r["status"], r["started_sequence"], r["completed_sequence"], r["retry_sequence"]) for r in fold.fold_attempts(frame(spark, JOURNALS)).collect()}
    assert found["retries", 1] == ("FAILED", 3, 4, 5) and found["retries", 2] == ("FAILED", 6, 7, 8) and found["retries", 3] == ("COMPLETED", 9, 10, None)
    assert found["dedup", 1] == ("COMPLETED", 0, 3, None) and ("cancel_in_backoff", 2) not in found and found["cancel_in_backoff", 1] == ("CANCELLED", 3, 6, 5)


@pytest.mark.parametrize("cut", range(1, 11))
def test_walk_agrees_on_every_prefix(spark, rows, cut):
    events = frame(spark, JOURNALS, cut).where("execution_id <> 'same_call_id'")
    columns = ["execution_id", "call_id", "status", "attempt", "result", "error", "requested_sequence", "started_sequence", "completed_sequence", "pending_sequence"]
    one = fold.fold_calls(events).withColumn("pending_sequence", F.col("pending_retry.sequence")).select(*columns)
    assert rows(one.toPandas()) == rows(fold.sequential_calls(events).select(*columns).toPandas())


@pytest.mark.parametrize("cut", [0, 1, 3, 5, 8])
def test_snapshot_and_tail_equal_the_whole(spark, cut):
    events = frame(spark, JOURNALS)
    limits = events.select("execution_id").distinct().withColumn("upto", F.lit(cut))
    whole, recovered = checkpoints.recover(events), checkpoints.recover(events, checkpoints.take(events, limits))
    for kind in ("calls", "attempts", "executions"):
        assert checkpoints.difference(getattr(whole, kind), getattr(recovered, kind)).count() == 0


def test_snapshot_round_trip_and_ahead(spark, tmp_path):
    events = frame(spark, JOURNALS)
    checkpoints.take(events).write(str(tmp_path / "s"))
    snapshot = checkpoints.Snapshot.read(spark, str(tmp_path / "s"))
    assert checkpoints.difference(checkpoints.recover(events).calls, checkpoints.recover(events, snapshot).calls).count() == 0
    assert checkpoints.ahead_of_journal(snapshot, events).count() == 0 and checkpoints.ahead_of_journal(snapshot, events.where("sequence < 3")).count() == len(JOURNALS) - 0 - sum(len(j) < 3 for j in JOURNALS.values())


def test_violations(spark):
    bad = {"gap": [event("S"), event("Rq", "c")], "orphan": [event("S"), event("Ok", "x", attempt=1)], "zero": [event("S")]}
    events = frame(spark, bad).withColumn("sequence", F.when(F.col("execution_id") == "zero", 0).when((F.col("execution_id") == "gap") & (F.col("sequence") == 2), 3).otherwise(F.col("sequence")))
    assert {(r[0], r[1]) for r in validation.sequence_gaps(events).collect()} == {("gap", 3), ("zero", 0)}
    assert [r["execution_id"] for r in validation.orphan_call_events(events).collect()] == ["orphan"]
    assert validation.duplicate_sequences(events.unionByName(events.where("execution_id = 'zero'"))).count() == 1
    after = frame(spark, {"x": [event("S"), event("XOk"), event("Rq", "c")]})
    assert validation.illegal_transitions(after).count() == 1 and validation.grammar_violations(frame(spark, JOURNALS)).where("execution_id not in ('same_call_id')").count() == 0


def test_checkpoint_rules(spark):
    events = frame(spark, {"x": JOURNALS["happy"]})
    good = checkpoints.rows(events)
    assert validation.checkpoint_violations(good, events).count() == 0
    state = lambda at: f'{{"execution_id":"x","status":"RUNNING","last_sequence":{at}}}'
    bad = spark.createDataFrame([("x", 4, state(3)), ("x", 9, state(9)), ("x", 2, "{oops"), ("x", 0, state(0))], "execution_id string, sequence long, state string")
    assert {r["sequence"]: r["reason"] for r in validation.checkpoint_violations(bad, events).collect()} == {4: "state is at another sequence", 9: "ahead of journal", 2: "unreadable state", 0: "no such event"}
    two = spark.createDataFrame([("x", 4, '{"a":1,"b":2}'), ("x", 4, '{"b":2, "a":1}'), ("x", 5, "{}"), ("x", 5, '{"a":1}')], "execution_id string, sequence long, state string")
    assert [r["sequence"] for r in validation.conflicting_checkpoints(two).collect()] == [5]


def test_replay_of_a_history_against_itself_and_of_a_broken_one(spark):
    events = frame(spark, {k: v for k, v in JOURNALS.items() if k not in ("same_call_id",)})
    assert {r["matched"] for r in replay.matched(events).collect()} == {True}
    broken = frame(spark, {"x": [event("S"), event("Rq", "a"), event("Rq", "b"), event("St", "a", attempt=1), event("Ok", "a", attempt=1)]})
    assert [r["matched"] for r in replay.matched(broken).collect()] == [False]


def test_replay_starts_and_resolutions(spark):
    events = frame(spark, {"retries": JOURNALS["retries"], "two_calls": JOURNALS["two_calls"]})
    wanted = spark.createDataFrame([("retries", s) for s in (0, 3, 5, 10, 11, -1)], "execution_id string, start long")
    found = {}
    for r in wanted.collect():
        one = wanted.where((F.col("start") == r["start"]))
        found[r["start"]] = replay.starts(events, one).collect()[0]["verdict"]
    assert found == {0: "ok", 3: "open_call", 5: "pending_retry", 10: "ok", 11: "out_of_range", -1: "out_of_range"}
    decisions = spark.createDataFrame([("two_calls", "b", "mark_completed", "9", None), ("two_calls", "a", "cancel", None, "no")], "execution_id string, call_id string, action string, result string, error string")
    made = recovery.resolutions(decisions, fold.fold_calls(events), fold.fold_executions(events)).collect()
    assert [(r["call_id"], r["sequence"], r["event_type"], r["result"]) for r in made] == [("b", 7, "ToolCompleted", "9")]


def test_whole_calls_are_calls_with_their_attempts(spark, rows):
    stray = [event("S"), event("Rt", "c", attempt=2, failed_attempt=1), event("Rq", "c", tool="add"), event("Ok", "c", attempt=3, result="2"), event("St", "c", attempt=2), event("Fl", "c", attempt=2, error="e"), event("Ok", "orphan", attempt=1)]
    events = frame(spark, JOURNALS | {"stray": stray})
    calls = fold.with_attempts(fold.fold_calls(events), fold.fold_attempts(events))
    assert rows(calls.toPandas()) == rows(fold.fold_whole_calls(events).select(*calls.columns).toPandas())


def test_a_journal_with_an_unrequested_call_does_not_match(spark):
    orphan = frame(spark, {"x": [*JOURNALS["happy"], event("Ok", "orphan", attempt=1)], "y": JOURNALS["happy"]})
    assert {r["execution_id"]: (r["matched"], r["events_replayed"]) for r in replay.matched(orphan).collect()} == {"x": (False, 5), "y": (True, 4)}


def _spans(attempts):
    return {(r["execution_id"], r["attempt"]): (r["started_sequence"], r["completed_sequence"]) for r in attempts.collect()}


@pytest.fixture(scope="module")
def repeated(spark):
    journals = repeated_outcomes(60)
    taken = [(name, a) for name, events in journals.items() for a in (2, 3) if not any(e["event_type"] == "ToolStarted" and e["attempt"] == a for e in events)]
    # Some attempts that never started have another's start.
    assert any(walked_attempts(journals).get(k, (0,))[0] for k in taken)
    return journals, frame(spark, journals).cache()


def test_repeated_outcomes_are_those_of_a_walk(repeated):
    journals, events = repeated
    assert _spans(fold.fold_attempts(events)) == walked_attempts(journals)
    whole = fold.fold_whole_calls(events).select("execution_id", F.explode("attempts").alias("a")).select("execution_id", "a.*")
    assert _spans(whole) == walked_attempts(journals)


@pytest.mark.parametrize("cut", [4, 8])
def test_repeated_outcomes_after_a_snapshot(spark, repeated, cut):
    journals, events = repeated
    limits = events.select("execution_id").distinct().withColumn("upto", F.lit(cut))
    assert _spans(checkpoints.recover(events, checkpoints.take(events, limits)).attempts) == walked_attempts(journals)
    stored = checkpoints.rows(events.where(F.col("sequence") <= cut))
    assert _spans(checkpoints.recover(events, checkpoints.from_rows(stored)).attempts) == walked_attempts(journals)


def test_repeated_outcomes_at_places(spark, repeated):
    journals, events = repeated
    wanted = events.select("execution_id").distinct().select("execution_id", F.explode(F.array(*map(F.lit, (5, 6, 9, 14)))).alias("upto"))
    stored = checkpoints.rows(events.where("sequence <= 4"))
    for base in (None, stored):
        found = asof.states_at(events, wanted, base).attempts.toPandas()
        for upto in (5, 6, 9, 14):
            at = found[found.upto == upto]
            spans = dict(zip(zip(at.execution_id, at.attempt), zip(at.started_sequence, at.completed_sequence)))
            assert spans == walked_attempts({k: v[:upto] for k, v in journals.items()})
