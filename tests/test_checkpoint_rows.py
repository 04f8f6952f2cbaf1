import pytest
from journals import JOURNALS, event, frame
from pyspark.sql import functions as F

from foldlight.engine import JournalEngine, JournalError
from foldlight.operators import blocks, checkpoints, fold, ledger, recovery, replay, reports, validation
from foldlight.sources import journal


@pytest.mark.parametrize("cut", [1, 3, 4, 5, 7, 9])
def test_stored_rows_and_the_events_after_them(spark, rows, cut):
    """Checkpoints at every kind of place, written as JSON, read back and continued, agree with the whole fold."""
    journals = {k: v for k, v in JOURNALS.items()}
    events = frame(spark, journals)
    stored = checkpoints.rows(frame(spark, journals, cut))
    assert checkpoints.corrupt(stored, events).count() == 0
    again = checkpoints.recover(events, checkpoints.from_rows(stored))
    whole = checkpoints.recover(events)
    for name in ("calls", "attempts", "executions"):
        one, other = getattr(again, name), getattr(whole, name)
        assert rows(one.drop("started_at").toPandas()) == rows(other.drop("started_at").toPandas()), name


def test_guards(spark):
    events = frame(spark, {k: JOURNALS[k] for k in ("happy", "retries", "two_calls")})
    good = checkpoints.rows(events)
    assert {r["verdict"] for r in checkpoints.guarded(good, good.limit(0), events).collect()} == {"store"}
    assert {r["verdict"] for r in checkpoints.guarded(good, good, events).collect()} == {"already stored"}
    old = checkpoints.rows(frame(spark, {"happy": JOURNALS["happy"]}, 2))
    assert checkpoints.guarded(old, good.limit(0), events).first()["verdict"] == "behind journal"
    other = good.withColumn("state", F.expr("concat('{\"goal\":\"another\",', substring(state, 2))"))
    assert {r["verdict"] for r in checkpoints.guarded(good, other, events).collect()} == {"another state is stored"}


def test_engine_refuses_what_the_journal_does_not_support(spark, tmp_path):
    events = frame(spark, {k: JOURNALS[k] for k in ("happy", "two_calls")})
    path, saved = str(tmp_path / "events"), str(tmp_path / "saved")
    journal.write_events(journal.encode(events.drop("error", "result")), path)
    state = checkpoints.rows(frame(spark, {k: JOURNALS[k] for k in ("happy", "two_calls")}, 2))
    complete = lambda df: df.selectExpr("concat('c', execution_id) as checkpoint_id", "execution_id", "sequence", "state", "cast(null as string) as created_at")
    complete(state).write.parquet(saved)
    engine = JournalEngine.open(spark, path, checkpoints_path=saved)
    assert {r["execution_id"]: r["recovery_class"] for r in engine.recovery().collect()} == {"happy": "RUNNING", "two_calls": "RECOVERY_REQUIRED"}
    assert "Recovered from: checkpoint at 2, events after it: 4\nOpen calls:\n  b add started at 6" in {r["execution_id"]: r["report"] for r in engine.report().collect()}["two_calls"]
    for k, broken in enumerate((state.withColumn("state", F.lit("{")), state.withColumn("sequence", F.col("sequence") + 1), state.selectExpr("execution_id", "9L as sequence", "'{\"last_sequence\":9}' as state"))):
        complete(broken).write.parquet(f"{saved}{k}")
        with pytest.raises(JournalError):
            JournalEngine.open(spark, path, checkpoints_path=f"{saved}{k}")
    checkpoints.take(frame(spark, {"happy": JOURNALS["happy"] + JOURNALS["happy"][1:]})).write(str(tmp_path / "ahead"))
    with pytest.raises(JournalError):
        JournalEngine.open(spark, path, snapshot_path=str(tmp_path / "ahead"))


def test_resolutions_are_no_violations(spark):
    events = frame(spark, {"two_calls": JOURNALS["two_calls"], "asked": [event("S"), event("Rq", "c", tool="add")]})
    calls = fold.fold_calls(events)
    states = fold.finish_executions(fold.partial_executions(events), calls)
    decisions = spark.createDataFrame([("two_calls", "b", "mark_failed", None, "gone"), ("asked", "c", "mark_failed", None, "gone"), ("two_calls", "a", "cancel", None, None)], "execution_id string, call_id string, action string, result string, error string")
    settled = recovery.resolutions(decisions, calls, states)
    assert {(r["call_id"], r["sequence"]) for r in settled.collect()} == {("b", 7), ("c", 3)}
    whole = events.unionByName(settled, allowMissingColumns=True)
    assert validation.grammar_violations(whole).count() == 0
    assert validation.grammar_violations(whole.drop("resolution")).count() == 1  # without it, a failure before a start is one
    assert {(r["execution_id"], r["sequence"]) for r in checkpoints.boundaries(whole).collect()} == {("two_calls", 7), ("asked", 3)}


def test_requests_while_a_call_is_open(spark):
    bad = {"x": [event("S"), event("Rq", "a", tool="add"), event("Rq", "b", tool="add"), event("St", "b", attempt=1), event("Ok", "b", attempt=1), event("XOk")], "retry": JOURNALS["retries"] + [event("Rq", "d", tool="add")]}
    found = {(r["execution_id"], r["sequence"], r["reason"]) for r in validation.illegal_transitions(frame(spark, bad)).collect()}
    assert found == {("x", 3, "a call is open"), ("x", 6, "a call is open")}


def test_running_values_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 4)
    rows_ = [("a", s, s % 3) for s in (1, 2, 3, 5, 8, 8, 9, 20, 21)] + [("b", 7, 1)]
    df = spark.createDataFrame(rows_, "execution_id string, sequence long, v long")
    found = sorted((r["execution_id"], r["sequence"], r["before"] or 0) for r in blocks.previous(df, "before").collect())
    assert found == [("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("a", 5, 3), ("a", 8, 5), ("a", 8, 8), ("a", 9, 8), ("a", 20, 9), ("a", 21, 20), ("b", 7, 0)]
    sums = sorted((r["execution_id"], r["sequence"], r["sum"]) for r in blocks.running_sum(df, F.col("v"), "sum").collect())
    assert sums == sorted((e, s, sum(w for f, t, w in rows_ if f == e and t < s)) for e, s, _ in rows_)
    marks = sorted((r["execution_id"], r["sequence"], r["at"] or 0) for r in blocks.last_marked(df.where("sequence <> 8"), F.col("v") == 0, "at").collect())
    assert marks == sorted((e, s, max([t for f, t, w in rows_ if f == e and t < s and t != 8 and w == 0], default=0)) for e, s, _ in rows_ if s != 8)


def test_replay_from_a_sequence_mirrors_ids(spark):
    events = frame(spark, {"happy": JOURNALS["happy"] + JOURNALS["two_calls"][4:], "retries": JOURNALS["retries"]}).withColumns({"event_id": F.concat("execution_id", F.lit("#"), F.col("sequence").cast("string")), "timestamp": F.lit("t")})
    wanted = spark.createDataFrame([("happy", 4), ("retries", 5)], "execution_id string, start long")
    verdicts = replay.starts(events, wanted)
    assert {r["execution_id"]: r["verdict"] for r in verdicts.collect()} == {"happy": "ok", "retries": "pending_retry"}
    again = replay.regenerate_from(events, verdicts.where("verdict = 'ok'")).orderBy("sequence").collect()
    assert [(r["event_id"], r["event_type"], r["timestamp"]) for r in again] == [("happy#5", "ToolRequested", "t"), ("happy#6", "ToolStarted", "t")]


def test_differing_attempts_do_not_match(spark):
    odd = {"odd": [event("S"), event("Rq", "c", tool="add"), event("St", "c", attempt=1), event("Rq", "d", tool="add"), event("Fl", "c", attempt=1, error="e")]}
    assert {r["execution_id"]: r["matched"] for r in replay.matched(frame(spark, odd | {"retries": JOURNALS["retries"]})).collect()} == {"odd": False, "retries": True}
    recorded = replay.recorded_with_requests(fold.fold_calls(frame(spark, JOURNALS)), fold.fold_attempts(frame(spark, JOURNALS)))
    assert {r["execution_id"]: len(r["attempts"]) for r in recorded.collect()}["retries"] == 3
    text = reports.mismatch_report(spark.createDataFrame([("x", 2, "tool_name", "add", "mul"), ("y", 0, "missing_recorded_call", "add", None)], "execution_id string, index long, kind string, expected string, received string")).collect()
    assert {r["execution_id"]: r["report"] for r in text}["y"] == "Execution: y\nCall: 0\nMismatch: missing_recorded_call\nExpected: add"


def test_long_logs_and_foreign_executions(spark):
    import time

    n = 20_000
    ops = spark.range(n).selectExpr("'k' as idempotency_key", "id as op_seq", "if(id % 3 = 0, 'claim', 'authorize_retry') as op", "'x' as execution_id", "if(id = 7, 'y', null) as by_execution")
    began = time.perf_counter()
    found = {r["op_seq"]: r["decision"] for r in ledger.decisions(ops).collect()}
    assert len(found) == n and time.perf_counter() - began < 60
    assert found[0] == "execute" and found[1] == "ok" and found[7] == "foreign_execution" and found[3] == "execute"
    assert ledger.records(ops).first()["attempts"] > 1


DAMAGED = [
    ('{"last_sequence": 6}', "state without an execution"),
    ('{"execution_id":"two_calls","last_sequence": 6, "status": "NONSENSE", "tool_calls": "gone"}', "unknown status"),
    ('{"execution_id":"two_calls","last_sequence": 6, "status": "RUNNING", "tool_calls": "gone"}', "calls are no list"),
    ('{"execution_id":"two_calls","last_sequence": 6, "status": "RUNNING", "tool_calls": ["gone"]}', "call without its name"),
    ('{"execution_id":"two_calls","last_sequence": 6, "status": "RUNNING", "tool_calls": [{"call_id": "a", "tool": "t", "status": "LOST", "requested_sequence": 2}]}', "unknown call status"),
    ('{"execution_id":"two_calls","last_sequence": 6, "status": "RUNNING", "tool_calls": [{"call_id": "a", "tool": "t", "status": "STARTED", "requested_sequence": 2, "started_sequence": 7}]}', "call outside of its history"),
    ('{"execution_id":"two_calls","last_sequence": 6, "status": "RUNNING", "tool_calls": [{"call_id": "a", "tool": "t", "status": "STARTED"}]}', "call outside of its history"),
    ('{"execution_id":"two_calls","last_sequence": 6, "status": "RUNNING", "tool_calls": [{"call_id": "a", "tool": "t", "status": "STARTED", "requested_sequence": 2, "attempts": [{"attempt": 1}]}]}', "damaged attempt"),
    ('{"execution_id":"two_calls","last_sequence": 6, "status": "RUNNING", "tool_calls": [{"call_id": "a", "tool": "t", "status": "RETRYING", "requested_sequence": 2, "pending_retry": {"attempt": "x", "sequence": 5}}]}', "damaged retry"),
    ('{"execution_id":"other","last_sequence": 6, "status": "RUNNING"}', "state of another execution"),
    ('{"execution_id":"two_calls","last_sequence": "six", "status": "RUNNING"}', "state without a last sequence"),
    ('{"execution_id":"two_calls","last_sequence": 5, "status": "RUNNING"}', "state is at another sequence"),
    ("[1]", "unreadable state"), ("{", "unreadable state"), ("", "unreadable state"), (None, "unreadable state"),
]


def test_damaged_states_are_refused(spark):
    """Each damage is named, by the reader and by the guards; none is folded on."""
    events = frame(spark, {"two_calls": JOURNALS["two_calls"]})
    stored = spark.createDataFrame([("two_calls", 6, text) for text, _ in DAMAGED], "execution_id string, sequence long, state string")
    none = stored.limit(0)
    for k, (text, reason) in enumerate(DAMAGED):
        one = stored.where(F.col("state").eqNullSafe(F.lit(text)))
        assert checkpoints.corrupt(one, events).first()["reason"] == reason, (k, text)
    assert sorted(r["verdict"] for r in checkpoints.guarded(stored, none, events).collect()) == sorted(reason for _, reason in DAMAGED)
    fine = spark.createDataFrame([("two_calls", 6, '{"execution_id":"two_calls","last_sequence":6,"status":"RUNNING","tool_calls":null}')], stored.schema)
    assert checkpoints.corrupt(fine, events).count() == 0
    whole = checkpoints.rows(frame(spark, JOURNALS))
    kept, refused = validation.sorted_out(whole.unionByName(stored), frame(spark, JOURNALS))
    assert refused.count() == len(DAMAGED) and kept.count() == len(JOURNALS)


def test_a_restarted_execution_keeps_its_result(spark, rows):
    again = {"done": [*JOURNALS["happy"], event("XOk", result="42"), event("S", goal="again")], "failed": [event("S"), event("XFl", error="e"), event("S"), event("Rq", "c", tool="add")]}
    events = frame(spark, again)
    found = checkpoints.recover(events, checkpoints.from_rows(checkpoints.rows(events))).executions.toPandas()
    assert rows(found) == rows(checkpoints.recover(events).executions.toPandas())
    assert dict(zip(found["execution_id"], found["result"], strict=True))["done"] == "42"


def test_engine_stores_checkpoints_under_guards(spark, tmp_path):
    events, path = frame(spark, {k: JOURNALS[k] for k in ("happy", "two_calls")}), str(tmp_path / "saved")
    engine = JournalEngine(spark, events)
    assert {r["execution_id"]: r["verdict"] for r in engine.checkpoint(path, spark.createDataFrame([("happy",)], "execution_id string")).collect()} == {"happy": "store"}
    assert {r["execution_id"]: r["verdict"] for r in engine.checkpoint(path).collect()} == {"happy": "already stored", "two_calls": "store"}
    assert {r["verdict"] for r in engine.checkpoint(path).collect()} == {"already stored"} and journal.read_checkpoints(spark, path).count() == 2
    other = JournalEngine(spark, frame(spark, {"happy": [*JOURNALS["happy"][:3], event("Ok", "c", attempt=1, result="6")]}))
    assert {r["verdict"] for r in other.checkpoint(path).collect()} == {"another state is stored"} and journal.read_checkpoints(spark, path).count() == 2


def test_engine_refuses_two_states_of_one_sequence(spark, tmp_path):
    events = frame(spark, {"happy": JOURNALS["happy"]})
    path, saved = str(tmp_path / "events"), str(tmp_path / "saved")
    journal.write_events(journal.encode(events.drop("error", "result")), path)
    state = checkpoints.rows(events).selectExpr("concat('c', execution_id) as checkpoint_id", "execution_id", "sequence", "state", "cast(null as string) as created_at")
    state.unionByName(state.withColumn("state", F.regexp_replace("state", '"goal":"g"', '"goal":"h"'))).write.parquet(saved)
    with pytest.raises(JournalError, match="two states"):
        JournalEngine.open(spark, path, checkpoints_path=saved)


def test_engine_calls_for_replays(spark):
    engine = JournalEngine(spark, frame(spark, JOURNALS))
    start = lambda *rows: spark.createDataFrame(rows, "execution_id string, start long")
    assert [r["event_type"] for r in engine.replay_from(start(("two_calls", 4))).orderBy("sequence").collect()] == ["ToolRequested", "ToolStarted"]
    with pytest.raises(JournalError, match="open_call"):
        engine.replay_from(start(("happy", 3)))
    assert {(r["execution_id"], r["decision"]) for r in engine.guard_decisions().collect()} == {("dedup", "deduplicated"), ("unenforced", "execute")}
    assert {(r["execution_id"], r["failed_attempt"]) for r in engine.retry_decisions().collect()} == {("retries", 1), ("retries", 2), ("cancel_in_backoff", 1)}
    wanted = spark.createDataFrame([("retries", "c", 3), ("retries", "c", 4)], "execution_id string, call_id string, attempt int")
    assert {r["attempt"]: r["can_attempt"] for r in engine.can_attempt(wanted).collect()} == {3: True, 4: False}
    assert "Recovered from: the whole journal" in engine.report().first()["report"]
    assert engine.difference_from(frame(spark, JOURNALS)).count() == 0
