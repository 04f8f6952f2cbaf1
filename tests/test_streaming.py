from journals import JOURNALS, event, frame, repeated_outcomes, walked_attempts

from foldlight.operators import checkpoints, fold
from foldlight.operators import ledger as batch_ledger
from foldlight.streaming import journal as stream_journal
from foldlight.streaming import ledger as stream_ledger


def run(spark, frames, path, transform, checkpoint, name):
    """The stream's output, a file after the other."""
    for k, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(path)
        source = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(path)
        out = []
        query = transform(source).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _, out=out: out.extend(df.collect())).trigger(availableNow=True).start()
        query.awaitTermination(120)
        yield from out


def test_calls_over_a_stream(spark, tmp_path):
    events = frame(spark, {k: v for k, v in JOURNALS.items() if k != "same_call_id"})
    parts = [events.where("sequence <= 3"), events.where("sequence between 4 and 6"), events.where("sequence > 6")]
    found = list(run(spark, parts, str(tmp_path / "in"), stream_journal.call_updates, str(tmp_path / "state"), "calls"))
    assert not [r for r in found if r["kind"] == "rejected"]
    last = {(r["execution_id"], r["call_id"]): (r["status"], r["attempt"], r["started_sequence"], r["completed_sequence"], r["pending_sequence"]) for r in sorted((r for r in found if r["kind"] == "call"), key=lambda r: r["sequence"])}
    batch = {(r["execution_id"], r["call_id"]): (r["status"], r["attempt"], r["started_sequence"], r["completed_sequence"], r["pending_retry"] and r["pending_retry"]["sequence"]) for r in fold.fold_calls(events).collect()}
    assert last == batch


def test_gaps_and_duplicates_are_rejected(spark, tmp_path):
    events = frame(spark, {"retries": JOURNALS["retries"]})
    parts = [events.where("sequence <= 2"), events.where("sequence = 5"), events.where("sequence = 2"), events.where("sequence = 3")]
    found = list(run(spark, parts, str(tmp_path / "in"), stream_journal.call_updates, str(tmp_path / "state"), "gaps"))
    assert [(r["sequence"], r["kind"], r["reason"]) for r in found] == [(1, "execution", None), (2, "call", None), (5, "rejected", "gap"), (2, "rejected", "late or duplicate"), (3, "call", None)]


def test_ledger_over_a_stream(spark, tmp_path):
    rows = [(f"k{n % 3}", n, op, f"r{n}", f"e{n}") for n, op in enumerate(["claim", "claim", "complete", "complete", "fail", "claim", "claim", "authorize_retry", "claim", "claim", "claim", "authorize_retry"])]
    ops = spark.createDataFrame(rows, "idempotency_key string, op_seq long, op string, result string, error string")
    found = list(run(spark, [ops.where("op_seq < 5"), ops.where("op_seq >= 5")], str(tmp_path / "in"), stream_ledger.decisions, str(tmp_path / "state"), "ledger"))
    batch = {(r["idempotency_key"], r["op_seq"]): (r["decision"], r["result"]) for r in batch_ledger.decisions(ops).collect()}
    assert {(r["idempotency_key"], r["op_seq"]): (r["decision"], r["result"]) for r in found} == batch


def test_ledger_records_and_scope_over_a_stream(spark, tmp_path):
    """Whole records, and settlements by a foreign execution, as the batch ledger has them."""
    import random

    pick = random.Random(2)
    rows = [(pick.choice(["a", "b"]), n, pick.choice(["claim", "claim", "authorize_retry", "fail", "odd"]), f"r{n}", f"e{n}", pick.choice(["x", "y", None]), pick.choice([None, None, "x", "y"]), f"c{n}", "t", f"a{n}", f"n{n}", str(n)) for n in range(120)]
    ops = spark.createDataFrame(rows, "idempotency_key string, op_seq long, op string, result string, error string, execution_id string, by_execution string, call_id string, tool_name string, arguments string, note string, ts string")
    found = list(run(spark, [ops.where("op_seq < 70"), ops.where("op_seq >= 70")], str(tmp_path / "in"), stream_ledger.decisions, str(tmp_path / "state"), "records"))
    assert {(r["idempotency_key"], r["op_seq"]): (r["decision"], r["result"]) for r in found} == {(r["idempotency_key"], r["op_seq"]): (r["decision"], r["result"]) for r in batch_ledger.decisions(ops).collect()}
    last = {r["idempotency_key"]: r for r in sorted(found, key=lambda r: r["op_seq"])}
    renamed = {"result": "record_result", "error": "record_error"}
    for record in batch_ledger.records(ops).collect():
        assert all(last[record["idempotency_key"]][renamed.get(c, c)] == record[c] for c in record.asDict()), record
    assert any(r["decision"] == "foreign_execution" for r in found)


def last_states(found):
    calls = {(r["execution_id"], r["call_id"]): (r["status"], r["attempt"], r["started_sequence"], r["completed_sequence"], r["pending_sequence"], r["result"], r["error"], r["enforced"]) for r in sorted((r for r in found if r["kind"] == "call"), key=lambda r: r["sequence"])}
    attempts = {(r["execution_id"], r["call_id"], r["attempt_number"]): (r["attempt_status"], r["attempt_started"], r["attempt_completed"], r["attempt_result"], r["attempt_error"], r["retry_sequence"], r["retry_attempt"], r["retry_delay"]) for r in sorted((r for r in found if r["attempt_number"]), key=lambda r: r["sequence"])}
    return calls, attempts


def batch_states(events):
    calls = {(r["execution_id"], r["call_id"]): (r["status"], r["attempt"], r["started_sequence"], r["completed_sequence"], r["pending_retry"] and r["pending_retry"]["sequence"], r["result"], r["error"], r["enforced"]) for r in fold.fold_calls(events).collect()}
    attempts = {(r["execution_id"], r["call_id"], r["attempt"]): (r["status"], r["started_sequence"], r["completed_sequence"], r["result"], r["error"], r["retry_sequence"], r["retry_attempt"], r["retry_delay"]) for r in fold.fold_attempts(events).collect()}
    return calls, attempts


def test_attempts_results_and_errors_over_a_stream(spark, tmp_path):
    events = frame(spark, {k: v for k, v in JOURNALS.items() if k != "same_call_id"})
    found = list(run(spark, [events.where("sequence <= 4"), events.where("sequence > 4")], str(tmp_path / "in"), stream_journal.call_updates, str(tmp_path / "state"), "attempts"))
    assert last_states(found) == batch_states(events)


def test_stream_from_a_snapshot(spark, tmp_path):
    """Snapshot and stream together are the batch fold; calls of ended executions are dropped, repeats still told."""
    journals = {k: v for k, v in JOURNALS.items() if k != "same_call_id"}
    events = frame(spark, journals)
    snapshot = checkpoints.take(events.where("sequence <= 4"))
    snapshot.write(str(tmp_path / "snapshot"))
    stored = checkpoints.Snapshot.read(spark, str(tmp_path / "snapshot"))
    begun = lambda source: stream_journal.call_updates(source, stored)
    found = list(run(spark, [events.where("sequence > 4"), events.where("sequence = 5")], str(tmp_path / "in"), begun, str(tmp_path / "state"), "snapshot"))
    calls, attempts = last_states([r for r in found if r["kind"] != "rejected"])
    whole_calls, whole_attempts = batch_states(events)
    touched = {(r["execution_id"], r["call_id"]) for r in events.where("sequence > 4 and call_id is not null").collect()}
    assert calls == {k: v for k, v in whole_calls.items() if k in touched} and attempts.items() <= whole_attempts.items() and attempts
    assert {(r["sequence"], r["reason"]) for r in found if r["kind"] == "rejected"} == {(5, "late or duplicate")}


def test_ended_executions_are_evicted(spark, tmp_path):
    again = {"x": [*JOURNALS["happy"], event("XOk"), event("S"), event("St", "c", attempt=2), event("Rq", "d", tool="add")]}
    events = frame(spark, again)
    evicting = lambda source: stream_journal.call_updates(source, evict=True)
    found = list(run(spark, [events.where("sequence <= 5"), events.where("sequence > 5")], str(tmp_path / "in"), evicting, str(tmp_path / "state"), "evict"))
    assert [(r["sequence"], r["kind"], r["reason"]) for r in found if r["sequence"] > 5] == [(6, "execution", None), (7, "rejected", "unknown call"), (8, "rejected", "gap")]


def test_repeated_outcomes_over_a_stream(spark, tmp_path):
    journals = repeated_outcomes(20)
    events = frame(spark, journals)
    found = list(run(spark, [events.where("sequence <= 7"), events.where("sequence > 7")], str(tmp_path / "in"), stream_journal.call_updates, str(tmp_path / "state"), "repeated"))
    last = {(r["execution_id"], r["attempt_number"]): (r["attempt_started"], r["attempt_completed"]) for r in sorted(found, key=lambda r: r["sequence"]) if r["attempt_number"]}
    assert last == walked_attempts(journals)
