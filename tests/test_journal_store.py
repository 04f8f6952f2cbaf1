import json

import pytest
from journals import JOURNALS, frame

from foldlight import cli
from foldlight.engine import JournalEngine, JournalError
from foldlight.operators import checkpoints, scans
from foldlight.sources import journal


def events_of(spark):
    """Journals whose errors are JSON, as stored ones are."""
    return frame(spark, {k: JOURNALS[k] for k in ("happy", "retries", "two_calls", "terminal_open")}).selectExpr("* except (error)", "to_json(named_struct('message', error)) as error_json").selectExpr("* except (error_json)", "nullif(error_json, '{}') as error")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("journal") / "events")
    events = events_of(spark)
    journal.write_events(journal.encode(events), path)
    return path


def test_round_trip(spark, stored):
    events = events_of(spark)
    read = journal.decode(journal.read_events(spark, stored))
    columns = [c for c in events.columns if c not in ("deduplicated",)]
    assert checkpoints.difference(events.select(*columns), read.select(*columns)).count() == 0
    assert journal.unreadable(journal.read_events(spark, stored)).count() == 0


def test_payload_values(spark):
    payload = json.dumps({"call_id": "c", "arguments": {"b": [1, None], "a": 1.0}, "attempt": 2, "result": "text", "enforced": False, "extra": 1})
    rows = spark.createDataFrame([("e1", "x", 1, "ToolRequested", payload, None), ("e2", "x", 2, "ToolStarted", None, None), ("e3", "x", 3, "Nope", "{}", None), ("e4", "x", 4, "ToolStarted", "{NaN", None), ("e5", "x", 5, "ToolStarted", '{"attempt":"two"}', None)], "event_id string, execution_id string, sequence long, event_type string, payload string, timestamp string")
    first = journal.decode(rows.where("sequence = 1")).collect()[0]
    assert (first["arguments"], first["attempt"], first["result"], first["enforced"], first["goal"]) == ('{"a":1,"b":[1,null]}', 2, '"text"', False, None)
    assert {r["event_id"]: r["reason"] for r in journal.unreadable(rows).collect()} == {"e3": "unknown event type", "e4": "payload is not JSON", "e5": "attempt is not a number"}


def test_appends(spark):
    last = spark.createDataFrame([("x", 3)], "execution_id string, last_sequence long")
    batch = spark.createDataFrame([("a", "x", 4), ("b", "x", 6), ("c", "y", 1), ("d", "z", 0)], "event_id string, execution_id string, sequence long")
    assert {r["event_id"]: r["reason"] for r in journal.rejected_appends(batch, last).collect()} == {"b": "gap", "d": "sequence below 1"}
    new = spark.createDataFrame([("a", "x", "t2"), ("b", "x", "t1"), ("c", "y", "t1")], "event_id string, execution_id string, timestamp string")
    assert {r["event_id"]: r["sequence"] for r in journal.numbered(new, last).collect()} == {"b": 4, "a": 5, "c": 1}


def test_engine(spark, stored):
    engine = JournalEngine.open(spark, stored)
    engine.check()
    assert [r["sequence"] for r in engine.scan("happy", 2).collect()] == [3, 4]
    assert engine.event("happy", 4)["event_type"] == "ToolCompleted"
    with pytest.raises(JournalError):
        engine.event("happy", 5)
    assert {r["execution_id"]: r["recovery_class"] for r in engine.recovery().collect()} == {"happy": "RUNNING", "retries": "RUNNING", "two_calls": "RECOVERY_REQUIRED", "terminal_open": "FAILED"}
    assert {r["execution_id"]: r["n_checkpoints"] for r in engine.listing().collect()}["happy"] == 0
    keys = spark.createDataFrame([("happy",), ("none",)], "execution_id string")
    assert [r[0] for r in scans.existing(keys, engine.events).collect()] == ["happy"]
    broken = JournalEngine(spark, engine.events.where("sequence <> 2"))
    with pytest.raises(JournalError):
        broken.check()


def test_cli(spark, stored, capsys, tmp_path):
    assert cli.main(["list", stored, "--json"], spark) == 0
    assert {json.loads(x)["execution_id"] for x in capsys.readouterr().out.splitlines()} == {"happy", "retries", "two_calls", "terminal_open"}
    assert cli.main(["replay", stored], spark) == 0 and cli.main(["recovery", stored], spark) == 0
    bad = str(tmp_path / "bad")
    journal.read_events(spark, stored).selectExpr("event_id", "execution_id", "sequence", "'Nope' as event_type", "payload", "timestamp").write.parquet(bad)
    assert cli.main(["list", bad], spark) == 2
