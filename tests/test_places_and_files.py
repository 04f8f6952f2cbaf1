"""States at many places from one scan, and recovery from the files that hold the tail."""

import pytest
from journals import JOURNALS, event, frame
from pyspark.sql import functions as F

from foldlight.operators import asof, checkpoints
from foldlight.sources import journal
from foldlight.sources.files import JournalFiles


@pytest.mark.parametrize("base", [None, 3])
def test_states_at_every_place(spark, rows, base):
    """Each place as a fold of its own prefix, with and without stored checkpoints before the first place."""
    events = frame(spark, JOURNALS)
    low = 1 if base is None else base + 1
    wanted = events.where(f"sequence >= {low}").select("execution_id", F.col("sequence").alias("upto")).unionByName(spark.createDataFrame([("happy", 99), ("nobody", 3)], "execution_id string, upto long"))
    stored = None if base is None else checkpoints.rows(events.where(f"sequence <= {base}")).unionByName(checkpoints.rows(events.where("sequence <= 2")))
    found = asof.states_at(events, wanted, stored)
    parts = {n: getattr(found, n).drop("started_at").toPandas() for n in ("calls", "attempts", "executions")}
    for upto in range(low, 11):
        limits = events.where(f"sequence = {upto}").select("execution_id", F.col("sequence").alias("upto"))
        whole = checkpoints.state_as_of(events, limits)
        for name, part in parts.items():
            mine = part[(part["upto"] == upto)].drop(columns="upto")
            assert rows(mine) == rows(getattr(whole, name).select(*mine.columns).toPandas()), (name, upto)
    at_end = parts["executions"][parts["executions"]["upto"] == 99]
    assert list(at_end["execution_id"]) == ["happy"] and list(at_end["last_sequence"]) == [4]


def test_a_hundred_places_read_the_journal_once(spark, tmp_path):
    steps = [event("S")]
    for k in range(60):
        steps += [event("Rq", f"c{k}", tool="add"), event("St", f"c{k}", attempt=1), event("Ok", f"c{k}", attempt=1, result="1")]
    frame(spark, {"x": steps, "y": steps}).write.parquet(str(tmp_path / "events"))
    read = spark.sparkContext.accumulator(0)
    events = spark.read.parquet(str(tmp_path / "events"))
    wanted = spark.range(1, 101).crossJoin(events.select("execution_id").distinct()).selectExpr("execution_id", "id as upto")
    counted = spark.createDataFrame(events.rdd.map(lambda r: (read.add(1), r)[1]), events.schema)
    found = asof.states_at(counted, wanted)
    assert found.executions.count() == 200 and found.calls.where("upto = 100").count() == 66
    assert read.value == 2 * len(steps)


def test_recovery_opens_the_files_with_the_tail(spark, rows, tmp_path):
    """Files read follow the tail: the scan's own count of files says so."""
    events = frame(spark, JOURNALS).withColumn("timestamp", F.lit("t"))
    whole = events.withColumns({c: F.when(F.col(c).isNotNull(), F.concat(F.lit('"'), c, F.lit('"'))) for c in ("result", "error")})
    files = JournalFiles(spark, str(tmp_path / "journal"))
    for low, high in ((1, 2), (3, 4), (5, 6), (7, 99)):
        files.append(journal.encode(whole.where(f"sequence between {low} and {high}")))
    every = files.manifest().select("file").distinct().count()
    checkpoints.take(journal.decode(journal.read_events(spark, files.events_path)).where("sequence <= 6")).write(str(tmp_path / "snapshot"))
    snapshot = checkpoints.Snapshot.read(spark, str(tmp_path / "snapshot"))
    tail = files.tail(snapshot.at.withColumnRenamed("sequence", "after"))
    wanted = {r["file"] for r in files.manifest().where("last_sequence > 6").collect()}
    assert {f for f in tail.inputFiles() if "/journal/events/" in f} == wanted and 0 < len(wanted) < every
    assert {(r["execution_id"], r["sequence"]) for r in tail.collect()} == {(r["execution_id"], r["sequence"]) for r in events.where("sequence > 6").collect()}
    plan = tail._jdf.queryExecution().executedPlan()
    tail._jdf.queryExecution().toRdd().count()
    scans = [p for p in str(plan.toString()).split("\n") if "FileScan" in p and "payload" in p]
    assert scans and all(f"InMemoryFileIndex({len(wanted)} paths)" in s for s in scans)
    again, folded = files.recover(snapshot), files.fold()
    for name in ("calls", "attempts", "executions"):
        one, other = getattr(again, name), getattr(folded, name)
        assert rows(one.toPandas()) == rows(other.select(*one.columns).toPandas()), name
    assert {r["execution_id"]: r["last_sequence"] for r in files.last_sequences().collect()} == {k: len(v) for k, v in JOURNALS.items()}


def test_files_that_the_manifest_lacks(spark, tmp_path):
    """A writer that ended before the manifest was written: the next append adds its files; a snapshot ahead is refused."""
    events = frame(spark, {"happy": JOURNALS["happy"]}).drop("result", "error")
    files = JournalFiles(spark, str(tmp_path / "journal"))
    journal.write_events(journal.encode(events.where("sequence <= 2")), files.events_path, "append")
    assert files.manifest().count() == 0
    files.append(journal.encode(events.where("sequence > 2")))
    assert files.manifest().agg(F.sum("n_events")).first()[0] == 4
    none = spark.createDataFrame([], "execution_id string, after long")
    assert files.tail(none).count() == 4 and files.tail(spark.createDataFrame([("happy", 4)], none.schema)).count() == 0
    with pytest.raises(ValueError, match="ahead"):
        files.recover(checkpoints.take(frame(spark, {"happy": JOURNALS["happy"] * 2})))
