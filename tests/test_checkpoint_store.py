"""Checkpoints of a stream: epochs, repeats, refusals, and what a recovery goes on from."""

from journals import JOURNALS, event, frame
from pyspark.sql import functions as F

from foldlight.operators import checkpoints
from foldlight.sources import journal
from foldlight.streaming.checkpoints import CheckpointStore, store_checkpoints


def states_equal(spark, rows, store, events):
    again, whole = checkpoints.recover(events, store.snapshot()), checkpoints.recover(events)
    for name in ("calls", "attempts", "executions"):
        one, other = getattr(again, name), getattr(whole, name)
        assert rows(one.toPandas()) == rows(other.select(*one.columns).toPandas()), name


def test_epochs_fold_each_event_once(spark, rows, tmp_path):
    events = frame(spark, JOURNALS).withColumn("timestamp", F.lit("t"))
    store = CheckpointStore(spark, str(tmp_path / "store"))
    for epoch, (low, high) in enumerate([(1, 3), (4, 4), (5, 99)]):
        assert store.commit(events.where(f"sequence between {low} and {high}"), epoch)
        states_equal(spark, rows, store, events.where(f"sequence <= {high}"))
    assert store.refused().count() == 0
    ended = {name: len(found) for name, found in JOURNALS.items() if any(e["event_type"] in ("ExecutionCompleted", "ExecutionFailed", "ExecutionCancelled") for e in found)}
    saved = store.checkpoints()
    assert {r["execution_id"]: r["sequence"] for r in saved.collect()} == ended
    assert checkpoints.corrupt(saved, events).count() == 0
    assert rows(saved.select("execution_id", "sequence", "state").toPandas()) == rows(checkpoints.rows(events.where(F.col("execution_id").isin(*ended))).toPandas())


def test_an_epoch_that_comes_again(spark, rows, tmp_path):
    events = frame(spark, {k: JOURNALS[k] for k in ("happy", "cancel")})
    store = CheckpointStore(spark, str(tmp_path / "store"))
    store.commit(events.where("sequence <= 3"), 0)
    # Broken off before its commit: what it left is written over, and not read meanwhile.
    events.where("sequence > 3").groupBy("execution_id").agg(F.max("sequence").alias("sequence")).write.parquet(store._table(1, "at"))
    assert {r["last_sequence"] for r in store.heads().collect()} == {3}
    assert store.commit(events.where("sequence > 3"), 1)
    before = rows(store.checkpoints().toPandas())
    assert not store.commit(events.where("sequence > 3"), 1) and not store.commit(events, 0)
    assert rows(store.checkpoints().toPandas()) == before and store.committed() == [0, 1]
    states_equal(spark, rows, store, events)


def test_refused_events(spark, rows, tmp_path):
    """Repeats and what stands behind a gap are refused, and the state is that of the events taken."""
    events = frame(spark, {"retries": JOURNALS["retries"], "happy": JOURNALS["happy"]})
    store = CheckpointStore(spark, str(tmp_path / "store"))
    store.commit(events.where("sequence <= 4 and sequence <> 3"), 0)
    assert {(r["execution_id"], r["sequence"], r["reason"]) for r in store.refused().collect()} == {("retries", 4, "gap"), ("happy", 4, "gap")}
    late = events.where("sequence between 2 and 5").unionByName(events.where("sequence = 4"))
    store.commit(late.unionByName(events.where("execution_id = 'retries' and sequence in (7, 8)")), 1)
    found = sorted((r["execution_id"], r["sequence"], r["reason"]) for r in store.refused().where("epoch = 1").collect())
    assert found == sorted([("retries", 2, "duplicate sequence"), ("happy", 2, "duplicate sequence"), ("retries", 7, "gap"), ("retries", 8, "gap")])
    states_equal(spark, rows, store, events.where("sequence <= 5"))


def test_a_boundary_inside_a_batch(spark, tmp_path):
    """The checkpoint is the state at the boundary; events after it are in the next snapshot."""
    whole = {"x": [*JOURNALS["happy"], event("XOk", result="42"), event("S"), event("Rq", "d", tool="add")]}
    store = CheckpointStore(spark, str(tmp_path / "store"))
    store.commit(frame(spark, whole), 0)
    saved = store.checkpoints().first()
    assert saved["sequence"] == 5 and '"status":"COMPLETED"' in saved["state"] and '"call_id":"d"' not in saved["state"]
    assert store.heads().first()["last_sequence"] == 7
    assert checkpoints.recover(frame(spark, whole), store.snapshot()).executions.first()["n_calls"] == 2


def test_stream(spark, rows, tmp_path):
    events = frame(spark, JOURNALS)
    for k in range(3):
        events.where(f"(sequence - 1) div 3 = {k}" if k < 2 else "sequence > 6").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path, state = str(tmp_path / "store"), str(tmp_path / "state")
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = store_checkpoints(stream, path, state)
        query.processAllAvailable()
        query.stop()
    store = CheckpointStore(spark, path)
    assert store.committed() == [0, 1, 2]
    taken = store.snapshot().executions.select("execution_id", "last_sequence").toPandas()
    assert store.refused().count() + taken["last_sequence"].sum() == events.count()
    assert journal.has_rows(spark, f"{path}/commits")
