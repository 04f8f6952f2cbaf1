"""Checkpoints of a stream of journal events: each micro-batch is merged into the stored partial folds, nothing is folded twice.

A store is a folder of epochs.  An epoch holds the merged partial folds of the executions that its batch touched (`calls`,
`attempts`, `executions`), where they stand (`at`), the events it refused (`refused`), the checkpoint rows that were due
(`checkpoints`) and, written last, its commit.  An epoch without a commit is as if it had never begun and is written again; a
committed one is not repeated, so a batch that comes twice stores nothing.  The newest epoch of an execution counts.

Reading the last state of a batch's executions goes by epoch: only folders that hold one of them are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from foldlight import schemas as S
from foldlight.operators import checkpoints, fold
from foldlight.operators.checkpoints import Snapshot, States
from foldlight.sources import journal
from foldlight.staging import discard, staged

_PARTS = ("calls", "attempts", "executions")


class CheckpointStore:
    """The epochs at `path`.  One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, epoch: int, name: str) -> str:
        return f"{self.path}/{name}/epoch={epoch}"

    def committed(self) -> list[int]:
        """The numbers of the committed epochs, one commit file each."""
        if not journal.has_rows(self.spark, f"{self.path}/commits"):
            return []
        return sorted(r["epoch"] for r in self.spark.read.parquet(f"{self.path}/commits").select("epoch").distinct().collect())

    def _read(self, name: str, epochs: list[int]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*[self._table(e, name) for e in epochs])

    def heads(self, epochs: list[int] | None = None) -> DataFrame | None:
        """(execution_id, epoch, last_sequence): the newest committed epoch of each execution; None if there is no epoch."""
        epochs = self.committed() if epochs is None else epochs
        if not epochs:
            return None
        return self._read("at", epochs).groupBy("execution_id").agg(F.max(F.struct("epoch", F.col("sequence").alias("last_sequence"))).alias("h")).select("execution_id", "h.epoch", "h.last_sequence")

    def snapshot(self, executions: DataFrame | None = None) -> Snapshot | None:
        """The newest partial folds, of all executions or of those given: what checkpoints.recover goes on from."""
        heads = self.heads()
        if heads is None:
            return None
        if executions is not None:
            heads = heads.join(executions.select("execution_id").distinct(), "execution_id", "left_semi")
        heads = staged(heads, "heads")
        epochs = sorted(r["epoch"] for r in heads.select("epoch").distinct().collect())  # one number an epoch, not a row an execution
        if not epochs:
            return None
        newest = lambda name: self._read(name, epochs).join(heads.select("execution_id", "epoch"), ["execution_id", "epoch"], "left_semi").drop("epoch")
        return Snapshot(heads.select("execution_id", F.col("last_sequence").alias("sequence")), *(newest(p) for p in _PARTS))

    def checkpoints(self) -> DataFrame:
        """All stored checkpoint rows."""
        epochs = self.committed()
        return self._read("checkpoints", epochs).select(*S.CHECKPOINTS.fieldNames()) if epochs else self.spark.createDataFrame([], S.CHECKPOINTS)

    def refused(self) -> DataFrame:
        """(epoch, execution_id, sequence, event_type, reason): events that were not appended, and checkpoints that were not stored (event_type null)."""
        return self._read("refused", self.committed())

    def commit(self, batch: DataFrame, epoch: int) -> bool:
        """Merges a batch of decoded events, as one epoch; False if that epoch is committed already.

        Events are taken as far as they follow the last one of their execution without a gap; others are refused with the
        reason.  Checkpoints are due at the last boundary (see checkpoints.boundaries) among the events taken, and are stored if
        the guards let them pass.
        """
        done = self.committed()
        if epoch in done:
            return False
        heads = self.heads(done)
        fresh = self.spark.createDataFrame([], "execution_id string, last_sequence long")
        judged = staged(_judged(fold.conform(batch), fresh if heads is None else heads.select("execution_id", "last_sequence")), "batch")
        taken = judged.where("reason is null").drop("reason")
        before = self.snapshot(taken)
        due = staged(checkpoints.boundaries(taken).groupBy("execution_id").agg(F.max("sequence").alias("due")), "due")
        dealt = taken.join(due, "execution_id", "left")
        # Events up to the boundary are folded once, for the checkpoint and for what follows it.
        upto = _merged(before, dealt.where("sequence <= coalesce(due, sequence)").drop("due"))
        first = Snapshot(upto.at, *(staged(getattr(upto, p), p) for p in _PARTS))
        whole = _merged(first, dealt.where("sequence > due").drop("due"))
        for name in ("at", *_PARTS):
            self._write(getattr(whole, name), epoch, name)
        at_due = Snapshot(*(getattr(first, n).join(due.select("execution_id"), "execution_id", "left_semi") for n in ("at", *_PARTS)))
        rows = checkpoints.state_rows(_states(at_due))
        stored = self._read("checkpoints", done) if done else self.spark.createDataFrame([], S.CHECKPOINTS)
        verdicts = staged(checkpoints.guarded_at(rows, stored, due.withColumnRenamed("due", "last_sequence")), "verdicts")
        name = F.concat(F.lit("ckpt_"), "execution_id", F.lit("_"), F.col("sequence").cast("string"))
        new = verdicts.where("verdict = 'store'").select(name.alias("checkpoint_id"), "execution_id", "sequence", "state", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_at"))
        self._write(new, epoch, "checkpoints")
        not_stored = verdicts.where("verdict not in ('store', 'already stored')").select("execution_id", "sequence", F.lit(None).cast("string").alias("event_type"), F.col("verdict").alias("reason"))
        self._write(judged.where("reason is not null").select("execution_id", "sequence", "event_type", "reason").unionByName(not_stored), epoch, "refused")
        self.spark.range(1).select(F.lit(epoch).cast("long").alias("number")).write.mode("overwrite").parquet(self._table(epoch, "commits"))
        discard(judged, due, verdicts, *(getattr(first, p) for p in _PARTS))
        return True

    def _write(self, rows: DataFrame, epoch: int, name: str) -> None:
        rows.write.mode("overwrite").parquet(self._table(epoch, name))


def _judged(batch: DataFrame, last: DataFrame) -> DataFrame:
    """The batch's events with why each is not taken (null: it is).

    An event is taken if the events from the execution's last one up to it are all there; of events of one sequence the first
    by event_id, where there are ids, counts.
    """
    again = F.struct(*[c for c in ("event_id", "event_type") if c in batch.columns], F.xxhash64(*batch.columns))
    known = batch.join(last, "execution_id", "left").withColumn("_last", F.coalesce("last_sequence", F.lit(0))).drop("last_sequence")
    once = known.groupBy("execution_id", "sequence").agg(F.min(again).alias("_first"))
    # Numbers after the last sequence, without repeats: gapless as far as number and place agree.
    new = once.join(last, "execution_id", "left").where("sequence > coalesce(last_sequence, 0)")
    counted = new.groupBy("execution_id").agg(F.sort_array(F.collect_list(F.col("sequence") - F.coalesce("last_sequence", F.lit(0)))).alias("s"))
    reach = counted.select("execution_id", F.size(F.filter("s", lambda x, i: x == i + 1)).alias("_n"))
    told = known.join(once, ["execution_id", "sequence"]).join(reach, "execution_id", "left")
    reason = (
        F.when(F.col("sequence") < 1, "sequence below 1")
        .when((F.col("sequence") <= F.col("_last")) | (F.col("_first") != again), "duplicate sequence")
        .when(F.col("sequence") > F.col("_last") + F.coalesce("_n", F.lit(0)), "gap")
    )
    judged = told.withColumn("reason", reason).drop("_last", "_first", "_n")
    # An event that the batch holds twice is taken once.
    return judged.where("reason is not null").unionByName(judged.where("reason is null").dropDuplicates(["execution_id", "sequence"]))


def _merged(before: Snapshot | None, events: DataFrame) -> Snapshot:
    """The partial folds of the events, merged with those before."""
    at = events.groupBy("execution_id").agg(F.max("sequence").alias("sequence"))
    calls, attempts, executions = fold.partial_calls(events), fold.partial_attempts(events, before and before.calls), fold.partial_executions(events)
    if before is not None:
        at = before.at.unionByName(at).groupBy("execution_id").agg(F.max("sequence").alias("sequence"))
        calls, attempts, executions = before.calls.unionByName(calls), before.attempts.unionByName(attempts), before.executions.unionByName(executions)
    return Snapshot(at, fold.merge_calls(calls), fold.merge_attempts(attempts), fold.merge_executions(executions))


def _states(snapshot: Snapshot) -> States:
    # Merged once more, which changes nothing: Catalyst cannot prune the fields of stored structs below the explosion of requests.
    calls = fold.finish_calls(fold.merge_calls(snapshot.calls))
    return States(calls, fold.finish_attempts(snapshot.attempts), fold.finish_executions(snapshot.executions, calls))


def store_checkpoints(events: DataFrame, path: str, stream_state: str) -> StreamingQuery:
    """Starts a query that commits each micro-batch of a streaming frame of decoded events to the store at `path`.

    stream_state: the query's own checkpoint folder.  After a restart the last batch may come again: its epoch is committed, so
    nothing is stored twice.
    """
    store = CheckpointStore(events.sparkSession, path)
    return events.writeStream.foreachBatch(lambda batch, epoch: store.commit(batch, epoch) and None).option("checkpointLocation", stream_state).start()
