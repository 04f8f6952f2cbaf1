"""One object for the questions asked of a store of journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlight.operators import asof, checkpoints, fold, histories, ledger, recovery, replay, reports, scans, validation
from foldlight.sources import journal


class JournalError(ValueError):
    """A journal that breaks its own rules."""


class JournalEngine:
    """Answers over a decoded journal, optional ledger operations and an optional snapshot, for all executions at once."""

    def __init__(self, spark: SparkSession, events: DataFrame, ops: DataFrame | None = None, snapshot: checkpoints.Snapshot | None = None):
        self.spark, self.events, self.ops, self.snapshot = spark, events, ops, snapshot

    @classmethod
    def open(cls, spark: SparkSession, events_path: str, ops_path: str | None = None, snapshot_path: str | None = None, checkpoints_path: str | None = None) -> "JournalEngine":
        """From Parquet folders, with a snapshot or checkpoint rows (the latest of each execution counts).

        Refuses events and ledger operations that cannot be read, and checkpoints that the journal does not support: states
        are never silently folded without them.
        """
        stored = journal.read_events(spark, events_path)
        if bad := journal.unreadable(stored).limit(1).collect():
            raise JournalError(f"event {bad[0]['event_id']}: {bad[0]['reason']}")
        ops = journal.read_ledger_ops(spark, ops_path) if ops_path else None
        if ops is not None and (bad := validation.unreadable_ops(ops).limit(1).collect()):
            raise JournalError(f"ledger operation that cannot be read: {bad[0].asDict()}")
        events = journal.decode(stored)
        snapshot = checkpoints.Snapshot.read(spark, snapshot_path) if snapshot_path else None
        if checkpoints_path:
            saved = journal.read_checkpoints(spark, checkpoints_path)
            if bad := checkpoints.corrupt(saved, events).limit(1).collect():
                raise JournalError(f"corrupt checkpoint: {bad[0].asDict()}")
            if bad := validation.conflicting_checkpoints(saved).limit(1).collect():
                raise JournalError(f"two states of one sequence: {bad[0].asDict()}")
            snapshot = checkpoints.from_rows(scans.latest_checkpoints(saved))
        if snapshot and (bad := checkpoints.ahead_of_journal(snapshot, events).limit(1).collect()):
            raise JournalError(f"snapshot ahead of journal: {bad[0].asDict()}")
        return cls(spark, events, ops, snapshot)

    def check(self) -> None:
        """Raises on the first violation of a journal's rules."""
        for name, found in (("gap or duplicate", validation.sequence_gaps(self.events)), ("unknown event type", validation.unknown_event_types(self.events)), ("event of an unknown call", validation.orphan_call_events(self.events))):
            if bad := found.limit(1).collect():
                raise JournalError(f"{name}: {bad[0].asDict()}")
        if self.snapshot and (bad := checkpoints.ahead_of_journal(self.snapshot, self.events).limit(1).collect()):
            raise JournalError(f"snapshot ahead of journal: {bad[0].asDict()}")

    def scan(self, execution_id: str, after: int = 0) -> DataFrame:
        return scans.execution_events(self.events, execution_id).where(F.col("sequence") > after)

    def event(self, execution_id: str, sequence: int):
        """The event, or JournalError if there is none."""
        found = scans.point(self.events, execution_id, sequence).limit(1).collect()
        if not found:
            raise JournalError(f"no event {sequence} of {execution_id}")
        return found[0]

    def executions(self) -> DataFrame:
        return scans.execution_ids(self.events)

    def states(self) -> checkpoints.States:
        return checkpoints.recover(self.events, self.snapshot)

    def states_as_of(self, limits: DataFrame) -> checkpoints.States:
        return checkpoints.state_as_of(self.events, limits)

    def ledger(self) -> DataFrame | None:
        return ledger.records(self.ops) if self.ops is not None else None

    def _unresolved(self) -> DataFrame | None:
        return ledger.unresolved(self.ledger()) if self.ops is not None else None

    def recovery(self) -> DataFrame:
        return recovery.classify(self.states().executions, self._unresolved())

    def listing(self) -> DataFrame:
        none = self.spark.createDataFrame([], "execution_id string")
        saved = self.snapshot.at if self.snapshot else none
        keys = self._unresolved()
        return recovery.listing(self.states().executions, saved, none if keys is None else keys)

    def report(self) -> DataFrame:
        """(execution_id, report): what a restart finds, as text."""
        states = self.states()
        return reports.recovery_report(states.executions, states.calls, self._unresolved(), details=True, snapshot_at=self.snapshot.at if self.snapshot else None)

    def incomplete(self) -> DataFrame:
        return recovery.incomplete_tools(self.states().calls)

    def pending_retries(self) -> DataFrame:
        """Work to carry on, with the policy and deadline that the call was requested with."""
        calls = self.states().calls
        return recovery.pending_retries(calls).join(calls.select("execution_id", "call_id", "retry_policy", "timeout", "timeout_mode"), ["execution_id", "call_id"])

    def resolve(self, decisions: DataFrame) -> DataFrame:
        """Event rows to append for decisions on open calls."""
        states = self.states()
        return recovery.resolutions(decisions, states.calls, states.executions)

    def replay(self) -> DataFrame:
        return replay.matched(self.events)

    def replay_summary(self) -> DataFrame:
        return replay.summary(self.events, fold.fold_calls(self.events), fold.fold_attempts(self.events))

    def replay_from(self, starts: DataFrame) -> DataFrame:
        """The events after each execution's start, made again; starts (execution_id, start) that no replay can begin at are refused."""
        verdicts = replay.starts(self.events, starts)
        if bad := verdicts.where("verdict <> 'ok'").limit(1).collect():
            raise JournalError(f"a replay cannot start there: {bad[0].asDict()}")
        return replay.regenerate_from(self.events, verdicts)

    def guard_decisions(self) -> DataFrame:
        """How a replay answers keyed calls, without a ledger."""
        return replay.guard_decisions(self.states().calls)

    def retry_decisions(self) -> DataFrame:
        """The retries that the journal recorded."""
        return replay.retry_decisions(self.states().attempts)

    def can_attempt(self, wanted: DataFrame) -> DataFrame:
        """Whether the history holds an outcome of each wanted attempt (execution_id, call_id, attempt)."""
        return replay.can_attempt(self.states().attempts, wanted)

    def states_at(self, wanted: DataFrame, checkpoints_path: str | None = None) -> checkpoints.States:
        """States at many sequences of each execution, from stored checkpoints on where there are any."""
        stored = journal.read_checkpoints(self.spark, checkpoints_path) if checkpoints_path else None
        return asof.states_at(self.events, wanted, stored)

    def difference_from(self, other: DataFrame) -> DataFrame:
        """Where each execution's history first parts from that of another journal."""
        return histories.compare(self.events, other)

    def compare(self, candidate: DataFrame) -> DataFrame:
        """Where each execution's candidate calls first leave the recorded ones."""
        return replay.first_mismatches(replay.recorded_calls(self.states().calls), candidate)

    def snapshot_now(self) -> checkpoints.Snapshot:
        return checkpoints.take(self.events)

    def checkpoint(self, path: str, executions: DataFrame | None = None) -> DataFrame:
        """Takes, guards and stores a checkpoint of each execution, or of those given, at its journal's end.

        Returns (execution_id, sequence, state, verdict): `store` for those stored now, `already stored`, or why one was refused.
        """
        events = self.events if executions is None else self.events.join(executions.select("execution_id"), "execution_id", "left_semi")
        return checkpoints.store(checkpoints.rows(events), path, scans.last_sequences(events))
