"""Queries over the journal projected from `events`, and DuckDB SQL that says the same in another way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlight import schemas as S
from foldlight.functions import policy, predicates
from foldlight.functions.policy import backoff_delay, is_exhausted, should_retry
from foldlight.functions.tools import arithmetic
from foldlight.operators import asof, checkpoints, fold, histories, ledger, recovery, replay, reports, scans, validation
from foldlight.sources import journal as store
from foldlight.sources import projection
from foldlight.sources.files import JournalFiles
from foldlight.sources.projection import journal
from foldlight.staging import new_path, staged
from foldlight.streaming.checkpoints import CheckpointStore

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its name, with its SQL over the projected journal."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = projection.ORACLE + sql
        return f

    return add


def raw_query(sql: str):
    """The same for SQL that stands alone."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# -- scans ---------------------------------------------------------------------------------------------------------

_SCAN = ("execution_id", "sequence", "event_type", "call_id", "attempt", "result", "error")
_SCAN_SQL = ", ".join(_SCAN)


@query(f"SELECT {_SCAN_SQL} FROM journal WHERE execution_id = 'exec_7'")
def journal_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.execution_events(journal(spark, sf_dir), "exec_7").select(*_SCAN)


def _stored_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal written once, for queries that read it in several branches."""
    return staged(journal(spark, sf_dir), "journal")


def _halves(events: DataFrame) -> DataFrame:
    """(execution_id, upto): half of each execution's last sequence."""
    return scans.last_sequences(events).select("execution_id", F.expr("last_sequence div 2").alias("upto"))


@query(f"SELECT {_SCAN_SQL} FROM (SELECT *, max(sequence) OVER (PARTITION BY execution_id) AS top FROM journal) WHERE sequence > top // 2")
def journal_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = journal(spark, sf_dir)
    return scans.tail(events, _halves(events).withColumnRenamed("upto", "after")).select(*_SCAN)


@query(f"SELECT {_SCAN_SQL} FROM journal WHERE execution_id = 'exec_3' AND sequence = 5")
def journal_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.point(journal(spark, sf_dir), "exec_3", 5).select(*_SCAN)


@query("SELECT DISTINCT execution_id, last_value(sequence) OVER (PARTITION BY execution_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_sequence FROM journal")
def journal_last_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.last_sequences(journal(spark, sf_dir))


@query(f"SELECT {_SCAN_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY sequence DESC) AS n FROM journal) WHERE n = 1")
def journal_last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.last_events(journal(spark, sf_dir)).select(*_SCAN)


@query("SELECT execution_id, count(*)::BIGINT AS n_events FROM journal GROUP BY ALL")
def journal_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.event_counts(journal(spark, sf_dir))


@query("SELECT DISTINCT execution_id FROM journal")
def journal_execution_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.execution_ids(journal(spark, sf_dir))


# -- validation, over a damaged journal ------------------------------------------------------------------------------

_DAMAGED = ", bad AS (SELECT * FROM journal WHERE sequence % 7 <> 0 UNION ALL SELECT * FROM journal WHERE sequence % 11 = 0)\n"


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without each seventh event, with each eleventh twice."""
    events = journal(spark, sf_dir)
    copies = F.when(F.col("sequence") % 7 != 0, 1).otherwise(0) + F.when(F.col("sequence") % 11 == 0, 1).otherwise(0)
    return events.withColumn("_n", copies).where("_n > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), "_n"))).drop("_n")


@query(_DAMAGED + "SELECT execution_id, sequence, expected FROM (SELECT execution_id, sequence, coalesce(lag(sequence) OVER (PARTITION BY execution_id ORDER BY sequence), 0) + 1 AS expected FROM bad) WHERE sequence <> expected")
def journal_gap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.sequence_gaps(_damaged(spark, sf_dir))


@query(_DAMAGED + "SELECT execution_id, sequence, count(*)::BIGINT AS n FROM bad GROUP BY ALL HAVING count(*) > 1")
def journal_duplicate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.duplicate_sequences(_damaged(spark, sf_dir))


@query(_DAMAGED + """SELECT execution_id, call_id, sequence, event_type FROM bad b WHERE event_type LIKE 'Tool%' AND event_type <> 'ToolRequested'
  AND NOT EXISTS (SELECT 1 FROM bad r WHERE r.execution_id = b.execution_id AND r.call_id = b.call_id AND r.event_type = 'ToolRequested' AND r.sequence < b.sequence)""")
def orphan_call_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.orphan_call_events(_damaged(spark, sf_dir)).select("execution_id", "call_id", "sequence", "event_type")


@query(_DAMAGED + """SELECT execution_id, call_id, sequence, before, event_type FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY execution_id, call_id ORDER BY sequence) AS before FROM (SELECT DISTINCT * FROM bad) WHERE call_id IS NOT NULL)
  WHERE (coalesce(before, '-') || '>' || event_type) NOT IN ('->ToolRequested', 'ToolRequested>ToolStarted', 'ToolRequested>ToolCompleted', 'ToolRequested>ToolCancelled',
    'ToolStarted>ToolCompleted', 'ToolStarted>ToolFailed', 'ToolStarted>ToolTimedOut', 'ToolStarted>ToolCancelled', 'ToolFailed>ToolRetryScheduled', 'ToolTimedOut>ToolRetryScheduled',
    'ToolRetryScheduled>ToolStarted', 'ToolRetryScheduled>ToolCancelled')""")
def event_grammar_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.grammar_violations(_damaged(spark, sf_dir).distinct())


# -- state -----------------------------------------------------------------------------------------------------------

#: Call state by ranking instead of aggregates; {journal} is the journal that is folded.
_CALLS = """, tool_events AS (SELECT * FROM {journal} WHERE call_id IS NOT NULL),
lasts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY execution_id, call_id ORDER BY sequence DESC) AS n FROM tool_events) WHERE n = 1),
tried AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY execution_id, call_id ORDER BY sequence DESC) AS n FROM tool_events WHERE event_type NOT IN ('ToolRequested', 'ToolRetryScheduled')) WHERE n = 1),
settled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY execution_id, call_id ORDER BY sequence DESC) AS n FROM tool_events WHERE event_type IN ('ToolCompleted', 'ToolFailed', 'ToolTimedOut', 'ToolCancelled')) WHERE n = 1),
begun AS (SELECT execution_id, call_id, max(sequence) AS sequence FROM tool_events WHERE event_type = 'ToolStarted' GROUP BY ALL),
waits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY execution_id, call_id ORDER BY sequence DESC) AS n FROM tool_events WHERE event_type IN ('ToolRetryScheduled', 'ToolStarted', 'ToolCancelled')) WHERE n = 1 AND event_type = 'ToolRetryScheduled'),
calls AS (
  SELECT q.execution_id, q.call_id, q.tool, q.arguments, q.deduplicated,
    CASE l.event_type WHEN 'ToolRequested' THEN 'REQUESTED' WHEN 'ToolStarted' THEN 'STARTED' WHEN 'ToolCompleted' THEN 'COMPLETED' WHEN 'ToolFailed' THEN 'FAILED'
      WHEN 'ToolRetryScheduled' THEN 'RETRYING' WHEN 'ToolTimedOut' THEN 'TIMED_OUT' WHEN 'ToolCancelled' THEN 'CANCELLED' END AS status,
    coalesce(t.attempt, 0) AS attempt, CASE WHEN s.event_type = 'ToolCompleted' THEN s.result END AS result, CASE WHEN s.event_type <> 'ToolCompleted' THEN s.error END AS error,
    CASE WHEN s.event_type = 'ToolTimedOut' THEN s.enforced END AS enforced, q.sequence AS requested_sequence, coalesce(b.sequence, 0) AS started_sequence, coalesce(s.sequence, 0) AS completed_sequence,
    w.sequence AS pending_sequence, w.attempt AS pending_attempt, w.failed_attempt AS pending_failed_attempt, w.delay AS pending_delay
  FROM tool_events q JOIN lasts l USING (execution_id, call_id) LEFT JOIN tried t USING (execution_id, call_id) LEFT JOIN settled s USING (execution_id, call_id)
    LEFT JOIN begun b USING (execution_id, call_id) LEFT JOIN waits w USING (execution_id, call_id)
  WHERE q.event_type = 'ToolRequested')
"""
#: Execution state over those calls.
_STATES = """, lifecycle AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY sequence DESC) AS n FROM {journal} WHERE event_type LIKE 'Execution%') WHERE n = 1),
opened AS (SELECT execution_id, count(*)::BIGINT AS n_calls, count(*) FILTER (status IN ('REQUESTED', 'STARTED'))::BIGINT AS n_incomplete, count(pending_sequence)::BIGINT AS n_pending FROM calls GROUP BY ALL),
sizes AS (SELECT execution_id, max(sequence) AS last_sequence, count(*)::BIGINT AS n_events FROM {journal} GROUP BY ALL),
states AS (
  SELECT z.execution_id, last_sequence, n_events, coalesce(n_calls, 0) AS n_calls, coalesce(n_incomplete, 0) AS n_incomplete, coalesce(n_pending, 0) AS n_pending,
    CASE l.event_type WHEN 'ExecutionCompleted' THEN 'COMPLETED' WHEN 'ExecutionFailed' THEN 'FAILED' WHEN 'ExecutionCancelled' THEN 'CANCELLED'
      ELSE CASE WHEN coalesce(n_incomplete, 0) > 0 THEN 'RECOVERY_REQUIRED' ELSE 'RUNNING' END END AS status
  FROM sizes z LEFT JOIN lifecycle l USING (execution_id) LEFT JOIN opened o USING (execution_id))
"""
_CALLS_OF = _CALLS.replace("{journal}", "journal")
_STATES_OF = _CALLS_OF + _STATES.replace("{journal}", "journal")
_CALL_COLUMNS = ("execution_id", "call_id", "tool", "status", "attempt", "result", "error", "requested_sequence", "started_sequence", "completed_sequence", "pending_sequence")
_CALL_SQL = ", ".join(_CALL_COLUMNS)
_STATE_COLUMNS = ("execution_id", "status", "last_sequence", "n_events", "n_calls", "n_incomplete", "n_pending")
_STATE_SQL = ", ".join(_STATE_COLUMNS)


def _flat(calls: DataFrame) -> DataFrame:
    return calls.withColumn("pending_sequence", F.col("pending_retry.sequence")).select(*_CALL_COLUMNS)


@query(_CALLS_OF + f"SELECT {_CALL_SQL} FROM calls")
def call_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(fold.fold_calls(journal(spark, sf_dir)))


_ATTEMPTS = """, numbered AS (SELECT *, CASE WHEN event_type = 'ToolRetryScheduled' THEN failed_attempt ELSE attempt END AS number FROM journal WHERE call_id IS NOT NULL AND event_type <> 'ToolRequested'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY execution_id, call_id, number ORDER BY sequence DESC) AS n FROM numbered WHERE event_type <> 'ToolRetryScheduled'),
attempts AS (SELECT r.execution_id, r.call_id, r.number AS attempt,
  CASE r.event_type WHEN 'ToolStarted' THEN 'STARTED' WHEN 'ToolCompleted' THEN 'COMPLETED' WHEN 'ToolFailed' THEN 'FAILED' WHEN 'ToolTimedOut' THEN 'TIMED_OUT' ELSE 'CANCELLED' END AS status,
  coalesce((SELECT max(sequence) FROM numbered b WHERE b.execution_id = r.execution_id AND b.call_id = r.call_id AND b.number = r.number AND b.event_type = 'ToolStarted'), 0) AS started_sequence,
  CASE WHEN r.event_type = 'ToolStarted' THEN 0 ELSE r.sequence END AS completed_sequence, CASE WHEN r.event_type = 'ToolCompleted' THEN r.result END AS result,
  CASE WHEN r.event_type NOT IN ('ToolCompleted', 'ToolStarted') THEN r.error END AS error, w.sequence AS retry_sequence, w.delay AS retry_delay
  FROM ranked r LEFT JOIN (SELECT * FROM numbered WHERE event_type = 'ToolRetryScheduled') w ON w.execution_id = r.execution_id AND w.call_id = r.call_id AND w.number = r.number
  WHERE r.n = 1)
"""
_ATTEMPT_COLUMNS = ("execution_id", "call_id", "attempt", "status", "started_sequence", "completed_sequence", "result", "error", "retry_sequence", "retry_delay")


@query(_ATTEMPTS + f"SELECT {', '.join(_ATTEMPT_COLUMNS)} FROM attempts")
def call_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.fold_attempts(journal(spark, sf_dir)).select(*_ATTEMPT_COLUMNS)


_REPEATED_SQL = """
, tries AS (
  SELECT execution_id, call_id, sequence * 2 AS sequence, event_type, attempt FROM journal WHERE event_type = 'ToolStarted' AND attempt = 1 OR event_type IN ('ToolCompleted', 'ToolFailed', 'ToolTimedOut', 'ToolCancelled')
  UNION ALL SELECT execution_id, call_id, sequence * 2 + 1, event_type, attempt FROM journal WHERE event_type IN ('ToolCompleted', 'ToolFailed', 'ToolTimedOut', 'ToolCancelled')
), found AS (
  SELECT e.execution_id, e.call_id, e.attempt, e.sequence, e.event_type, arg_max(p.attempt, p.sequence) AS before, max(p.sequence) FILTER (p.event_type = 'ToolStarted') AS begun
  FROM tries e LEFT JOIN tries p ON e.execution_id = p.execution_id AND e.call_id = p.call_id AND p.sequence < e.sequence GROUP BY ALL
)
SELECT execution_id, call_id, attempt,
       coalesce(arg_max(CASE WHEN event_type = 'ToolStarted' THEN sequence ELSE begun END, sequence) FILTER (event_type = 'ToolStarted' OR before = attempt AND begun IS NOT NULL), 0) AS started_sequence,
       CASE WHEN arg_max(event_type, sequence) = 'ToolStarted' THEN 0 ELSE max(sequence) END AS completed_sequence
FROM found GROUP BY execution_id, call_id, attempt"""


@query(_REPEATED_SQL)
def attempts_repeated_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of the journal without the starts of second attempts and with each outcome twice: the second one takes over the call's start."""
    kept = journal(spark, sf_dir).where("not (event_type = 'ToolStarted' and attempt > 1)")
    twice = kept.withColumn("copy", F.explode(F.when(F.col("event_type").isin(*S.SETTLING_EVENTS), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    events = twice.withColumn("sequence", F.col("sequence") * 2 + F.col("copy")).drop("copy")
    return fold.fold_attempts(events).select("execution_id", "call_id", "attempt", "started_sequence", "completed_sequence")


@query(_STATES_OF + f"SELECT {_STATE_SQL} FROM states")
def execution_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.fold_executions(journal(spark, sf_dir)).select(*_STATE_COLUMNS)


@query(_CALLS_OF + "SELECT execution_id, call_id, tool, status, CASE WHEN status = 'STARTED' THEN started_sequence ELSE requested_sequence END AS sequence, attempt, status = 'STARTED' AS was_started FROM calls WHERE status IN ('REQUESTED', 'STARTED')")
def incomplete_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.incomplete_tools(fold.fold_calls(journal(spark, sf_dir)))


@query(_CALLS_OF + "SELECT execution_id, call_id, tool, pending_attempt AS attempt, pending_failed_attempt AS failed_attempt, pending_delay AS delay, pending_sequence AS sequence FROM calls WHERE pending_sequence IS NOT NULL")
def pending_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.pending_retries(fold.fold_calls(journal(spark, sf_dir)))


_CLASS_SQL = "CASE WHEN status IN ('COMPLETED', 'FAILED', 'CANCELLED', 'RECOVERY_REQUIRED') THEN status WHEN n_pending > 0 THEN 'RETRYABLE' ELSE 'RUNNING' END"


@query(_STATES_OF + f"SELECT execution_id, status, {_CLASS_SQL} AS recovery_class, n_incomplete, n_pending, 0::BIGINT AS n_unresolved_keys FROM states")
def recovery_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.classify(fold.fold_executions(journal(spark, sf_dir)))


@query(_CALLS_OF + "SELECT execution_id, call_id, tool, status, error, CASE WHEN status = 'TIMED_OUT' THEN coalesce(enforced, true) END AS enforced FROM calls WHERE status IN ('FAILED', 'TIMED_OUT', 'CANCELLED')")
def stopped_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.stopped_calls(fold.fold_calls(journal(spark, sf_dir)))


@query(_CALLS_OF + "SELECT execution_id, call_id, tool, completed_sequence AS sequence, false AS ambiguous_effect FROM calls WHERE status = 'TIMED_OUT' AND NOT enforced")
def ambiguous_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.ambiguous_timeouts(fold.fold_calls(journal(spark, sf_dir)))


@query(_CALLS_OF + "SELECT execution_id, call_id, tool, status, result, started_sequence, completed_sequence FROM calls WHERE deduplicated")
def deduplicated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.deduplicated_calls(fold.fold_calls(journal(spark, sf_dir)))


# -- checkpoints -----------------------------------------------------------------------------------------------------


@query(_STATES_OF + "SELECT execution_id, last_sequence AS sequence, CASE WHEN status = 'RECOVERY_REQUIRED' THEN 'RUNNING' ELSE status END AS stored_status, n_calls FROM states")
def checkpoint_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpoints.rows(journal(spark, sf_dir))
    calls = F.json_array_length(F.get_json_object("state", "$.tool_calls"))
    return rows.select("execution_id", "sequence", F.get_json_object("state", "$.status").alias("stored_status"), F.coalesce(calls, F.lit(0)).cast("long").alias("n_calls"))


def _tens(events: DataFrame) -> DataFrame:
    """A checkpoint at each tenth event."""
    return events.where("sequence % 10 = 0").select("execution_id", "sequence", F.concat(F.lit("ckpt_"), "execution_id", F.lit("_"), F.col("sequence").cast("string")).alias("checkpoint_id"))


@query("SELECT execution_id, max(sequence) // 10 * 10 AS sequence, 'ckpt_' || execution_id || '_' || (max(sequence) // 10 * 10) AS checkpoint_id FROM journal GROUP BY execution_id HAVING max(sequence) >= 10")
def checkpoint_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.latest_checkpoints(_tens(journal(spark, sf_dir)))


@query(_STATES_OF + f"SELECT {_STATE_SQL}, last_sequence // 2 AS snapshot_sequence, last_sequence - last_sequence // 2 AS n_replayed FROM states")
def recover_from_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stored_journal(spark, sf_dir)
    snapshot = checkpoints.take(events, staged(_halves(events), "halves"))
    states = checkpoints.recover(events, snapshot).executions.select(*_STATE_COLUMNS)
    return states.join(checkpoints.replayed_counts(events, snapshot), "execution_id")


@query(_CALLS_OF + f"SELECT {_CALL_SQL} FROM calls")
def checkpoint_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call state from a snapshot and a tail: the SQL folds the whole journal."""
    events = _stored_journal(spark, sf_dir)
    return _flat(checkpoints.recover(events, checkpoints.take(events, _halves(events))).calls)


def _json_texts(events: DataFrame) -> DataFrame:
    """Results and errors as JSON texts, as stored journals have them."""
    quoted = F.concat(F.lit('"'), "error", F.lit('"'))
    return events.withColumns({"result": F.col("result").cast("string"), "error": quoted})


@query(_STATES_OF + "SELECT execution_id, last_sequence AS sequence, status AS stored_status, n_calls FROM states WHERE status IN ('COMPLETED', 'FAILED', 'CANCELLED')")
def checkpoint_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal committed in three epochs, the second one twice: checkpoints are stored where executions end, once."""
    events = _stored_journal(spark, sf_dir)
    third = F.expr("(sequence - 1) * 3 div _last")
    cut = staged(events.join(scans.last_sequences(events).withColumnRenamed("last_sequence", "_last"), "execution_id").withColumn("_third", third).drop("_last"), "thirds")
    epochs = CheckpointStore(spark, new_path(spark, "epochs"))
    for k in (0, 1, 1, 2):
        epochs.commit(cut.where(F.col("_third") == k).drop("_third"), k)
    calls = F.json_array_length(F.get_json_object("state", "$.tool_calls"))
    return epochs.checkpoints().select("execution_id", "sequence", F.get_json_object("state", "$.status").alias("stored_status"), F.coalesce(calls, F.lit(0)).cast("long").alias("n_calls"))


@query(_STATES_OF + f"SELECT {_STATE_SQL} FROM states")
def recover_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution state from a snapshot of the first halves and the journal's files that hold later events."""
    events = _stored_journal(spark, sf_dir)
    halves = staged(_halves(events), "halves")
    files = JournalFiles(spark, new_path(spark, "journal-files"))
    early = scans.prefix(events, halves)
    files.append(store.encode(_json_texts(early)))
    snapshot = checkpoints.take(store.decode(store.read_events(spark, files.events_path)))
    files.append(store.encode(_json_texts(scans.tail(events, halves.withColumnRenamed("upto", "after")))))
    return files.recover(snapshot).executions.select(*_STATE_COLUMNS)


@query(", places AS (SELECT execution_id, last * k // 4 AS upto FROM (SELECT execution_id, max(sequence) AS last FROM journal GROUP BY ALL), (SELECT unnest([1, 2, 3, 4]) AS k)), at_places AS (SELECT DISTINCT j.* REPLACE (j.execution_id || '@' || upto AS execution_id), upto FROM journal j JOIN places p ON p.execution_id = j.execution_id AND sequence <= upto)\n"
       + _CALLS.replace("{journal}", "at_places") + _STATES.replace("{journal}", "at_places") + f"SELECT split_part(execution_id, '@', 1) AS execution_id, split_part(execution_id, '@', 2)::BIGINT AS upto, {_STATE_SQL.replace('execution_id, ', '', 1)} FROM states")
def states_at_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution state at each quarter of a journal, from one scan; stored checkpoints at the first fifth stand for what is before."""
    events = _stored_journal(spark, sf_dir)
    last = staged(scans.last_sequences(events), "last")
    wanted = last.select("execution_id", F.explode(F.array(*[F.expr(f"last_sequence * {k} div 4") for k in (1, 2, 3, 4)])).alias("upto"))
    stored = _checkpoint_rows(events, last.select("execution_id", F.expr("last_sequence div 5").alias("upto")))
    return asof.states_at(events, wanted, stored, result="double").executions.select("execution_id", "upto", *[c for c in _STATE_COLUMNS if c != "execution_id"])


_HALF = ", half AS (SELECT * FROM (SELECT *, max(sequence) OVER (PARTITION BY execution_id) AS top FROM journal) WHERE sequence <= top // 2)\n"


@query(_HALF + _CALLS.replace("{journal}", "half") + _STATES.replace("{journal}", "half") + f"SELECT {_STATE_SQL} FROM states")
def state_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stored_journal(spark, sf_dir)
    return checkpoints.state_as_of(events, _halves(events)).executions.select(*_STATE_COLUMNS)


# -- ledger: operations projected from `events` ------------------------------------------------------------------------


def ledger_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operation log: three keys a user; the event's type names the operation."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = F.when(F.col("event_type") == "click", "complete").when(F.col("event_type") == "purchase", "fail").when(F.col("event_type") == "signup", "authorize_retry").otherwise("claim")
    text = lambda c: F.col(c).cast("string")
    return e.select(
        F.concat(F.lit("key_"), text("user_id"), F.lit("_"), (F.col("event_id") % 3).cast("string")).alias("idempotency_key"), F.col("event_id").alias("op_seq"), op.alias("op"),
        F.concat(F.lit("exec_"), text("user_id")).alias("execution_id"), F.concat(F.lit("call_"), text("event_id")).alias("call_id"), F.col("event_type").alias("tool_name"),
        F.concat(F.lit("r"), text("event_id")).alias("result"), F.concat(F.lit("e"), text("event_id")).alias("error"), F.lpad(text("event_id"), 12, "0").alias("ts"),
    )


#: A recursive walk over each key's operations.
_LEDGER = """
WITH RECURSIVE ops AS (
  SELECT 'key_' || user_id || '_' || (event_id % 3) AS idempotency_key, event_id AS op_seq,
    CASE event_type WHEN 'click' THEN 'complete' WHEN 'purchase' THEN 'fail' WHEN 'signup' THEN 'authorize_retry' ELSE 'claim' END AS op,
    'exec_' || user_id AS execution_id, 'call_' || event_id AS call_id, 'r' || event_id AS result, 'e' || event_id AS error, lpad(event_id::VARCHAR, 12, '0') AS ts,
    row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) AS n
  FROM events
), walk AS (
  SELECT idempotency_key, 0::BIGINT AS n, NULL::BIGINT AS op_seq, NULL::VARCHAR AS op, NULL::VARCHAR AS decision, NULL::VARCHAR AS status, 0 AS attempts, 0 AS auth,
    NULL::VARCHAR AS call_id, NULL::VARCHAR AS execution_id, NULL::VARCHAR AS result, NULL::VARCHAR AS error, NULL::VARCHAR AS created_at
  FROM (SELECT DISTINCT idempotency_key FROM ops)
  UNION ALL
  SELECT idempotency_key, n, op_seq, op, decision,
    CASE WHEN decision = 'execute' THEN 'PENDING' WHEN decision = 'ok' AND op = 'complete' THEN 'COMPLETED' WHEN decision = 'ok' AND op = 'fail' THEN 'FAILED' ELSE status END,
    attempts + (decision = 'execute')::INT,
    CASE WHEN decision = 'execute' THEN CASE WHEN status IS NULL THEN 0 ELSE auth - 1 END WHEN decision = 'ok' THEN CASE WHEN op = 'authorize_retry' THEN auth + 1 ELSE 0 END ELSE auth END,
    CASE WHEN decision = 'execute' THEN new_call ELSE call_id END, CASE WHEN decision = 'execute' THEN new_execution ELSE execution_id END,
    CASE WHEN decision = 'ok' AND op = 'complete' THEN new_result WHEN decision = 'ok' AND op = 'fail' THEN NULL ELSE result END,
    CASE WHEN decision = 'execute' OR decision = 'ok' AND op = 'complete' THEN NULL WHEN decision = 'ok' AND op = 'fail' THEN new_error ELSE error END,
    CASE WHEN decision = 'execute' AND status IS NULL THEN ts ELSE created_at END
  FROM (
    SELECT w.*EXCLUDE (n, op_seq, op, decision), o.n, o.op_seq, o.op, o.ts, o.call_id AS new_call, o.execution_id AS new_execution, o.result AS new_result, o.error AS new_error,
      CASE WHEN o.op = 'claim' THEN CASE WHEN w.status IS NULL THEN 'execute' WHEN w.status = 'COMPLETED' THEN 'deduplicated' WHEN w.auth > 0 THEN 'execute' WHEN w.status = 'FAILED' THEN 'refused_failed' ELSE 'refused_pending' END
        WHEN w.status IS NULL THEN 'unknown_key' WHEN w.status = 'COMPLETED' THEN 'refused_completed' ELSE 'ok' END AS decision
    FROM walk w JOIN ops o ON o.idempotency_key = w.idempotency_key AND o.n = w.n + 1)
), records AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY n DESC) AS back FROM walk) WHERE back = 1 AND status IS NOT NULL
)
"""
_RECORD_SQL = "idempotency_key, status, attempts, auth AS retry_authorized, call_id, execution_id, result, error, created_at"
_RECORD_COLUMNS = ("idempotency_key", "status", "attempts", "retry_authorized", "call_id", "execution_id", "result", "error", "created_at")


@raw_query(_LEDGER + f"SELECT {_RECORD_SQL} FROM records")
def ledger_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.records(ledger_ops(spark, sf_dir)).select(*_RECORD_COLUMNS)


@raw_query(_LEDGER + "SELECT w.idempotency_key, w.op_seq, w.op, w.decision, CASE WHEN w.decision = 'deduplicated' THEN w.result END AS result FROM walk w WHERE w.n > 0")
def ledger_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.decisions(ledger_ops(spark, sf_dir))


#: All users of a remainder share a key, and keys are never completed, so that every decision hangs on a long log.
_LONG_LEDGER = _LEDGER.replace("'key_' || user_id || '_' || (event_id % 3)", "'key_' || (user_id % 2)").replace("PARTITION BY user_id, event_id % 3", "PARTITION BY user_id % 2").replace("WHEN 'click' THEN 'complete'", "WHEN 'click' THEN 'authorize_retry'")


def _long_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.regexp_extract("execution_id", "[0-9]+", 0).cast("long")
    op = F.when(F.col("op") == "complete", "authorize_retry").otherwise(F.col("op"))
    return ledger_ops(spark, sf_dir).withColumns({"idempotency_key": F.concat(F.lit("key_"), (user % 2).cast("string")), "op": op})


@raw_query(_LONG_LEDGER + f"SELECT {_RECORD_SQL} FROM records")
def ledger_long_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keys with half of all operations each, their logs cut in stretches."""
    return ledger.records(_long_logs(spark, sf_dir), long_log=400).select(*_RECORD_COLUMNS)


@raw_query(_LONG_LEDGER + "SELECT w.idempotency_key, w.op_seq, w.op, w.decision, CASE WHEN w.decision = 'deduplicated' THEN w.result END AS result FROM walk w WHERE w.n > 0")
def ledger_long_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.decisions(_long_logs(spark, sf_dir), long_log=400)


@raw_query(_LEDGER + f"SELECT {_RECORD_SQL} FROM records WHERE execution_id = 'exec_7' AND status = 'COMPLETED'")
def ledger_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.listed(ledger.records(ledger_ops(spark, sf_dir)), "exec_7", "COMPLETED").select(*_RECORD_COLUMNS)


@raw_query(_LEDGER + f"SELECT {_RECORD_SQL} FROM records WHERE status = 'PENDING' AND auth <= 0")
def ledger_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.unresolved(ledger.records(ledger_ops(spark, sf_dir))).select(*_RECORD_COLUMNS)


@raw_query(_LEDGER.rstrip() + projection.ORACLE.strip().replace("WITH src", ", src", 1) + _STATES_OF + """SELECT s.execution_id, CASE WHEN status = 'RUNNING' AND coalesce(k.n, 0) > 0 THEN 'RECOVERY_REQUIRED' ELSE status END AS status, n_events,
  last_sequence // 10 AS n_checkpoints, coalesce(k.n, 0)::BIGINT AS n_unresolved_keys
  FROM states s LEFT JOIN (SELECT execution_id, count(*) AS n FROM records WHERE status = 'PENDING' AND auth <= 0 GROUP BY ALL) k USING (execution_id)""")
def execution_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stored_journal(spark, sf_dir)
    return recovery.listing(fold.fold_executions(events), _tens(events), ledger.unresolved(ledger.records(ledger_ops(spark, sf_dir))))


# -- policies --------------------------------------------------------------------------------------------------------

_POLICY = "WITH p AS (SELECT event_id, 1 + event_id % 5 AS attempt, 0.1::DOUBLE * (1 + event_id % 3) AS initial_delay, 2.0::DOUBLE AS multiplier, CASE WHEN event_id % 2 = 0 THEN 10.0 ELSE 0.5 END::DOUBLE AS max_delay, 1 + event_id % 4 AS max_attempts, event_id % 2 = 0 AS on_timeout, event_id % 7 = 0 AS on_unknown, ['RETRYABLE', 'PERMANENT', 'UNEXPECTED', 'TIMEOUT', 'CANCELLED'][1 + event_id % 11 % 5] AS kind FROM events)\n"


def _policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    kinds = F.array(*[F.lit(k) for k in ("RETRYABLE", "PERMANENT", "UNEXPECTED", "TIMEOUT", "CANCELLED")])
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (1 + e % 5).alias("attempt"), (F.lit(0.1) * (1 + e % 3)).alias("initial_delay"), F.lit(2.0).alias("multiplier"), F.when(e % 2 == 0, 10.0).otherwise(0.5).alias("max_delay"), (1 + e % 4).alias("max_attempts"), (e % 2 == 0).alias("on_timeout"), (e % 7 == 0).alias("on_unknown"), F.get(kinds, (e % 11 % 5).cast("int")).alias("kind"))


@raw_query(_POLICY + "SELECT event_id, attempt, CASE WHEN initial_delay * multiplier ** (attempt - 1) < max_delay THEN initial_delay * multiplier ** (attempt - 1) ELSE max_delay END AS delay, attempt >= max_attempts AS exhausted FROM p")
def retry_backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policies(spark, sf_dir).select("event_id", "attempt", backoff_delay(F.col("initial_delay"), F.col("multiplier"), F.col("max_delay"), F.col("attempt")).alias("delay"), is_exhausted(F.col("attempt"), F.col("max_attempts")).alias("exhausted"))


@raw_query(_POLICY + "SELECT event_id, kind, attempt < max_attempts AND (kind = 'RETRYABLE' OR kind = 'TIMEOUT' AND on_timeout OR kind = 'UNEXPECTED' AND on_unknown) AS should_retry FROM p")
def retry_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policies(spark, sf_dir).select("event_id", "kind", should_retry(F.col("kind"), F.col("attempt"), F.col("max_attempts"), F.col("on_timeout"), F.col("on_unknown")).alias("should_retry"))


@query("SELECT execution_id, count(*)::BIGINT AS n_retries, round(sum(delay), 6) AS total_delay FROM journal WHERE event_type = 'ToolRetryScheduled' GROUP BY ALL")
def backoff_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    retries = journal(spark, sf_dir).where("event_type = 'ToolRetryScheduled'")
    return retries.groupBy("execution_id").agg(F.count("*").alias("n_retries"), F.round(F.sum("delay"), 6).alias("total_delay"))


@raw_query("SELECT event_id, op, CASE op WHEN 'add' THEN a + b WHEN 'subtract' THEN a - b WHEN 'multiply' THEN a * b WHEN 'divide' THEN CASE WHEN b = 0 THEN NULL ELSE a / b END END AS result, CASE WHEN op = 'divide' AND b = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM (SELECT event_id, ['add', 'subtract', 'multiply', 'divide'][1 + event_id % 4] AS op, value AS a, (event_id % 9)::DOUBLE AS b FROM events)")
def builtin_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(k) for k in ("add", "subtract", "multiply", "divide")])
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get(names, (F.col("event_id") % 4).cast("int")).alias("op"), F.col("value").alias("a"), (F.col("event_id") % 9).cast("double").alias("b"))
    done = e.withColumn("result", arithmetic().result(F.col("op"), F.col("a"), F.col("b")))
    return done.select("event_id", "op", "result", F.when((F.col("op") == "divide") & (F.col("b") == 0), "FAILED").otherwise("COMPLETED").alias("status"))


# -- replay ----------------------------------------------------------------------------------------------------------

#: Candidate calls: the recorded ones with some left out, some of another tool, some of other arguments; users divisible by 11 make one more.
_CANDIDATE = """, recorded AS (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY requested_sequence) - 1 AS index, CAST(substr(call_id, 6) AS BIGINT) AS e FROM calls),
kept AS (SELECT execution_id, requested_sequence, CASE WHEN e % 389 = 3 THEN 'other' ELSE tool END AS tool, CASE WHEN e % 401 = 5 THEN '{}' ELSE arguments END AS arguments FROM recorded WHERE e % 397 <> 7
  UNION ALL SELECT DISTINCT execution_id, 9000000000, 'extra', '{}' FROM recorded WHERE CAST(substr(execution_id, 6) AS BIGINT) % 11 = 0),
candidate AS (SELECT execution_id, row_number() OVER (PARTITION BY execution_id ORDER BY requested_sequence) - 1 AS index, tool, arguments FROM kept),
compared AS (SELECT coalesce(r.execution_id, c.execution_id) AS execution_id, coalesce(r.index, c.index) AS index,
  CASE WHEN r.index IS NULL THEN 'unexpected_tool_call' WHEN c.index IS NULL THEN 'missing_recorded_call' WHEN r.tool <> c.tool THEN 'tool_name' WHEN r.arguments <> c.arguments THEN 'arguments'
    WHEN r.status IN ('REQUESTED', 'STARTED', 'RETRYING') THEN 'missing_recorded_outcome' END AS kind
  FROM recorded r FULL JOIN candidate c ON r.execution_id = c.execution_id AND r.index = c.index)
"""


@query(_CALLS_OF + _CANDIDATE + "SELECT execution_id, index, kind FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY index) AS n FROM compared WHERE kind IS NOT NULL) WHERE n = 1")
def replay_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mismatches(spark, sf_dir).select("execution_id", "index", "kind")


def _mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    recorded = staged(replay.recorded_calls(fold.fold_calls(journal(spark, sf_dir))), "recorded")
    e = F.substring("call_id", 6, 20).cast("long")
    kept = recorded.where(e % 397 != 7).select("execution_id", "requested_sequence", F.when(e % 389 == 3, "other").otherwise(F.col("tool")).alias("tool"), F.when(e % 401 == 5, "{}").otherwise(F.col("arguments")).alias("arguments"), "idempotency_key")
    user = F.substring("execution_id", 6, 20).cast("long")
    extra = recorded.where(user % 11 == 0).select("execution_id").distinct().select("execution_id", F.lit(9_000_000_000).alias("requested_sequence"), F.lit("extra").alias("tool"), F.lit("{}").alias("arguments"), F.lit(None).cast("string").alias("idempotency_key"))
    return replay.first_mismatches(recorded, replay.recorded_calls(kept.unionByName(extra)).drop("requested_sequence"))


@query("SELECT execution_id, true AS matched, count(*)::BIGINT AS events_replayed FROM journal GROUP BY ALL")
def replay_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.matched(_stored_journal(spark, sf_dir))


_STEPS = ", counted AS (SELECT execution_id, call_id, count(*)::BIGINT AS n_attempts, coalesce(sum(retry_delay), 0) AS delay FROM attempts GROUP BY ALL)\n"


@query(_CALLS_OF + _ATTEMPTS + _STEPS + """SELECT c.execution_id, row_number() OVER (PARTITION BY c.execution_id ORDER BY requested_sequence) - 1 AS index, c.call_id, tool, status,
  coalesce(n_attempts, 0) AS n_attempts, coalesce(delay, 0)::DOUBLE AS delay, status = 'COMPLETED' AS succeeded, coalesce(n_attempts, 0) > 1 AS retried FROM calls c LEFT JOIN counted USING (execution_id, call_id)""")
def replay_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stored_journal(spark, sf_dir)
    return replay.steps(fold.fold_calls(events), fold.fold_attempts(events))


@query("""SELECT execution_id, count(*)::BIGINT AS events_replayed, count(*) FILTER (event_type = 'ToolRequested')::BIGINT AS tools_replayed, count(*) FILTER (event_type = 'ToolRetryScheduled')::BIGINT AS retries_replayed,
  (count(*) FILTER (event_type IN ('ToolFailed', 'ToolTimedOut')) - count(*) FILTER (event_type = 'ToolRetryScheduled') + count(*) FILTER (event_type = 'ToolCancelled'))::BIGINT AS errors,
  round(coalesce(sum(delay), 0), 6)::DOUBLE AS delay FROM journal GROUP BY ALL""")
def replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stored_journal(spark, sf_dir)
    return replay.summary(events, fold.fold_calls(events), fold.fold_attempts(events)).withColumn("delay", F.round("delay", 6))


@query(_HALF + _CALLS.replace("{journal}", "half") + """, tops AS (SELECT execution_id, max(sequence) AS last FROM journal GROUP BY ALL),
verdicts AS (SELECT execution_id, last, last // 2 AS start, CASE WHEN EXISTS (SELECT 1 FROM calls c WHERE c.execution_id = t.execution_id AND status IN ('REQUESTED', 'STARTED')) THEN 'open_call'
  WHEN EXISTS (SELECT 1 FROM calls c WHERE c.execution_id = t.execution_id AND pending_sequence IS NOT NULL) THEN 'pending_retry'
  WHEN EXISTS (SELECT 1 FROM (SELECT execution_id, call_id, min(sequence) AS a, max(sequence) AS b FROM journal WHERE call_id IS NOT NULL GROUP BY ALL) s WHERE s.execution_id = t.execution_id AND s.a <= t.last // 2 AND s.b > t.last // 2) THEN 'inside_call' ELSE 'ok' END AS verdict FROM tops t)
SELECT execution_id, start, verdict, CASE WHEN verdict = 'ok' THEN last - start ELSE 0 END AS events_replayed FROM verdicts""")
def replay_from_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stored_journal(spark, sf_dir)
    return replay.starts(events, _halves(events).withColumnRenamed("upto", "start"))


# -- more predicates, rules and codecs -----------------------------------------------------------------------------------


@query("SELECT DISTINCT event_type, event_type IN ('ToolRequested', 'ToolStarted') AS incomplete, event_type IN ('ExecutionCompleted', 'ExecutionFailed', 'ExecutionCancelled') AS terminal, event_type LIKE 'Tool%' AS tool_event FROM journal")
def event_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    return journal(spark, sf_dir).select(e, predicates.is_incomplete_event(e).alias("incomplete"), predicates.is_terminal_event(e).alias("terminal"), predicates.is_tool_event(e).alias("tool_event")).distinct()


@query(_CALLS_OF + """SELECT execution_id, call_id, status IN ('COMPLETED', 'FAILED', 'CANCELLED') AS terminal, status = 'COMPLETED' AS succeeded, status = 'FAILED' AS failed, status = 'TIMED_OUT' AS timed_out,
  status = 'CANCELLED' AS cancelled, coalesce(status = 'TIMED_OUT' AND NOT coalesce(enforced, true), false) AS ambiguous FROM calls""")
def outcome_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, status = fold.fold_calls(journal(spark, sf_dir)), F.col("status")
    flags = predicates.outcome_flags(status, F.col("enforced"))
    return calls.select("execution_id", "call_id", predicates.is_terminal_status(status).alias("terminal"), *[v.alias(k) for k, v in flags.items()])


@query(_CALLS_OF + _ATTEMPTS + """SELECT c.execution_id, c.call_id, count(a.attempt)::BIGINT AS attempt_count, max(a.status) FILTER (a.attempt = 2) AS second_status, coalesce(bool_or(a.status <> 'STARTED' AND a.attempt = 2), false) AS can_attempt_second
  FROM calls c LEFT JOIN attempts a USING (execution_id, call_id) GROUP BY ALL""")
def attempt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stored_journal(spark, sf_dir)
    calls, attempts = fold.fold_calls(events), fold.fold_attempts(events)
    listed = fold.with_attempts(calls, attempts).select("execution_id", "call_id", F.size("attempts").cast("long").alias("attempt_count"), predicates.attempt_record(F.col("attempts"), 2)["status"].alias("second_status"))
    second = replay.can_attempt(attempts, calls.select("execution_id", "call_id", F.lit(2).alias("attempt"))).select("execution_id", "call_id", F.col("can_attempt").alias("can_attempt_second"))
    return listed.join(second, ["execution_id", "call_id"])


@query(_ATTEMPTS + "SELECT execution_id, call_id, attempt AS failed_attempt, attempt + 1 AS attempt, retry_delay AS delay FROM attempts WHERE retry_sequence IS NOT NULL")
def recorded_retry_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.retry_decisions(fold.fold_attempts(journal(spark, sf_dir)))


#: Event ids and types made wrong by rule.
_WRONG = ", wrong AS (SELECT *, 'evt_' || execution_id || '_' || (sequence - CASE WHEN sequence % 13 = 0 THEN 1 ELSE 0 END) AS event_id, CASE WHEN sequence % 17 = 0 THEN 'Tool' ELSE event_type END AS kind FROM journal)\n"


def _wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sequence")
    return journal(spark, sf_dir).withColumns({"event_id": F.concat(F.lit("evt_"), "execution_id", F.lit("_"), (s - F.when(s % 13 == 0, 1).otherwise(0)).cast("string")), "event_type": F.when(s % 17 == 0, "Tool").otherwise(F.col("event_type"))})


@query(_WRONG + "SELECT event_id, count(*)::BIGINT AS n FROM wrong GROUP BY event_id HAVING count(*) > 1")
def event_id_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.duplicate_event_ids(_wrong(spark, sf_dir))


@query(_WRONG + "SELECT execution_id, sequence, kind AS event_type FROM wrong WHERE kind NOT LIKE 'Execution%' AND kind NOT IN ('ToolRequested', 'ToolStarted', 'ToolCompleted', 'ToolFailed', 'ToolRetryScheduled', 'ToolTimedOut', 'ToolCancelled')")
def event_type_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.unknown_event_types(_wrong(spark, sf_dir)).select("execution_id", "sequence", "event_type")


#: The journal with two events more behind the end of every ended execution.
_LATE = """, late AS (SELECT execution_id, sequence, event_type, call_id FROM journal UNION ALL
  SELECT execution_id, max(sequence) + 1, 'ToolRequested', 'late' FROM journal GROUP BY execution_id HAVING bool_or(event_type IN ('ExecutionFailed', 'ExecutionCancelled'))
  UNION ALL SELECT execution_id, max(sequence) + 2, 'ToolCancelled', 'late' FROM journal GROUP BY execution_id HAVING bool_or(event_type IN ('ExecutionFailed', 'ExecutionCancelled'))),
spans AS (SELECT q.execution_id, e.sequence AS opened, coalesce((SELECT min(x.sequence) FROM late x WHERE x.execution_id = q.execution_id AND x.call_id = q.call_id AND x.sequence > e.sequence AND x.event_type NOT IN ('ToolRequested', 'ToolStarted')), 9000000000) AS closed
  FROM late q JOIN late e ON e.execution_id = q.execution_id AND e.call_id = q.call_id AND e.event_type IN ('ToolRequested', 'ToolStarted') WHERE q.event_type = 'ToolRequested'),
merged AS (SELECT execution_id, closed, min(opened) AS opened FROM spans GROUP BY ALL)
"""


@query(_LATE + """SELECT l.execution_id, l.sequence, l.event_type, 'after the end' AS reason FROM late l WHERE EXISTS (SELECT 1 FROM late t WHERE t.execution_id = l.execution_id AND t.event_type IN ('ExecutionCompleted', 'ExecutionFailed', 'ExecutionCancelled') AND t.sequence < l.sequence)
UNION ALL SELECT l.execution_id, l.sequence, l.event_type, 'a call is open' FROM late l WHERE l.event_type IN ('ToolRequested', 'ExecutionCompleted') AND EXISTS (SELECT 1 FROM merged m WHERE m.execution_id = l.execution_id AND m.opened < l.sequence AND m.closed > l.sequence)""")
def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stored_journal(spark, sf_dir).select("execution_id", "sequence", "event_type", "call_id")
    ended = events.groupBy("execution_id").agg(F.max("sequence").alias("last"), F.max(F.col("event_type").isin("ExecutionFailed", "ExecutionCancelled")).alias("stopped")).where("stopped")
    more = ended.select("execution_id", F.explode(F.expr("array(struct(last + 1 as sequence, 'ToolRequested' as event_type), struct(last + 2 as sequence, 'ToolCancelled' as event_type))")).alias("m"))
    return validation.illegal_transitions(events.unionByName(more.select("execution_id", "m.*", F.lit("late").alias("call_id"))))


@query("SELECT execution_id, call_id, 2::BIGINT AS n FROM journal WHERE event_type = 'ToolCancelled' AND sequence % 2 = 0")
def repeated_cancellations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = journal(spark, sf_dir)
    return validation.repeated_cancellations(events.unionByName(events.where("event_type = 'ToolCancelled' and sequence % 2 = 0")))


#: A batch to append behind each execution: the second row of some leaves a gap, of others it repeats.
_BATCH = ", tops AS (SELECT execution_id, max(sequence) AS last, CAST(substr(execution_id, 6) AS BIGINT) AS u FROM journal GROUP BY ALL)\n"


@query(_BATCH + "SELECT execution_id, last + CASE u % 3 WHEN 0 THEN 3 ELSE 0 END AS sequence, CASE u % 3 WHEN 0 THEN 'gap' ELSE 'duplicate sequence' END AS reason FROM tops WHERE u % 3 < 2")
def append_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = scans.last_sequences(journal(spark, sf_dir))
    u = F.substring("execution_id", 6, 20).cast("long")
    second = F.when(u % 3 == 0, 3).when(u % 3 == 1, 0).otherwise(2)
    batch = last.select("execution_id", F.explode(F.array((F.col("last_sequence") + 1), (F.col("last_sequence") + second))).alias("sequence"))
    found = store.rejected_appends(batch.where(F.lit(True)), last)
    return found.where((u % 3 != 1) | (F.col("reason") == "duplicate sequence")).select("execution_id", "sequence", "reason")


@query(_BATCH + "SELECT execution_id, last + n AS sequence, 'evt_' || n AS event_id FROM tops, range(1, 4) r(n)")
def append_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = scans.last_sequences(journal(spark, sf_dir))
    new = last.select("execution_id", F.explode(F.array(*[F.struct(F.lit(f"evt_{n}").alias("event_id"), F.lit(str(n)).alias("timestamp")) for n in (3, 1, 2)])).alias("e")).select("execution_id", "e.*")
    return store.numbered(new, last).select("execution_id", "sequence", "event_id")


@query("SELECT execution_id, sequence, event_type, call_id, tool, arguments, attempt, result, error, failed_attempt, delay, enforced FROM journal")
def event_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events encoded to JSON payloads and decoded again."""
    events = journal(spark, sf_dir)
    stored = store.encode(events.withColumns({"error": F.get_json_object(F.to_json(F.struct(F.struct(F.col("error").alias("message")).alias("e"))), "$.e"), "result": F.col("result").cast("string")}))
    read = store.decode(stored.withColumn("timestamp", F.lit(None).cast("string")))
    return read.select("execution_id", "sequence", "event_type", "call_id", "tool", "arguments", "attempt", F.col("result").cast("double").alias("result"), F.get_json_object("error", "$.message").alias("error"), "failed_attempt", "delay", "enforced")


@query("SELECT execution_id FROM (SELECT DISTINCT execution_id FROM journal) WHERE CAST(substr(execution_id, 6) AS BIGINT) % 2 = 0")
def executions_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = journal(spark, sf_dir)
    wanted = events.select((F.substring("execution_id", 6, 20).cast("long") * 2).alias("u")).distinct().select(F.concat(F.lit("exec_"), F.col("u").cast("string")).alias("execution_id"))
    return scans.existing(wanted, events)


# -- checkpoint rows -----------------------------------------------------------------------------------------------------


def _checkpoint_rows(events: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    part = events if limits is None else scans.prefix(events, limits)
    return staged(checkpoints.rows(part), "checkpoints")


@query(_STATES_OF + f"SELECT {_STATE_SQL} FROM states")
def checkpoint_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution state from stored JSON checkpoints at half of each journal and the events after them."""
    events = _stored_journal(spark, sf_dir)
    snapshot = checkpoints.from_rows(_checkpoint_rows(events, _halves(events)), result="double")
    return checkpoints.recover(events, snapshot).executions.select(*_STATE_COLUMNS)


@query(_CALLS_OF + f"SELECT {_CALL_SQL} FROM calls")
def checkpoint_decode_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stored_journal(spark, sf_dir)
    snapshot = checkpoints.from_rows(_checkpoint_rows(events, _halves(events)), result="double")
    return _flat(checkpoints.recover(events, snapshot).calls)


def _candidates(rows: DataFrame) -> DataFrame:
    """Checkpoint rows made wrong by rule: at another sequence than stated, ahead, or unreadable."""
    u, sequence = F.substring("execution_id", 6, 20).cast("long") % 7, F.col("sequence")
    moved = F.when(u == 1, sequence + 5).otherwise(sequence)
    saying = lambda at: F.regexp_replace("state", F.lit('"last_sequence":[0-9]+'), F.concat(F.lit('"last_sequence":'), at.cast("string")))
    state = F.when(u == 4, "{").when(u == 1, saying(moved)).when(u == 3, saying(sequence + 1)).otherwise(F.col("state"))
    return rows.select("execution_id", moved.alias("sequence"), state.alias("state"))


def _all_but_the_last(events: DataFrame) -> DataFrame:
    return events.groupBy("execution_id").agg((F.max("sequence") - 1).alias("upto"))


@query(_BATCH + """SELECT execution_id, last + CASE u % 7 WHEN 1 THEN 5 WHEN 2 THEN -1 ELSE 0 END AS sequence,
  ['store', 'ahead of journal', 'behind journal', 'state is at another sequence', 'unreadable state', 'already stored', 'another state is stored'][1 + u % 7] AS verdict FROM tops""")
def checkpoint_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stored_journal(spark, sf_dir)
    rows = _checkpoint_rows(events)
    u = F.substring("execution_id", 6, 20).cast("long") % 7
    stored = rows.where(u.isin(5, 6)).withColumn("state", F.when(u == 6, F.concat(F.lit('{"goal":"another",'), F.substring("state", 2, 1 << 30))).otherwise(F.col("state")))
    before = _checkpoint_rows(events.where(u == 2), staged(_all_but_the_last(events), "limits"))
    candidates = _candidates(rows.where(u != 2)).unionByName(before)
    return checkpoints.guarded(candidates, stored, events).select("execution_id", "sequence", "verdict")


@query(_BATCH + """SELECT execution_id, last + CASE u % 7 WHEN 1 THEN 5 ELSE 0 END AS sequence, [NULL, 'ahead of journal', NULL, 'state is at another sequence', 'unreadable state'][1 + u % 7] AS reason FROM tops WHERE u % 7 IN (1, 3, 4)""")
def checkpoint_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stored_journal(spark, sf_dir)
    return checkpoints.corrupt(_candidates(_checkpoint_rows(events)), events)


@query(_BATCH + "SELECT execution_id, sequence - 3 AS sequence, (CASE WHEN sequence = 1 THEN 1 ELSE sequence - 3 END)::BIGINT AS expected FROM journal WHERE sequence <= 4 AND CAST(substr(execution_id, 6) AS BIGINT) % 2 = 0 AND sequence - 3 < 1")
def sequences_below_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journals that begin three sequences too low: what is below 1 is reported, with the sequence that was due."""
    even = F.substring("execution_id", 6, 20).cast("long") % 2 == 0
    low = journal(spark, sf_dir).where(even).withColumn("sequence", F.col("sequence") - 3)
    return validation.sequence_gaps(low).where("sequence < 1").select("execution_id", "sequence", "expected")


@query(_BATCH + "SELECT execution_id, last - 1 AS sequence, 'no such event' AS reason FROM tops WHERE u % 3 = 1")
def checkpoint_of_no_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints before the last event, where every third journal has lost the event that it was taken at."""
    events = _stored_journal(spark, sf_dir)
    limits = staged(_all_but_the_last(events), "limits")
    stored = _checkpoint_rows(events, limits)
    u = F.substring("execution_id", 6, 20).cast("long")
    lost = events.join(limits, "execution_id").where((u % 3 != 1) | (F.col("sequence") != F.col("upto"))).drop("upto")
    return validation.checkpoint_violations(stored, lost)


@query(_BATCH + """SELECT execution_id, CASE u % 3 WHEN 0 THEN 5 WHEN 1 THEN 9 ELSE last + 1 END AS sequence, ['missing', 'differs', 'added'][1 + u % 3] AS kind FROM tops
WHERE u % 3 = 0 AND last >= 5 OR u % 3 = 1 AND last >= 9 OR u % 9 = 2""")
def history_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where another copy of the journal parts from it, found by hash trees: events lost, changed and added, and equal histories."""
    events = _stored_journal(spark, sf_dir)
    u, sequence = F.substring("execution_id", 6, 20).cast("long"), F.col("sequence")
    kept = events.where((u % 3 != 0) | (sequence != 5)).withColumn("delay", F.when((u % 3 == 1) & (sequence == 9), 99.0).otherwise(F.col("delay")))
    more = scans.last_sequences(events).where(u % 9 == 2).select("execution_id", (F.col("last_sequence") + 1).alias("sequence"), F.lit("ExecutionStarted").alias("event_type"), F.lit(False).alias("deduplicated"))
    return histories.compare(events, staged(kept.unionByName(more, allowMissingColumns=True), "copy"), leaf=16, fan=4)


@query(_CALLS_OF + """, told AS (SELECT execution_id, row_number() OVER (PARTITION BY execution_id ORDER BY requested_sequence) - 1 AS index, CAST(substr(call_id, 6) AS BIGINT) AS e, status FROM calls)
SELECT execution_id, min(index) AS index FROM told WHERE status NOT IN ('REQUESTED', 'STARTED', 'RETRYING') AND e % 50 = 49 GROUP BY ALL""")
def replay_equal_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that write their arguments in another way match, up to the first whose argument is another value: 1 and 1.0, true and 1 are equal."""
    recorded = replay.recorded_calls(fold.fold_calls(journal(spark, sf_dir)))
    e = F.substring("call_id", 6, 20).cast("long")
    said = lambda last: F.concat(F.lit('{"b": [true, 1, "true", -0.5], "e": '), e.cast("string"), last)
    again = F.concat(F.lit('{"e": '), F.when(e % 50 == 49, e + 1).otherwise(e).cast("string"), F.lit('.0, "b": [1.0, true, "true", -5e-1], "c": 0}'))
    recorded = staged(recorded.withColumn("arguments", said(F.lit(', "c": false}'))), "recorded")
    candidate = recorded.select("execution_id", "index", "tool", again.alias("arguments"), "idempotency_key")
    found = replay.first_mismatches(recorded.where("status not in ('REQUESTED', 'STARTED', 'RETRYING')"), candidate.join(recorded.where("status not in ('REQUESTED', 'STARTED', 'RETRYING')").select("execution_id", "index"), ["execution_id", "index"], "left_semi"))
    return found.where("kind = 'arguments'").select("execution_id", "index")


#: Ways to damage a state's text, and the fault that each is.
_DAMAGES = (
    ('"status":"[A-Z]+"', '"status":"NONSENSE"', "unknown status"),
    ('"tool_calls":.*,"last_sequence"', '"tool_calls":"gone","last_sequence"', "calls are no list"),
    ('"call_id":', '"called":', "call without its name"),
    ('"requested_sequence":', '"requested_sequence":9', "call outside of its history"),
    ('^.*"last_sequence":([0-9]+).*$', '{"last_sequence":$1}', "state without an execution"),
    ('"execution_id":"', '"execution_id":"un', "state of another execution"),
    ('"last_sequence":[0-9]+', '"last_sequence":"none"', "state without a last sequence"),
    ('"attempt":[0-9]+,"status":"', '"attempt":0,"status":"', "damaged attempt"),
)


@query(_BATCH + f"""SELECT execution_id, last AS sequence, {[f for *_, f in _DAMAGES]}[1 + u % {len(_DAMAGES)}] AS reason FROM tops WHERE u % 3 <> 0""")
def checkpoint_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three stored states damaged, each in one of the ways above: all of them are refused, the others read on."""
    events = _stored_journal(spark, sf_dir)
    rows = _checkpoint_rows(events)
    u, state = F.substring("execution_id", 6, 20).cast("long"), F.col("state")
    for k, (what, to, _) in enumerate(_DAMAGES):
        state = F.when((u % len(_DAMAGES) == k) & (u % 3 != 0), F.regexp_replace("state", F.lit(what), F.lit(to))).otherwise(state)
    _, refused = validation.sorted_out(rows.withColumn("state", state), events)
    return refused.select("execution_id", "sequence", "reason")


@query(_STATES_OF + """SELECT execution_id, CASE WHEN n_incomplete > 0 THEN 'RECOVERY_REQUIRED' ELSE 'RUNNING' END AS status, last_sequence + 1 AS last_sequence, 'r' || last_sequence AS result, n_calls FROM states WHERE status = 'COMPLETED'""")
def checkpoint_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed executions with a result, checkpointed, then started again: the result is still theirs."""
    events = journal(spark, sf_dir).withColumn("result", F.when(F.col("event_type") == "ExecutionCompleted", F.concat(F.lit("r"), F.col("sequence").cast("string"))))
    ended = staged(events.join(events.where("event_type = 'ExecutionCompleted'").select("execution_id"), "execution_id", "left_semi"), "ended")
    again = scans.last_sequences(ended).select("execution_id", (F.col("last_sequence") + 1).alias("sequence"), F.lit("ExecutionStarted").alias("event_type"), F.lit(False).alias("deduplicated"))
    whole = ended.unionByName(again, allowMissingColumns=True)
    states = checkpoints.recover(whole, checkpoints.from_rows(_checkpoint_rows(ended)))
    return states.executions.select("execution_id", "status", "last_sequence", "result", "n_calls")


@query("SELECT execution_id, sequence FROM journal WHERE event_type IN ('ExecutionCompleted', 'ExecutionFailed', 'ExecutionCancelled')")
def checkpoint_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoints.boundaries(journal(spark, sf_dir))


@query("SELECT execution_id, (max(sequence) // 10)::BIGINT AS n_checkpoints FROM journal GROUP BY execution_id HAVING max(sequence) >= 10")
def checkpoint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.checkpoint_counts(_tens(journal(spark, sf_dir)))


@query("SELECT execution_id, 20::BIGINT AS sequence, 'ckpt_' || execution_id || '_20' AS checkpoint_id FROM journal WHERE execution_id = 'exec_3' AND sequence = 20")
def checkpoint_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.checkpoint_at(_tens(journal(spark, sf_dir)), "exec_3", 20)


@query("SELECT execution_id, sequence, 'ckpt_' || execution_id || '_' || sequence AS checkpoint_id FROM journal WHERE execution_id = 'exec_3' AND sequence % 10 = 0")
def checkpoint_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.checkpoints_of(_tens(journal(spark, sf_dir)), "exec_3")


@query("SELECT execution_id, bool_or(sequence % 10 = 0) AS has_checkpoints FROM journal GROUP BY ALL")
def checkpoint_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All executions, and whether they are among those that have checkpoints."""
    events = _stored_journal(spark, sf_dir)
    having = scans.checkpointed_ids(_tens(events)).withColumn("has", F.lit(True))
    return scans.execution_ids(events).join(having, "execution_id", "left").select("execution_id", F.coalesce("has", F.lit(False)).alias("has_checkpoints"))


@query(", kept AS (SELECT * FROM journal WHERE NOT (CAST(substr(execution_id, 6) AS BIGINT) % 4 = 1 AND sequence = 2)) SELECT execution_id, count(*)::BIGINT AS before, count(k.sequence)::BIGINT AS after FROM journal j LEFT JOIN kept k USING (execution_id, sequence) GROUP BY ALL HAVING count(*) <> count(k.sequence)")
def replay_journal_mutated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journals that lost an event while they were replayed."""
    events = _stored_journal(spark, sf_dir)
    u = F.substring("execution_id", 6, 20).cast("long")
    return replay.journal_mutated(scans.event_counts(events), events.where((u % 4 != 1) | (F.col("sequence") != 2)))


# -- recovery ------------------------------------------------------------------------------------------------------------


@query(_STATES_OF + "SELECT execution_id, n_incomplete > 0 AS needs_resolution, false AS needs_key_resolution, n_pending > 0 AS has_pending_retries, last_sequence - last_sequence // 2 AS events_replayed FROM states")
def recovery_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stored_journal(spark, sf_dir)
    snapshot = checkpoints.take(events, staged(_halves(events), "halves"))
    return recovery.flags(recovery.classify(checkpoints.recover(events, snapshot).executions), checkpoints.replayed_counts(events, snapshot))


@query(_STATES_OF + """, opens AS (SELECT execution_id, string_agg(chr(10) || '  ' || call_id || ' ' || tool || ' ' || CASE WHEN status = 'STARTED' THEN 'started at ' || started_sequence ELSE 'requested at ' || requested_sequence END, '' ORDER BY CASE WHEN status = 'STARTED' THEN started_sequence ELSE requested_sequence END) AS t FROM calls WHERE status IN ('REQUESTED', 'STARTED') GROUP BY ALL),
waits_text AS (SELECT execution_id, string_agg(chr(10) || '  ' || call_id || ' ' || tool || ' attempt ' || pending_attempt || ' after ' || pending_delay || 's', '' ORDER BY pending_sequence) AS t FROM calls WHERE pending_sequence IS NOT NULL GROUP BY ALL)
SELECT s.execution_id, 'Execution: ' || s.execution_id || chr(10) || 'Status: ' || s.status || chr(10) || 'Last event: ' || last_sequence || coalesce(chr(10) || 'Open calls:' || o.t, '') || coalesce(chr(10) || 'Scheduled retries:' || w.t, '') AS report
FROM states s LEFT JOIN opens o ON o.execution_id = s.execution_id LEFT JOIN waits_text w ON w.execution_id = s.execution_id""")
def recovery_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stored_journal(spark, sf_dir)
    calls = fold.fold_calls(events)
    return reports.recovery_report(fold.finish_executions(fold.partial_executions(events), calls), calls)


@query(_CALLS_OF + """SELECT c.execution_id, t.last + row_number() OVER (PARTITION BY c.execution_id ORDER BY c.call_id) AS sequence, CASE e % 3 WHEN 0 THEN 'ToolCompleted' WHEN 1 THEN 'ToolFailed' ELSE 'ToolCancelled' END AS event_type, c.call_id, greatest(attempt, 1) AS attempt,
  CASE e % 3 WHEN 0 THEN 'mark_completed' WHEN 1 THEN 'mark_failed' ELSE 'cancel' END AS resolution FROM (SELECT *, CAST(substr(call_id, 6) AS BIGINT) AS e FROM calls WHERE status IN ('REQUESTED', 'STARTED')) c JOIN (SELECT execution_id, max(sequence) AS last FROM journal GROUP BY ALL) t USING (execution_id)""")
def call_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that settle every open call; calls that are not open get none."""
    events = _stored_journal(spark, sf_dir)
    calls = fold.fold_calls(events)
    e = F.substring("call_id", 6, 20).cast("long") % 3
    decisions = calls.select("execution_id", "call_id", F.when(e == 0, "mark_completed").when(e == 1, "mark_failed").otherwise("cancel").alias("action"), F.lit(1.0).alias("result"), F.lit("gone").alias("error"))
    return recovery.resolutions(decisions, calls, fold.finish_executions(fold.partial_executions(events), calls)).select("execution_id", "sequence", "event_type", "call_id", "attempt", "resolution")


@query(_CALLS_OF + "SELECT execution_id, call_id, tool, started_sequence FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY requested_sequence) AS n FROM calls WHERE status = 'STARTED') WHERE n = 1")
def open_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.open_calls(fold.fold_calls(journal(spark, sf_dir)))


@query(_CALLS_OF + "SELECT c.execution_id, c.call_id, pending_attempt AS attempt, q.timeout FROM calls c JOIN journal q ON q.execution_id = c.execution_id AND q.call_id = c.call_id AND q.event_type = 'ToolRequested' WHERE pending_sequence IS NOT NULL")
def retry_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduled retries with the deadline that their call was requested with."""
    calls = fold.fold_calls(journal(spark, sf_dir))
    return recovery.pending_retries(calls).join(calls.select("execution_id", "call_id", "timeout"), ["execution_id", "call_id"]).select("execution_id", "call_id", "attempt", "timeout")


# -- ledger: scope, lookups, unreadable records ----------------------------------------------------------------------------


def _scoped(sql: str) -> str:
    """The walk over operations of which each fifth is asked for by another execution."""
    out = sql.replace("'exec_' || user_id AS execution_id,", "'exec_' || user_id AS execution_id, CASE WHEN event_id % 5 = 0 THEN 'exec_' || (user_id + event_id % 2) END AS asked,")
    out = out.replace("o.execution_id AS new_execution,", "o.execution_id AS new_execution, o.asked,")
    return out.replace("WHEN w.status IS NULL THEN 'unknown_key' WHEN", "WHEN w.status IS NULL THEN 'unknown_key' WHEN o.asked <> w.execution_id THEN 'foreign_execution' WHEN")


def _scoped_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("op_seq")
    user = F.substring("execution_id", 6, 20).cast("long")
    return ledger_ops(spark, sf_dir).withColumn("by_execution", F.when(e % 5 == 0, F.concat(F.lit("exec_"), (user + e % 2).cast("string"))))


@raw_query(_scoped(_LEDGER) + "SELECT w.idempotency_key, w.op_seq, w.op, w.decision FROM walk w WHERE w.n > 0")
def ledger_scoped_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.decisions(_scoped_ops(spark, sf_dir)).drop("result")


@raw_query(_LEDGER + "SELECT execution_id, status, count(*)::BIGINT AS n FROM records GROUP BY ALL")
def ledger_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.counts(ledger.records(ledger_ops(spark, sf_dir)))


@raw_query(_LEDGER + f"SELECT {_RECORD_SQL} FROM records WHERE idempotency_key = 'key_7_1'")
def ledger_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.record_of(ledger.records(ledger_ops(spark, sf_dir)), "key_7_1").select(*_RECORD_COLUMNS)


@raw_query(_LEDGER + f"SELECT {_RECORD_SQL} FROM records WHERE status = 'PENDING'")
def ledger_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.pending(ledger.records(ledger_ops(spark, sf_dir))).select(*_RECORD_COLUMNS)


@raw_query("SELECT 'key_' || user_id || '_' || (event_id % 3) AS idempotency_key, event_id AS op_seq, unnest(CASE WHEN event_id % 3 = 0 THEN ['result', 'error'] ELSE ['error'] END) AS \"column\" FROM events WHERE event_id % 10 = 0")
def ledger_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("op_seq")
    broken = lambda wrong: F.when(wrong, "{").otherwise(F.lit('{"a": 1}'))
    return validation.unreadable_ops(ledger_ops(spark, sf_dir).withColumns({"result": broken(e % 30 == 0), "error": broken(e % 10 == 0)}))


@raw_query("SELECT 'key_' || user_id || '_' || (event_id % 3) AS idempotency_key, event_id AS op_seq FROM events WHERE event_id % 9 = 0")
def ledger_blank_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = ledger_ops(spark, sf_dir).withColumn("kept", F.col("idempotency_key"))
    return validation.blank_keys(ops.withColumn("idempotency_key", F.when(F.col("op_seq") % 9 != 0, F.col("kept")).when(F.col("op_seq") % 2 == 0, "  "))).select(F.col("kept").alias("idempotency_key"), "op_seq")


@raw_query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"type":"ExecutionError","message":"unspecified failure"}' WHEN 1 THEN '{"type":"ExecutionError","message":"boom ' || event_id || '"}' ELSE '{"message":"x"}' END AS error FROM events""")
def error_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    given = F.when(e % 3 == 1, F.concat(F.lit("boom "), e.cast("string"))).when(e % 3 == 2, '{"message":"x"}')
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", ledger.error_payload(given).alias("error"))


# -- policies: precedence, bounds, kinds -----------------------------------------------------------------------------------


@raw_query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'CANCELLED' WHEN 1 THEN 'TIMEOUT' WHEN 2 THEN 'RETRYABLE' WHEN 3 THEN 'PERMANENT' ELSE 'UNEXPECTED' END AS kind,
  coalesce(CASE WHEN event_id % 2 = 0 THEN value END, CASE WHEN event_id % 3 = 0 THEN 7.5 END)::DOUBLE AS timeout, event_id % 2 = 0 OR event_id % 3 = 0 AS active, event_id % 4 <> 3 AS enforced_by_mode FROM events""")
def timeout_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    names = F.array(*[F.lit(x) for x in (*policy.ERROR_TYPES, "ValueError")])
    call, tool = F.when(e % 2 == 0, F.col("value")), F.when(e % 3 == 0, F.lit(7.5))
    mode = F.when(e % 4 == 3, "UNSUPPORTED").otherwise("ASYNC")
    timeout = policy.effective_timeout(call, tool)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", policy.error_kind(F.get(names, (e % 6).cast("int"))).alias("kind"), timeout.alias("timeout"), policy.is_timeout_active(timeout).alias("active"), policy.can_enforce(mode).alias("enforced_by_mode"))


@raw_query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id % 4 WHEN event_id % 3 = 0 THEN 9 ELSE 1 END::INT AS max_attempts, CASE WHEN event_id % 2 = 0 THEN 0.5 WHEN event_id % 3 = 0 THEN 1.5 ELSE 0.1 END::DOUBLE AS initial_delay,
  NOT (event_id % 4 = 0) AS valid, event_id % 5 <> 0 AND event_id % 5 <> 1 AS valid_timeout FROM events""")
def policy_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    call = F.when(e % 2 == 0, F.concat(F.lit('{"max_attempts":'), (e % 4).cast("string"), F.lit(',"initial_delay":0.5,"multiplier":2.0,"max_delay":10.0}')))
    tool = F.when(e % 3 == 0, '{"max_attempts":9,"initial_delay":1.5,"multiplier":1.0,"max_delay":3.0,"retry_on_timeout":true}')
    found = policy.parse_policy(policy.effective_policy(call, tool))
    timeout = F.when(e % 5 == 0, -1.0).when(e % 5 == 1, float("nan")).when(e % 5 == 2, 3.5)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", found["max_attempts"].alias("max_attempts"), found["initial_delay"].alias("initial_delay"), policy.is_valid_policy(found).alias("valid"), policy.is_valid_timeout(timeout).alias("valid_timeout"))


# -- replay: damaged journals, call ids and attempts, replay from a sequence --------------------------------------------------


@query("SELECT execution_id, NOT (CAST(substr(execution_id, 6) AS BIGINT) % 3 = 0 AND max(sequence) > 5) AS matched, (count(*) - count(*) FILTER (sequence = 5 AND CAST(substr(execution_id, 6) AS BIGINT) % 3 = 0))::BIGINT AS events_replayed FROM journal GROUP BY execution_id")
def replay_matched_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifth event is lost in every third execution."""
    events = _stored_journal(spark, sf_dir)
    return replay.matched(events.where((F.substring("execution_id", 6, 20).cast("long") % 3 != 0) | (F.col("sequence") != 5)))


@query(_CALLS_OF + _CANDIDATE.split("kept AS")[0].rstrip().rstrip(",") + """, compared AS (SELECT *, CASE WHEN e % 97 = 1 THEN 'call_id' WHEN status IN ('REQUESTED', 'STARTED', 'RETRYING') THEN 'missing_recorded_outcome' WHEN e % 89 = 2 THEN 'attempt' END AS kind FROM recorded)
SELECT execution_id, index, kind, CASE kind WHEN 'call_id' THEN call_id WHEN 'attempt' THEN attempt::VARCHAR ELSE status END AS expected, CASE kind WHEN 'call_id' THEN 'other' WHEN 'attempt' THEN (attempt + 1)::VARCHAR END AS received
FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY index) AS n FROM compared WHERE kind IS NOT NULL) WHERE n = 1""")
def replay_binding_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that bind other call ids, or make another number of attempts."""
    recorded = staged(replay.recorded_calls(fold.fold_calls(journal(spark, sf_dir))), "recorded")
    e = F.substring("call_id", 6, 20).cast("long")
    candidate = recorded.select("execution_id", "index", "tool", "arguments", "idempotency_key", F.when(e % 97 == 1, "other").otherwise(F.col("call_id")).alias("call_id"), (F.col("attempt") + F.when(e % 89 == 2, 1).otherwise(0)).alias("attempt"))
    return replay.first_mismatches(recorded, candidate)


@query(_CALLS_OF + _CANDIDATE + """SELECT execution_id, 'Execution: ' || execution_id || chr(10) || 'Call: ' || index || chr(10) || 'Mismatch: ' || kind || coalesce(chr(10) || 'Expected: ' || expected, '') || coalesce(chr(10) || 'Received: ' || received, '') AS report
FROM (SELECT c.*, CASE kind WHEN 'missing_recorded_outcome' THEN r.status WHEN 'arguments' THEN r.arguments WHEN 'unexpected_tool_call' THEN NULL ELSE r.tool END AS expected, CASE kind WHEN 'arguments' THEN d.arguments WHEN 'tool_name' THEN d.tool WHEN 'unexpected_tool_call' THEN d.tool END AS received,
  row_number() OVER (PARTITION BY c.execution_id ORDER BY c.index) AS n FROM compared c LEFT JOIN recorded r ON r.execution_id = c.execution_id AND r.index = c.index LEFT JOIN candidate d ON d.execution_id = c.execution_id AND d.index = c.index WHERE kind IS NOT NULL) WHERE n = 1""")
def replay_mismatch_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.mismatch_report(_mismatches(spark, sf_dir))


@query(_HALF + _CALLS.replace("{journal}", "half") + """, ok AS (SELECT execution_id, CASE WHEN CAST(substr(execution_id, 6) AS BIGINT) % 2 = 0 THEN 1 ELSE max(sequence) // 2 END AS start FROM journal WHERE CAST(substr(execution_id, 6) AS BIGINT) % 2 = 0 OR execution_id NOT IN (SELECT execution_id FROM calls WHERE status IN ('REQUESTED', 'STARTED') OR pending_sequence IS NOT NULL
  UNION SELECT s.execution_id FROM (SELECT execution_id, call_id, min(sequence) AS a, max(sequence) AS b FROM journal WHERE call_id IS NOT NULL GROUP BY ALL) s JOIN (SELECT execution_id, max(sequence) // 2 AS half FROM journal GROUP BY ALL) h ON h.execution_id = s.execution_id AND s.a <= half AND s.b > half) GROUP BY execution_id)
SELECT execution_id, sequence, event_type, call_id, attempt, failed_attempt FROM journal JOIN ok USING (execution_id) WHERE sequence > start""")
def replay_regenerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journals made again from their first event on, or from their middle where they can be replayed from there."""
    events = _stored_journal(spark, sf_dir)
    even = F.substring("execution_id", 6, 20).cast("long") % 2 == 0
    allowed = replay.starts(events, _halves(events).select("execution_id", F.when(even, 1).otherwise(F.col("upto")).alias("start"))).where("verdict = 'ok'")
    return replay.regenerate_from(events, staged(allowed, "starts")).select("execution_id", "sequence", "event_type", "call_id", "attempt", "failed_attempt")


@query(_CALLS_OF + "SELECT execution_id, call_id, CASE WHEN deduplicated THEN 'deduplicated' ELSE 'execute' END AS decision, CASE WHEN deduplicated THEN result END AS result FROM calls WHERE CAST(substr(call_id, 6) AS BIGINT) % 2 = 1")
def replay_guard_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed calls are those of odd events."""
    keyed = F.when(F.substring("call_id", 6, 20).cast("long") % 2 == 1, F.col("call_id"))
    return replay.guard_decisions(fold.fold_calls(journal(spark, sf_dir).withColumn("idempotency_key", keyed)))


# -- goals, results and errors of executions; keyed calls; snapshots ----------------------------------------------------------

#: The journal with what lifecycle events carry, and with keys on a third of the calls.
_TOLD = """, told AS (SELECT * EXCLUDE (result, error), CASE WHEN event_type = 'ExecutionStarted' THEN 'goal of ' || execution_id END AS goal, CASE WHEN event_type IN ('ExecutionCompleted', 'ExecutionCancelled') THEN sequence::DOUBLE ELSE result END AS result,
  CASE WHEN event_type = 'ExecutionFailed' THEN 'failed at ' || sequence ELSE error END AS error, CASE WHEN event_type = 'ToolRequested' AND CAST(substr(call_id, 6) AS BIGINT) % 3 = 0 THEN 'key ' || call_id END AS idempotency_key FROM journal)
"""


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, at = F.col("event_type"), F.col("sequence")
    keyed = (kind == "ToolRequested") & (F.substring("call_id", 6, 20).cast("long") % 3 == 0)
    return journal(spark, sf_dir).withColumns({
        "goal": F.when(kind == "ExecutionStarted", F.concat(F.lit("goal of "), "execution_id")), "idempotency_key": F.when(keyed, F.concat(F.lit("key "), "call_id")),
        "result": F.when(kind.isin("ExecutionCompleted", "ExecutionCancelled"), at.cast("double")).otherwise(F.col("result")), "error": F.when(kind == "ExecutionFailed", F.concat(F.lit("failed at "), at.cast("string"))).otherwise(F.col("error")),
    })


@query(_TOLD + """SELECT execution_id, max(goal) AS goal, arg_max(result, sequence) FILTER (event_type IN ('ExecutionCompleted', 'ExecutionCancelled')) AS result, max(error) FILTER (event_type = 'ExecutionFailed') AS error FROM told GROUP BY execution_id""")
def execution_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.fold_executions(_told(spark, sf_dir)).select("execution_id", "goal", "result", "error")


@query(_TOLD + _CALLS_OF + """SELECT c.execution_id, c.call_id, c.tool, completed_sequence AS sequence, t.idempotency_key IS NOT NULL AS ambiguous_effect FROM calls c JOIN told t ON t.execution_id = c.execution_id AND t.call_id = c.call_id AND t.event_type = 'ToolRequested' WHERE status = 'TIMED_OUT' AND NOT c.enforced""")
def ambiguous_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.ambiguous_timeouts(fold.fold_calls(_told(spark, sf_dir)))


@query(_TOLD + _CALLS_OF + _ATTEMPTS + """SELECT c.execution_id, row_number() OVER (PARTITION BY c.execution_id ORDER BY c.requested_sequence) - 1 AS index, c.call_id, t.idempotency_key, t.timeout, c.deduplicated, (SELECT count(*) FROM attempts a WHERE a.execution_id = c.execution_id AND a.call_id = c.call_id)::BIGINT AS n_attempts
  FROM calls c JOIN told t ON t.execution_id = c.execution_id AND t.call_id = c.call_id AND t.event_type = 'ToolRequested' WHERE c.requested_sequence > 10""")
def replay_recorded_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a replay after the tenth event serves."""
    events = staged(_told(spark, sf_dir), "journal")
    after = scans.last_sequences(events).select("execution_id", F.lit(10).alias("start"))
    found = replay.recorded_with_requests(fold.fold_calls(events), fold.fold_attempts(events), after)
    return found.select("execution_id", "index", "call_id", "idempotency_key", "timeout", "deduplicated", F.size("attempts").cast("long").alias("n_attempts"))


@query(_TOLD + _STATES_OF + """SELECT s.execution_id, s.status, 'goal of ' || s.execution_id AS goal, s.last_sequence, s.last_sequence // 10 * 10 AS latest_checkpoint, s.n_calls, s.n_incomplete, s.n_pending, (SELECT c.call_id FROM calls c WHERE c.execution_id = s.execution_id ORDER BY requested_sequence LIMIT 1) AS first_call FROM states s""")
def execution_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = staged(_told(spark, sf_dir), "journal")
    states = checkpoints.recover(events)
    found = recovery.snapshots(states.executions, states.calls, states.attempts, _tens(events))
    get = lambda path: F.get_json_object("snapshot", f"$.{path}")
    size = lambda path: F.json_array_length(get(path)).cast("long")
    return found.select("execution_id", get("status").alias("status"), get("goal").alias("goal"), get("last_sequence").cast("long").alias("last_sequence"), get("latest_checkpoint").cast("long").alias("latest_checkpoint"), size("tool_calls").alias("n_calls"), size("incomplete_tools").alias("n_incomplete"), size("pending_retries").alias("n_pending"), get("tool_calls[0].call_id").alias("first_call"))


@query(_TOLD + "SELECT execution_id, sequence, CASE WHEN sequence % 3 = 0 THEN 1 WHEN sequence % 3 = 1 THEN greatest(sequence % 4, 1) ELSE 1 END::INT AS attempt FROM told")
def attempt_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("sequence")
    return journal(spark, sf_dir).select("execution_id", "sequence", predicates.attempt_number(F.when(s % 3 == 0, 0).when(s % 3 == 1, (s % 4).cast("int"))).alias("attempt"))


@raw_query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"a":1,"b":[true,null,"é"],"c":' || event_id || '}' WHEN 1 THEN NULL WHEN 2 THEN '[' || event_id || ',{"x":"y"}]' END AS canonical FROM events""")
def canonical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldlight.functions.canonical import canonical_json

    e = F.col("event_id")
    given = F.when(e % 4 == 0, F.concat(F.lit('{ "c": '), e.cast("string"), F.lit(', "b": [true, null, "\\u00e9"],  "a": 1.0}'))).when(e % 4 == 1, "{NaN").when(e % 4 == 2, F.concat(F.lit(" [ "), e.cast("string"), F.lit(' , {"x" : "y"} ]')))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", canonical_json(given).alias("canonical"))


@raw_query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'ASYNC' WHEN event_id % 2 = 0 THEN 'COOPERATIVE' ELSE 'UNSUPPORTED' END AS mode, event_id % 5 = 0 AND event_id % 3 <> 0 AND event_id % 2 <> 0 AS refused,
  '{"max_attempts":' || (1 + event_id % 3) || ',"initial_delay":0.5,"multiplier":2.0,"max_delay":8.0,"retry_on_unknown":' || (event_id % 2 = 0) || ',"retry_on_timeout":false}' AS policy FROM events""")
def policy_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    mode = policy.timeout_mode(e % 3 == 0, e % 2 == 0)
    text = F.concat(F.lit('{"retry_on_unknown":'), (e % 2 == 0).cast("string"), F.lit(', "max_delay":8, "max_attempts":'), (1 + e % 3).cast("string"), F.lit(',"initial_delay":0.5,"multiplier":2}'))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", mode.alias("mode"), policy.is_refused_timeout(F.when(e % 5 == 0, F.lit(1.0)), mode).alias("refused"), policy.policy_json(policy.parse_policy(text)).alias("policy"))
