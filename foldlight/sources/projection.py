"""A journal from the `events` table: one call per row, one execution per user.

Sequences are sums over calls, not ranks of events: a call's events begin after those of the user's earlier calls, which are
counted by blocks of event ids (operators.blocks), so that no user is sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldlight.operators.blocks import BLOCK

COLUMNS = ("execution_id", "sequence", "event_type", "call_id", "tool", "arguments", "attempt", "result", "error", "failed_attempt", "delay", "timeout", "enforced", "deduplicated")

# Steps of a call, in order: 0 request, 1 start, 2 outcome, 3 retry scheduled, 4 second start (or cancellation), 5 its outcome.
_STEPS = {(0,): (0, 1), (1,): (0,), (9,): (0, 2), (3, 11): (0, 1, 2, 3, 4), (7,): (0, 1, 2, 3, 4, 5), (8,): (0, 1, 2, 3)}
_STARTED, _ENDED = -1, 9
_BLOCK = ("user_id", "_block")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoded journal; sequences are gapless from 1 per execution."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("event_type").alias("tool"), "value", (F.get_json_object("props", "$.k").cast("int") % 14).alias("c"))
    open_users = (F.col("user_id") % 5 == 4) & F.col("c").isin(0, 1, 3)
    src = raw.where(~open_users & ~((F.col("user_id") % 10 == 9) & (F.col("c") == 8))).withColumn("_block", F.expr(f"event_id div {BLOCK}"))
    c = F.col("c")
    steps = F.when(c.isNull(), F.array(F.lit(0)))
    for kinds, of in _STEPS.items():
        steps = steps.when(c.isin(*kinds), F.array(*map(F.lit, of)))
    steps = steps.otherwise(F.array(*map(F.lit, (0, 1, 2))))

    # Where each call begins: events of the user's earlier blocks, and of earlier calls in its block.
    user = Window.partitionBy("user_id")
    earlier = user.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = src.groupBy(*_BLOCK).agg(F.sum(F.size(steps)).alias("n"))
    ahead = sums.select(*_BLOCK, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"), F.sum("n").over(user).alias("total"))
    within = Window.partitionBy(*_BLOCK).orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = src.withColumn("before", F.coalesce(F.sum(F.size(steps)).over(within), F.lit(0))).join(ahead, list(_BLOCK)).withColumn("before", F.col("before") + F.col("ahead"))

    # The first call brings the execution's start, the last one its end.
    first, last = F.col("before") == 0, F.col("before") + F.size(steps) == F.col("total")
    end = F.when(F.col("user_id") % 5 == 1, "ExecutionCompleted").when(F.col("user_id") % 5 == 2, "ExecutionFailed").when(F.col("user_id") % 5 == 3, "ExecutionCancelled")
    none = F.array().cast("array<int>")
    every = F.concat(F.when(first, F.array(F.lit(_STARTED))).otherwise(none), steps, F.when(last & end.isNotNull(), F.array(F.lit(_ENDED))).otherwise(none))
    each = placed.select("user_id", "event_id", "tool", "value", "c", (F.col("before") + F.when(first, 1).otherwise(2)).alias("base"), F.posexplode(every).alias("pos", "k"))

    k = F.col("k")
    of_call, outcome, again, retry = k.between(0, 5), k == 2, k == 4, k == 3
    failed, timed = c.isin(2, 3, 7, 8, 11), c.isin(4, 5)
    ended = F.when(failed, "ToolFailed").when(timed, "ToolTimedOut").when(c == 6, "ToolCancelled").otherwise("ToolCompleted")
    event_type = (
        F.when(k == _STARTED, "ExecutionStarted").when(k == 0, "ToolRequested").when(k == 1, "ToolStarted").when(outcome, ended).when(retry, "ToolRetryScheduled")
        .when(again, F.when(c == 11, "ToolCancelled").otherwise("ToolStarted")).when(k == 5, "ToolCompleted").otherwise(end)
    )
    name = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    values = {
        "execution_id": name("exec_", "user_id"),
        "sequence": (F.col("base") + F.col("pos")).cast("long"),
        "event_type": event_type,
        "call_id": F.when(of_call, name("call_", "event_id")),
        "tool": F.when(of_call, F.col("tool")),
        "arguments": F.when(k == 0, F.concat(name('{"e":', "event_id"), F.lit("}"))),
        "attempt": F.when(k.isin(1, 2), 1).when(retry | (k == 5), 2).when(again, F.when(c == 11, 1).otherwise(2)),
        "result": F.when((outcome & c.isin(9, 10, 12, 13)) | (k == 5), F.col("value")),
        "error": F.when(outcome, F.when(failed, "boom 1").when(timed, "deadline").when(c == 6, "cancelled")).when(retry, "boom 1").when(again & (c == 11), "cancelled"),
        "failed_attempt": F.when(retry, 1),
        "delay": F.when(retry, 0.1),
        "timeout": F.when(k.isin(0, 2) & timed, 5.0),
        "enforced": F.when(outcome & timed, c == 4),
        "deduplicated": F.when(of_call, F.when(k.isin(0, 2), c == 9).otherwise(F.lit(False))).otherwise(F.lit(False)),
    }
    return each.select(*[values[n].alias(n) for n in COLUMNS])


#: The same projection in DuckDB's SQL.
ORACLE = """
WITH src AS (
  SELECT * FROM (SELECT event_id, user_id, event_type AS tool, value, CAST(json_extract_string(props, '$.k') AS INT) % 14 AS c FROM events) raw
  WHERE NOT (user_id % 5 = 4 AND c IN (0, 1, 3)) AND NOT (user_id % 10 = 9 AND c = 8)
), ev AS (
  SELECT user_id, event_id * 10 AS ord, event_id, tool, 'ToolRequested' AS event_type, '{"e":' || event_id || '}' AS arguments, NULL::INT AS attempt, NULL::DOUBLE AS result,
         NULL::VARCHAR AS error, NULL::INT AS failed_attempt, NULL::DOUBLE AS delay, CASE WHEN c IN (4, 5) THEN 5.0::DOUBLE END AS timeout, NULL::BOOLEAN AS enforced, c = 9 AS deduplicated FROM src
  UNION ALL SELECT user_id, event_id * 10 + 1, event_id, tool, 'ToolStarted', NULL, 1, NULL, NULL, NULL, NULL, NULL, NULL, false FROM src WHERE c NOT IN (1, 9)
  UNION ALL SELECT user_id, event_id * 10 + 2, event_id, tool,
         CASE WHEN c IN (2, 3, 7, 8, 11) THEN 'ToolFailed' WHEN c IN (4, 5) THEN 'ToolTimedOut' WHEN c = 6 THEN 'ToolCancelled' ELSE 'ToolCompleted' END, NULL, 1,
         CASE WHEN c IN (9, 10, 12, 13) THEN value END, CASE WHEN c IN (2, 3, 7, 8, 11) THEN 'boom 1' WHEN c IN (4, 5) THEN 'deadline' WHEN c = 6 THEN 'cancelled' END,
         NULL, NULL, CASE WHEN c IN (4, 5) THEN 5.0 END, CASE WHEN c = 4 THEN true WHEN c = 5 THEN false END, c = 9 FROM src WHERE c NOT IN (0, 1)
  UNION ALL SELECT user_id, event_id * 10 + 3, event_id, tool, 'ToolRetryScheduled', NULL, 2, NULL, 'boom 1', 1, 0.1, NULL, NULL, false FROM src WHERE c IN (3, 7, 8, 11)
  UNION ALL SELECT user_id, event_id * 10 + 4, event_id, tool, CASE WHEN c = 11 THEN 'ToolCancelled' ELSE 'ToolStarted' END, NULL, CASE WHEN c = 11 THEN 1 ELSE 2 END, NULL,
         CASE WHEN c = 11 THEN 'cancelled' END, NULL, NULL, NULL, NULL, false FROM src WHERE c IN (3, 7, 11)
  UNION ALL SELECT user_id, event_id * 10 + 5, event_id, tool, 'ToolCompleted', NULL, 2, value, NULL, NULL, NULL, NULL, NULL, false FROM src WHERE c = 7
  UNION ALL SELECT DISTINCT user_id, -1, NULL::BIGINT, NULL, 'ExecutionStarted', NULL, NULL::INT, NULL::DOUBLE, NULL, NULL::INT, NULL::DOUBLE, NULL::DOUBLE, NULL::BOOLEAN, false FROM src
  UNION ALL SELECT DISTINCT user_id, 9000000000, NULL::BIGINT, NULL, CASE user_id % 5 WHEN 1 THEN 'ExecutionCompleted' WHEN 2 THEN 'ExecutionFailed' ELSE 'ExecutionCancelled' END,
         NULL, NULL::INT, NULL::DOUBLE, NULL, NULL::INT, NULL::DOUBLE, NULL::DOUBLE, NULL::BOOLEAN, false FROM src WHERE user_id % 5 IN (1, 2, 3)
), journal AS (
  SELECT 'exec_' || user_id AS execution_id, row_number() OVER (PARTITION BY user_id ORDER BY ord)::BIGINT AS sequence, event_type,
         CASE WHEN event_id IS NOT NULL THEN 'call_' || event_id END AS call_id, tool, arguments, attempt, result, error, failed_attempt, delay, timeout, enforced, deduplicated
  FROM ev
)
"""
