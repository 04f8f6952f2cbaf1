"""Closed domains and schemas of journals, checkpoints and ledgers."""

from __future__ import annotations

from pyspark.sql import types as T

# The names that journals use.
EVENT_TYPES = (
    "ExecutionStarted", "ExecutionCompleted", "ExecutionFailed", "ExecutionCancelled",
    "ToolRequested", "ToolStarted", "ToolCompleted", "ToolFailed", "ToolRetryScheduled", "ToolTimedOut", "ToolCancelled",
)
LIFECYCLE_EVENTS = EVENT_TYPES[:4]
TERMINAL_EVENTS = EVENT_TYPES[1:4]
TOOL_EVENTS = EVENT_TYPES[4:]
SETTLING_EVENTS = ("ToolCompleted", "ToolFailed", "ToolTimedOut", "ToolCancelled")
INCOMPLETE_EVENTS = ("ToolRequested", "ToolStarted")
TERMINAL_STATUSES = ("COMPLETED", "FAILED", "CANCELLED")
INCOMPLETE_STATUSES = ("REQUESTED", "STARTED")
STOP_STATUSES = ("FAILED", "TIMED_OUT", "CANCELLED")
CALL_STATUS = {
    "ToolRequested": "REQUESTED", "ToolStarted": "STARTED", "ToolCompleted": "COMPLETED", "ToolFailed": "FAILED",
    "ToolRetryScheduled": "RETRYING", "ToolTimedOut": "TIMED_OUT", "ToolCancelled": "CANCELLED",
}
EXECUTION_STATUS = {"ExecutionStarted": "RUNNING", "ExecutionCompleted": "COMPLETED", "ExecutionFailed": "FAILED", "ExecutionCancelled": "CANCELLED"}
ERROR_KINDS = ("RETRYABLE", "PERMANENT", "UNEXPECTED", "TIMEOUT", "CANCELLED")

EVENTS = T.StructType([
    T.StructField("event_id", T.StringType(), False),
    T.StructField("execution_id", T.StringType(), False),
    T.StructField("sequence", T.LongType(), False),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("payload", T.StringType()),
    T.StructField("timestamp", T.StringType()),
])

#: Payload columns of a decoded journal, by key; a decoded journal may give result and error another type.
PAYLOAD = {
    "call_id": "string", "tool": "string", "arguments": "string", "attempt": "int", "result": "string", "error": "string", "failed_attempt": "int",
    "delay": "double", "reason": "string", "timeout": "double", "timeout_mode": "string", "enforced": "boolean", "idempotency_key": "string",
    "deduplicated": "boolean", "goal": "string", "retry_policy": "string", "resolution": "string",
}

CHECKPOINTS = T.StructType([
    T.StructField("checkpoint_id", T.StringType(), False),
    T.StructField("execution_id", T.StringType(), False),
    T.StructField("sequence", T.LongType(), False),
    T.StructField("state", T.StringType()),
    T.StructField("created_at", T.StringType()),
])

LEDGER_OPS = T.StructType([
    T.StructField("idempotency_key", T.StringType()),
    T.StructField("op_seq", T.LongType()),
    T.StructField("op", T.StringType()),
    T.StructField("execution_id", T.StringType()),
    T.StructField("call_id", T.StringType()),
    T.StructField("tool_name", T.StringType()),
    T.StructField("arguments", T.StringType()),
    T.StructField("result", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("note", T.StringType()),
    T.StructField("ts", T.StringType()),
])

RETRY_POLICY = T.StructType([
    T.StructField("max_attempts", T.IntegerType()),
    T.StructField("initial_delay", T.DoubleType()),
    T.StructField("multiplier", T.DoubleType()),
    T.StructField("max_delay", T.DoubleType()),
    T.StructField("retry_on_unknown", T.BooleanType()),
    T.StructField("retry_on_timeout", T.BooleanType()),
])
