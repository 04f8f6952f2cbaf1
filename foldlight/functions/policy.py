"""Retry and timeout policies as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldlight import schemas as S
from foldlight.functions.predicates import mapped

#: Error type names and the kinds they mean; any other name is unexpected.
ERROR_TYPES = {"ToolCancelledError": "CANCELLED", "ToolTimedOutError": "TIMEOUT", "RetryableToolError": "RETRYABLE", "PermanentToolError": "PERMANENT"}


def backoff_delay(initial: Column, multiplier: Column, most: Column, attempt: Column) -> Column:
    """Seconds to wait after the given (1-based) attempt failed."""
    return F.least(initial * F.pow(multiplier, attempt - 1), most)


def is_exhausted(attempt: Column, max_attempts: Column) -> Column:
    return attempt >= max_attempts


def error_kind(error_type: Column) -> Column:
    """By the recorded type's name; a recorded reason of a scheduled retry is to be preferred."""
    return F.coalesce(mapped(error_type, ERROR_TYPES), F.lit("UNEXPECTED"))


def should_retry(kind: Column, attempt: Column, max_attempts: Column, on_timeout: Column, on_unknown: Column) -> Column:
    return (
        F.when(is_exhausted(attempt, max_attempts), F.lit(False))
        .when(kind.isin("PERMANENT", "CANCELLED"), F.lit(False))
        .when(kind == "TIMEOUT", on_timeout)
        .when(kind == "RETRYABLE", F.lit(True))
        .otherwise(on_unknown)
    )


def parse_policy(text: Column) -> Column:
    """The policy struct of its JSON; null means no retry (one attempt); missing flags are false."""
    p = F.from_json(text, S.RETRY_POLICY)
    flag = lambda c: F.coalesce(c, F.lit(False))
    given = F.struct(p["max_attempts"].alias("max_attempts"), p["initial_delay"].alias("initial_delay"), p["multiplier"].alias("multiplier"), p["max_delay"].alias("max_delay"), flag(p["retry_on_unknown"]).alias("retry_on_unknown"), flag(p["retry_on_timeout"]).alias("retry_on_timeout"))
    none = F.struct(F.lit(1).alias("max_attempts"), F.lit(0.1).alias("initial_delay"), F.lit(2.0).alias("multiplier"), F.lit(10.0).alias("max_delay"), F.lit(False).alias("retry_on_unknown"), F.lit(False).alias("retry_on_timeout"))
    return F.when(text.isNull(), none).otherwise(given)


def policy_json(policy: Column) -> Column:
    """The stored text of a policy struct; parse_policy reads it back."""
    return F.to_json(policy)


def is_valid_policy(policy: Column) -> Column:
    return F.coalesce((policy["max_attempts"] >= 1) & (policy["initial_delay"] >= 0) & (policy["multiplier"] >= 1) & (policy["max_delay"] >= 0), F.lit(False))


def effective_policy(call: Column, tool: Column) -> Column:
    """The call's policy text, else the tool's; null: no retry."""
    return F.coalesce(call, tool)


def effective_timeout(call: Column, tool: Column) -> Column:
    return F.coalesce(call, tool)


def is_valid_timeout(timeout: Column) -> Column:
    """Finite and positive; no timeout is valid."""
    return timeout.isNull() | ((timeout > 0) & ~F.isnan(timeout) & (timeout < float("inf")))


def is_timeout_active(timeout: Column) -> Column:
    return timeout.isNotNull()


def timeout_mode(is_async: Column, takes_token: Column) -> Column:
    """What can stop a tool: its coroutine, a token that it asks, or nothing."""
    return F.when(is_async, "ASYNC").when(takes_token, "COOPERATIVE").otherwise("UNSUPPORTED")


def is_refused_timeout(timeout: Column, mode: Column) -> Column:
    """A deadline that nothing can enforce is refused before a call is requested."""
    return timeout.isNotNull() & ~can_enforce(mode)


def can_enforce(mode: Column) -> Column:
    return mode != "UNSUPPORTED"
