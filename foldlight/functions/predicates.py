"""Column predicates and domain mappings over events, calls, attempts and ledger records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldlight import schemas as S


def mapped(column: Column, table: dict[str, str]) -> Column:
    """The value for each key; null for others."""
    out = F.lit(None).cast("string")
    for key, value in table.items():
        out = F.when(column == key, value).otherwise(out)
    return out


def is_incomplete_event(event_type: Column) -> Column:
    return event_type.isin(*S.INCOMPLETE_EVENTS)


def is_terminal_event(event_type: Column) -> Column:
    return event_type.isin(*S.TERMINAL_EVENTS)


def is_tool_event(event_type: Column) -> Column:
    return event_type.isin(*S.TOOL_EVENTS)


def is_terminal_status(status: Column) -> Column:
    return status.isin(*S.TERMINAL_STATUSES)


def is_incomplete_status(status: Column) -> Column:
    """Requested or started; a call that waits for a retry is not incomplete."""
    return status.isin(*S.INCOMPLETE_STATUSES)


def is_stop_status(status: Column) -> Column:
    return status.isin(*S.STOP_STATUSES)


def timeout_enforced(status: Column, enforced: Column) -> Column:
    """Null unless timed out; a missing flag means enforced."""
    return F.when(status == "TIMED_OUT", F.coalesce(enforced, F.lit(True)))


def is_ambiguous(status: Column, enforced: Column) -> Column:
    """Timed out, and nothing proves that the tool stopped."""
    return F.coalesce(~timeout_enforced(status, enforced), F.lit(False))


def outcome_flags(status: Column, enforced: Column) -> dict[str, Column]:
    """What came of a call, by name: at most one of the first four holds; ambiguous: the effect may still happen."""
    named = {"succeeded": "COMPLETED", "failed": "FAILED", "timed_out": "TIMED_OUT", "cancelled": "CANCELLED"}
    return {**{k: status == v for k, v in named.items()}, "ambiguous": is_ambiguous(status, enforced)}


def is_settled(status: Column) -> Column:
    return ~is_incomplete_status(status)


def is_unresolved_key(status: Column, retry_authorized: Column) -> Column:
    return (status == "PENDING") & (retry_authorized <= 0)


def attempt_number(attempt: Column) -> Column:
    """At least 1; missing and zero mean 1."""
    return F.greatest(F.coalesce(attempt.cast("int"), F.lit(1)), F.lit(1))


def attempt_record(attempts: Column, number: Column | int) -> Column:
    """The record of that attempt in an array of attempts, or null."""
    return F.get(F.filter(attempts, lambda a: a["attempt"] == number), 0)


def all_of(**wanted: tuple[Column, object]) -> Column:
    """Conjunction of equality filters; those without a value are left out."""
    given = [column == value for column, value in wanted.values() if value is not None]
    return reduce(lambda a, b: a & b, given, F.lit(True))
