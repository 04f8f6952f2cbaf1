"""States at many sequences of each execution, from one scan of the journal.

The wanted sequences cut an execution in stretches.  Events are folded by call and stretch, the partial folds are merged along
the stretches, and each merged row holds from its stretch on to the next one in which its call has an event.  A stored
checkpoint at or before an execution's first wanted sequence stands for all events up to it, which are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlight.operators import checkpoints, fold
from foldlight.operators.checkpoints import Snapshot, States
from foldlight.staging import staged

#: How the columns of partial folds merge along a window.
_MAX = lambda c, w: F.max(c).over(w)
_CALLS = {**dict.fromkeys(("last", "tried", "settled", "started", "retry"), _MAX), "requests": lambda c, w: F.flatten(F.collect_list(c).over(w))}
_ATTEMPTS = {**dict.fromkeys(("last", "started", "settled", "scheduled"), _MAX), "first_sequence": lambda c, w: F.min(c).over(w)}
_EXECUTIONS = {**dict.fromkeys(("last_sequence", "lifecycle", "begun", "ended", "failed"), _MAX), "n_events": lambda c, w: F.sum(c).over(w)}


def _of_stretch(df: DataFrame) -> DataFrame:
    """Splits the execution's key, under which folds were made by stretch."""
    return df.withColumn("stretch", F.col("execution_id.stretch")).withColumn("execution_id", F.col("execution_id.execution_id"))


def _carried(partials: DataFrame, keys: tuple[str, ...], merges: dict, wanted: DataFrame) -> DataFrame:
    """The merged partials at each wanted sequence, with a key of (execution_id, upto) in place of execution_id."""
    along = Window.partitionBy(*keys).orderBy("stretch")
    merged = [merge(c, along.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c, merge in merges.items()]
    held = partials.select(*keys, "stretch", F.lead("stretch").over(along).alias("until"), *merged)
    at = held.join(wanted, "execution_id").where("upto >= stretch and (until is null or upto < until)")
    return at.withColumn("execution_id", F.struct("execution_id", "upto")).drop("stretch", "until", "upto")


def _nearest(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of each execution, the last stored checkpoint at or before its first wanted sequence."""
    first = wanted.groupBy("execution_id").agg(F.min("upto").alias("first"))
    before = stored.join(first, "execution_id").where("sequence <= first")
    return before.groupBy("execution_id").agg(F.max_by(F.struct("sequence", "state"), "sequence").alias("c")).select("execution_id", "c.sequence", "c.state")


def states_at(events: DataFrame, wanted: DataFrame, stored: DataFrame | None = None, result: str = "string", error: str = "string") -> States:
    """Calls, attempts and executions with a column `upto`: the state after the events up to each wanted sequence.

    wanted: (execution_id, upto), any number an execution; a sequence before the first event has no state.  stored: checkpoint
    rows that validation lets pass; result and error: types of the journal's columns.
    """
    wanted = staged(wanted.select("execution_id", F.col("upto").cast("long").alias("upto")).distinct(), "wanted")
    base: Snapshot | None = checkpoints.from_rows(staged(_nearest(stored, wanted), "nearest"), result, error) if stored is not None else None
    places = wanted.groupBy("execution_id").agg(F.sort_array(F.collect_list("upto")).alias("places"))
    gaps = events.join(places, "execution_id")
    if base is not None:
        gaps = gaps.join(base.at.select("execution_id", F.col("sequence").alias("after")), "execution_id", "left").where("sequence > coalesce(after, 0)").drop("after")
    gaps = fold.carried(gaps, None if base is None else base.calls)
    stretch: Column = F.array_min(F.filter("places", lambda p: p >= F.col("sequence")))
    cut = gaps.where(F.col("sequence") <= F.element_at("places", -1)).withColumn("execution_id", F.struct("execution_id", stretch.alias("stretch"))).drop("places")
    cut = staged(fold.conform(cut), "gaps")
    first = wanted.groupBy("execution_id").agg(F.min("upto").alias("stretch"))

    def partials(of_events: DataFrame, of_base: str) -> DataFrame:
        rows = _of_stretch(of_events)
        return rows if base is None else getattr(base, of_base).join(first, "execution_id").unionByName(rows)

    def told(df: DataFrame) -> DataFrame:
        return df.select(F.col("execution_id.execution_id").alias("execution_id"), F.col("execution_id.upto").alias("upto"), *[c for c in df.columns if c != "execution_id"])

    merged = staged(_carried(partials(fold.partial_calls(cut), "calls"), fold.CALL, _CALLS, wanted), "calls-at")
    # Merged once more, which changes nothing: Catalyst cannot prune the fields of stored structs below the explosion of requests.
    calls = fold.finish_calls(fold.merge_calls(merged))
    attempts = fold.finish_attempts(_carried(partials(fold.partial_attempts(cut), "attempts"), (*fold.CALL, "number"), _ATTEMPTS, wanted))
    executions = fold.finish_executions(_carried(partials(fold.partial_executions(cut), "executions"), ("execution_id",), _EXECUTIONS, wanted), calls)
    return States(told(calls), told(attempts), told(executions))
