"""Running values along an execution without one sort of the whole execution.

Sequences are cut into blocks of BLOCK.  Each block is summed up by partial aggregation, the few sums of an execution are run
over in order, and rows are sorted within their block only: a journal of any length spreads over as many tasks as it has
blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
KEYS = ("execution_id", "_block")


def _blocked(rows: DataFrame, order: str) -> DataFrame:
    return rows.withColumn("_block", F.expr(f"{order} div {BLOCK}"))


def _ahead(blocks: DataFrame, value: Column, name: str) -> DataFrame:
    """(execution_id, _block, name): `value` aggregated over the blocks before each."""
    w = Window.partitionBy("execution_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(*KEYS, value.over(w).alias(name))


def previous(rows: DataFrame, name: str, order: str = "sequence") -> DataFrame:
    """Adds the `order` value of the row before in the same execution (of equal values the same); null for the first."""
    cut = _blocked(rows, order)
    ahead = _ahead(cut.groupBy(*KEYS).agg(F.max(order).alias("_top")), F.max("_top"), "_ahead")
    w = Window.partitionBy(*KEYS).orderBy(order)
    return cut.join(ahead, list(KEYS)).withColumn(name, F.coalesce(F.lag(order).over(w), F.col("_ahead"))).drop("_block", "_ahead")


def running_sum(rows: DataFrame, value: Column, name: str, order: str = "sequence") -> DataFrame:
    """Adds the sum of `value` over all earlier rows (lower `order`) of the same execution."""
    cut = _blocked(rows.withColumn("_value", value.cast("long")), order)
    ahead = _ahead(cut.groupBy(*KEYS).agg(F.sum("_value").alias("_all")), F.sum("_all"), "_ahead")
    w = Window.partitionBy(*KEYS).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return cut.join(ahead, list(KEYS)).withColumn(name, zero(F.col("_ahead")) + zero(F.sum("_value").over(w))).drop("_block", "_ahead", "_value")


def last_marked(rows: DataFrame, mark: Column, name: str, order: str = "sequence") -> DataFrame:
    """Adds the highest `order` value of earlier rows of the same execution that meet `mark`; null without one."""
    cut = _blocked(rows.withColumn("_mark", F.when(mark, F.col(order))), order)
    ahead = _ahead(cut.groupBy(*KEYS).agg(F.max("_mark").alias("_top")), F.max("_top"), "_ahead")
    w = Window.partitionBy(*KEYS).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(ahead, list(KEYS)).withColumn(name, F.coalesce(F.max("_mark").over(w), F.col("_ahead"))).drop("_block", "_ahead", "_mark")
