"""Hash trees over histories: two stores of the same executions are compared by descending into what differs.

A leaf is the digest of a block of sequences of an execution: the sum of its events' hashes, each over the sequence and the
compared columns, so that it needs no order and grows by addition.  A node above sums up FAN nodes below.  Trees are tables,
a row per node; a comparison joins the roots, goes on with the first child that differs of each differing node, and reads the
events of one block an execution at the end, however long the histories are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlight.staging import staged

#: Sequences in a leaf, and children of a node.
LEAF, FAN = 1 << 10, 1 << 4
NODE = ("execution_id", "level", "node", "digest", "n_events")
#: What of an event is compared, where a journal has it.
COMPARED = ("event_type", "call_id", "tool", "arguments", "attempt", "result", "error", "failed_attempt", "delay", "reason", "timeout", "timeout_mode", "enforced", "idempotency_key", "deduplicated", "goal")


@dataclass(frozen=True)
class HistoryTree:
    """The nodes of all executions, and the number of the level that has one node an execution."""

    nodes: DataFrame
    top: int
    leaf: int = LEAF
    fan: int = FAN


def _summed(hashes: DataFrame, level: int) -> DataFrame:
    one = hashes.groupBy("execution_id", "node").agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("digest"), F.sum("n").alias("n_events"))
    return one.select("execution_id", F.lit(level).alias("level"), "node", "digest", "n_events")


def leaves(events: DataFrame, columns: tuple[str, ...] = COMPARED, leaf: int = LEAF) -> DataFrame:
    """Level 0: a row per block of sequences.  Leaves of further events of the same executions add up with those before."""
    hashed = events.select("execution_id", F.expr(f"(sequence - 1) div {leaf}").alias("node"), F.xxhash64("sequence", *columns).alias("h"), F.lit(1).cast("long").alias("n"))
    return _summed(hashed, 0)


def merged_leaves(*parts: DataFrame) -> DataFrame:
    """Leaves of a history from those of its parts, which share no event."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    one = every.groupBy("execution_id", "node").agg(F.sum("digest").cast("decimal(38,0)").alias("digest"), F.sum("n_events").alias("n_events"))
    return one.select("execution_id", F.lit(0).alias("level"), "node", "digest", "n_events")


def tree(level_0: DataFrame, top: int | None = None, leaf: int = LEAF, fan: int = FAN) -> HistoryTree:
    """The tree over leaves; top: the level of its roots, at least so high that each execution has one node there."""
    level = staged(level_0.select(*NODE), "tree")
    if top is None:
        most, top = level.agg(F.max("node")).first()[0] or 0, 0
        while most > 0:
            most, top = most // fan, top + 1
    every = level
    for k in range(1, top + 1):
        hashed = level.select("execution_id", F.expr(f"node div {fan}").alias("node"), F.xxhash64("node", "digest").alias("h"), F.col("n_events").alias("n"))
        level = staged(_summed(hashed, k), "tree")
        every = every.unionByName(level)
    return HistoryTree(every, top, leaf, fan)


def differing_blocks(one: HistoryTree, other: HistoryTree) -> DataFrame:
    """(execution_id, block, n_compared): the first block in which the histories differ, and how many nodes were compared to find it.

    Equal executions have no row.  Both trees have the same leaves and fan, and roots of the same level.
    """
    if (one.top, one.leaf, one.fan) != (other.top, other.leaf, other.fan):
        raise ValueError("trees of different shapes cannot be compared: give both the same top")
    side = lambda t, k, name: t.nodes.where(F.col("level") == k).select("execution_id", "node", F.struct("digest", "n_events").alias(name))
    path = None
    for k in range(one.top, -1, -1):
        a, b = side(one, k, "a"), side(other, k, "b")
        if path is not None:
            at = path.select("execution_id", F.col("node").alias("parent"), "n_compared")
            inside = lambda t: t.join(at.select("execution_id", "parent"), "execution_id").where(f"node div {one.fan} = parent").drop("parent")  # noqa: B023, E731
            a, b = inside(a), inside(b)
        both = a.join(b, ["execution_id", "node"], "full")
        first = both.groupBy("execution_id").agg(F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("node"))).alias("node"), F.count("*").alias("n")).where("node is not null")
        if path is None:
            path = first.select("execution_id", "node", F.col("n").alias("n_compared"))
        else:
            path = first.join(at.select("execution_id", "n_compared"), "execution_id").select("execution_id", "node", (F.col("n") + F.col("n_compared")).alias("n_compared"))
        path = staged(path, "path")
    return path.select("execution_id", F.col("node").alias("block"), "n_compared")


def first_differences(one: DataFrame, other: DataFrame, blocks: DataFrame, columns: tuple[str, ...] = COMPARED, leaf: int = LEAF) -> DataFrame:
    """(execution_id, sequence, kind): the first event in which two journals part: `differs`, `missing` (of the other) or `added` (by it).

    blocks: of differing_blocks; only their events are read.
    """
    wanted = blocks.select("execution_id", (F.col("block") * leaf).alias("after"))

    def inside(events: DataFrame, name: str) -> DataFrame:
        near = events.join(wanted, "execution_id").where(f"sequence > after and sequence <= after + {leaf}")
        return near.groupBy("execution_id", "sequence").agg(F.sort_array(F.collect_list(F.xxhash64("sequence", *columns))).alias(name))

    both = inside(one, "a").join(inside(other, "b"), ["execution_id", "sequence"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").otherwise("differs")
    return both.groupBy("execution_id").agg(F.min(F.struct("sequence", kind.alias("kind"))).alias("d")).select("execution_id", "d.sequence", "d.kind")


def compare(one: DataFrame, other: DataFrame, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """first_differences of two journals by their trees; for stored trees, use the parts."""
    columns = tuple(c for c in COMPARED if c in one.columns and c in other.columns)
    first = tree(leaves(one, columns, leaf), leaf=leaf, fan=fan)
    second = tree(leaves(other, columns, leaf), leaf=leaf, fan=fan)
    while first.top != second.top:  # the lower one gets further levels
        low, high = sorted((first, second), key=lambda t: t.top)
        raised = tree(low.nodes.where("level = 0"), high.top, leaf, fan)
        first, second = (raised, second) if low is first else (first, raised)
    return first_differences(one, other, differing_blocks(first, second), columns, leaf)
