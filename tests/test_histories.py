"""Hash trees of histories, and JSON values that are equal in other words."""

import random

import pytest
from journals import JOURNALS, frame
from pyspark.sql import functions as F

from foldlight.functions.canonical import equal_form
from foldlight.operators import histories


def long_journal(spark, n=600, names=("a", "b", "c")):
    rows = [(name, k, "ToolStarted", f"c{k}", k % 7) for name in names for k in range(1, n + 1)]
    return spark.createDataFrame(rows, "execution_id string, sequence long, event_type string, call_id string, attempt int")


@pytest.mark.parametrize("at", [1, 8, 9, 300, 599])
def test_the_first_difference_is_found(spark, at):
    one = long_journal(spark)
    changed = one.withColumn("attempt", F.when((F.col("execution_id") == "b") & F.col("sequence").isin(at, 599), 99).otherwise(F.col("attempt")))
    other = changed.where(f"not (execution_id = 'c' and sequence >= {at} and sequence < {at} + 3)")
    found = {r["execution_id"]: (r["sequence"], r["kind"]) for r in histories.compare(one, other, leaf=8, fan=3).collect()}
    assert found == {"b": (at, "differs"), "c": (at, "missing")}
    back = {r["execution_id"]: r["kind"] for r in histories.compare(other, one, leaf=8, fan=3).collect()}
    assert back == {"b": "differs", "c": "added"}


def test_few_nodes_are_compared(spark):
    """As many nodes as the tree is high, times its fan, of a path an execution; equal executions end at the root."""
    one = long_journal(spark, 5000, ("a", "b"))
    other = one.withColumn("attempt", F.when((F.col("execution_id") == "b") & (F.col("sequence") == 3210), 99).otherwise(F.col("attempt")))
    trees = [histories.tree(histories.leaves(e, ("event_type", "call_id", "attempt"), 8), leaf=8, fan=4) for e in (one, other)]
    blocks = histories.differing_blocks(*trees).collect()
    assert [(r["execution_id"], r["block"]) for r in blocks] == [("b", 3209 // 8)] and blocks[0]["n_compared"] <= 1 + 4 * trees[0].top
    assert trees[0].top == 5 and histories.differing_blocks(trees[0], trees[0]).count() == 0


def test_leaves_grow_by_addition(spark, rows):
    one = long_journal(spark, 50)
    columns = ("event_type", "attempt")
    parts = histories.merged_leaves(histories.leaves(one.where("sequence <= 21"), columns, 8), histories.leaves(one.where("sequence > 21"), columns, 8))
    assert rows(parts.toPandas()) == rows(histories.leaves(one, columns, 8).toPandas())


def test_lengths_and_missing_executions(spark):
    one, other = frame(spark, JOURNALS), frame(spark, {k: v for k, v in JOURNALS.items() if k != "happy"})
    assert [(r["execution_id"], r["sequence"], r["kind"]) for r in histories.compare(one, other).collect()] == [("happy", 1, "missing")]
    short, long = long_journal(spark, 4, ("a",)), long_journal(spark, 400, ("a",))
    assert [(r["sequence"], r["kind"]) for r in histories.compare(short, long, leaf=8, fan=3).collect()] == [(5, "added")]
    assert histories.compare(one, one).count() == 0 and histories.compare(one.limit(0), one.limit(0)).count() == 0


def test_equal_json(spark):
    """Texts whose values Python calls equal have one form, others have not."""
    import json

    texts = ["1", "1.0", "true", "1e0", "[1, 0]", "[true, false]", "[1.0, -0.0]", '{"a": 1, "b": {"c": [true]}}', '{"b": {"c": [1.0]}, "a": true}', '"1"', '"true"', '["true", "1.0"]', '"a \\" true 1.0"', "0.5", "5e-1", "null", "[]", "{}", "[[1]]", "10000000000000000000000", "1e22", "12345678901234567890", "-3", "-3.0", '{"1.0": 1}', '{"1": 1}', "[1,10]", "[11,0]", "0.1", "1.5", "false", "0"]
    pick = random.Random(6)
    value = lambda depth: pick.choice([True, False, 0, 1, 2, 1.0, 2.5, "1", "true", None]) if depth == 0 or pick.random() < 0.3 else [value(depth - 1) for _ in range(pick.randint(0, 2))] if pick.random() < 0.5 else {k: value(depth - 1) for k in "ab"[: pick.randint(0, 2)]}
    texts += [json.dumps(value(2)) for _ in range(60)]
    found = [r["f"] for r in spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", equal_form(F.col("t")).alias("f")).orderBy("n").collect()]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (json.loads(a) == json.loads(b)) == (found[i] == found[j]), (a, b, found[i], found[j])
    assert spark.range(1).select(equal_form(F.lit("no json"))).first()[0] == "no json" and spark.range(1).select(equal_form(F.lit(None).cast("string"))).first()[0] is None
