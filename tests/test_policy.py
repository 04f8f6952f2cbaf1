import json

import pytest
from pyspark.sql import functions as F

from foldlight.functions import canonical, policy, predicates, tools


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


@pytest.mark.parametrize(("initial", "multiplier", "most", "delays"), [(0.1, 2.0, 10.0, [0.1, 0.2, 0.4]), (1.0, 10.0, 5.0, [1.0, 5.0, 5.0]), (0.5, 1.0, 10.0, [0.5] * 3), (0.0, 2.0, 10.0, [0.0] * 3)])
def test_backoff(spark, initial, multiplier, most, delays):
    found = spark.range(1, 4).select(policy.backoff_delay(F.lit(initial), F.lit(multiplier), F.lit(most), F.col("id")).alias("d"))
    assert [r["d"] for r in found.collect()] == pytest.approx(delays)


@pytest.mark.parametrize("kind", ["RETRYABLE", "PERMANENT", "UNEXPECTED", "TIMEOUT", "CANCELLED"])
@pytest.mark.parametrize("on_timeout", [True, False])
@pytest.mark.parametrize("on_unknown", [True, False])
def test_should_retry(spark, kind, on_timeout, on_unknown):
    wanted = {"RETRYABLE": True, "TIMEOUT": on_timeout, "UNEXPECTED": on_unknown}.get(kind, False)
    decide = lambda attempt: value(spark, policy.should_retry(F.lit(kind), F.lit(attempt), F.lit(3), F.lit(on_timeout), F.lit(on_unknown)))
    assert decide(1) is wanted and decide(3) is False


def test_policy_text(spark):
    given = value(spark, policy.parse_policy(F.lit(json.dumps({"max_attempts": 3, "initial_delay": 0.1, "multiplier": 2.0, "max_delay": 1.0}))))
    assert (given["max_attempts"], given["retry_on_timeout"]) == (3, False)
    assert value(spark, policy.parse_policy(F.lit(None).cast("string")))["max_attempts"] == 1
    assert value(spark, policy.is_valid_policy(policy.parse_policy(F.lit('{"max_attempts":0,"initial_delay":1,"multiplier":2,"max_delay":1}')))) is False
    assert value(spark, policy.error_kind(F.lit("RetryableToolError"))) == "RETRYABLE" and value(spark, policy.error_kind(F.lit("ValueError"))) == "UNEXPECTED"
    assert [value(spark, policy.is_valid_timeout(F.lit(t).cast("double"))) for t in (1.0, 0.0, float("inf"), None)] == [True, False, False, True]


def test_canonical_json(spark):
    same = lambda a, b: value(spark, canonical.canonical_json(F.lit(a)).eqNullSafe(canonical.canonical_json(F.lit(b))))
    assert same('{"a":1,"b":[1,{"c":null}]}', '{"b":[1.0,{"c":null}],"a":1}') and not same('{"a":true}', '{"a":1}') and not same("[1,2]", "[2,1]")
    assert value(spark, canonical.canonical_json(F.lit("NaN"))) is None


def test_tools_and_predicates(spark):
    run = lambda name, a, b: value(spark, tools.arithmetic().result(F.lit(name), F.lit(a), F.lit(b)))
    assert [run("add", 2.0, 3.0), run("subtract", 2.0, 3.0), run("multiply", 2.0, 3.0), run("divide", 3.0, 2.0), run("divide", 1.0, 0.0), run("none", 1.0, 1.0)] == [5.0, -1.0, 6.0, 1.5, None, None]
    with pytest.raises(ValueError):
        tools.arithmetic().register("add", lambda a, b: a)
    assert value(spark, predicates.attempt_number(F.lit(0))) == 1 and value(spark, predicates.attempt_number(F.lit(None))) == 1 and value(spark, predicates.attempt_number(F.lit(4))) == 4
    assert value(spark, predicates.timeout_enforced(F.lit("TIMED_OUT"), F.lit(None).cast("boolean"))) is True and value(spark, predicates.timeout_enforced(F.lit("FAILED"), F.lit(True))) is None
