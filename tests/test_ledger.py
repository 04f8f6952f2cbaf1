import random

import pandas as pd

from foldlight.operators import ledger, ledger_stretches, validation
from foldlight.streaming import ledger as stream

SCHEMA = "idempotency_key string, op_seq long, op string, result string, error string, execution_id string, call_id string, ts string"


def log(spark, *ops, key="k"):
    return spark.createDataFrame([(key, n, op, f"r{n}", f"e{n}", "x", f"c{n}", str(n)) for n, op in enumerate(ops)], SCHEMA)


def decided(spark, *ops):
    return [r["decision"] for r in ledger.decisions(log(spark, *ops)).orderBy("op_seq").collect()]


def test_logs(spark):
    assert decided(spark, "claim", "complete", "claim") == ["execute", "ok", "deduplicated"]
    assert decided(spark, "claim", "claim") == ["execute", "refused_pending"]
    assert decided(spark, "claim", "fail", "claim") == ["execute", "ok", "refused_failed"]
    assert decided(spark, "claim", "fail", "authorize_retry", "claim", "complete") == ["execute", "ok", "ok", "execute", "ok"]
    assert decided(spark, "claim", "authorize_retry", "authorize_retry", "claim", "claim", "claim") == ["execute", "ok", "ok", "execute", "execute", "refused_pending"]
    assert decided(spark, "claim", "complete", "complete", "authorize_retry") == ["execute", "ok", "refused_completed", "refused_completed"]
    assert decided(spark, "complete", "fail", "nonsense") == ["unknown_key", "unknown_key", "unknown_key"]


def test_records_and_blank_keys(spark):
    record = ledger.records(log(spark, "claim", "fail", "authorize_retry", "claim")).collect()[0]
    assert (record["status"], record["attempts"], record["retry_authorized"], record["call_id"], record["error"], record["created_at"]) == ("PENDING", 2, 0, "c3", None, "0")
    blank = log(spark, "claim", key="  ")
    assert ledger.records(blank).count() == 0 and validation.blank_keys(blank).count() == 1
    assert ledger.records(log(spark, "claim", key=" k ")).collect()[0]["idempotency_key"] == " k "
    assert ledger.unresolved(ledger.records(log(spark, "claim"))).count() == 1 and ledger.unresolved(ledger.records(log(spark, "claim", "authorize_retry"))).count() == 0


def test_random_logs_agree_with_a_sequential_ledger(spark, rows):
    pick = random.Random(5)
    ops = [(f"k{pick.randrange(40)}", n, pick.choice(["claim", "claim", "complete", "fail", "authorize_retry"]), f"r{n}", f"e{n}", "x", f"c{n}", str(n)) for n in range(1500)]
    expected, state = [], {}
    for key, n, op, result, error, *_ in ops:
        state[key], decision, served = stream.step(state.get(key, (None, 0, 0, None, None)), op, result, error)
        expected.append((key, n, op, decision, served))
    found = ledger.decisions(spark.createDataFrame(ops, SCHEMA)).toPandas()
    assert rows(found) == rows(pd.DataFrame(expected, columns=["idempotency_key", "op_seq", "op", "decision", "result"]))


def random_ops(n, keys, seed):
    pick = random.Random(seed)
    ops = []
    for i in range(n):
        key = pick.choice(keys)
        kinds = ["claim"] * 6 + ["authorize_retry"] * 6 + ["fail", "odd", None] if key != "done" else ["claim", "authorize_retry", "fail", "complete"]
        ops.append((key, i // 2 if key == "ties" else i, pick.choice(kinds), f"r{i}", f"e{i}", pick.choice(["x", "y", "z", None]), f"c{i}", str(i), pick.choice([None, None, None, "x", "y"]), f"n{i}"))
    return ops


def test_long_logs_in_stretches(spark, rows, monkeypatch):
    """Logs cut in stretches: the same records and decisions as one walk a key, whatever holder, outcome or tie stands at a cut."""
    ops = spark.createDataFrame(random_ops(3000, ["a", "b", "done", "ties", "rare"] + ["a"] * 9, 8), SCHEMA + ", by_execution string, note string")
    whole = [ledger.records(ops).toPandas(), ledger.decisions(ops).toPandas()]
    monkeypatch.setattr(ledger, "LONG_LOG", 40)
    for stretch in (7, 64):
        monkeypatch.setattr(ledger, "STRETCH", stretch)
        assert rows(ledger.records(ops).toPandas()) == rows(whole[0]) and rows(ledger.decisions(ops).toPandas()) == rows(whole[1])


def test_stretches_compose():
    """Functions of stretches, applied in order, come to where the walk over all operations comes."""
    for seed in range(300):
        pick = random.Random(seed)
        kinds = pick.choice([["claim"] * 3 + ["authorize_retry"] * 2 + ["fail"], ["claim", "authorize_retry"] * 5 + ["fail", "complete", "odd", None], ["claim", "authorize_retry"]])
        executions = pick.choice([["x"], ["x", "y", None], ["x", "y", "z"]])
        ops = [(pick.choice(kinds), pick.choice(executions), pick.choice([None] * pick.randint(1, 4) + executions), f"r{i}") for i in range(pick.randint(1, 60))]
        size, state = pick.randint(1, 9), None
        for i in range(0, len(ops), size):
            state = ledger_stretches.applied(state, *ledger_stretches._decoded(ledger_stretches._encoded(*ledger_stretches.summed_up(ops[i : i + size]))))
        wanted = ledger_stretches.applied(None, *ledger_stretches.summed_up(ops))
        assert state == wanted
        assert wanted is None or wanted["authorized"] >= 0


def test_a_million_operations_of_one_key(spark):
    """One key's log over many tasks; claims and authorisations in turn, so that every decision hangs on all before it."""
    n = 1_000_000
    kind = "case when id = 0 then 'claim' when id % 7 = 3 then 'fail' when pmod(xxhash64(id), 2) = 0 then 'claim' else 'authorize_retry' end"
    ops = spark.range(n).selectExpr("'k' as idempotency_key", "id as op_seq", f"{kind} as op", "'x' as execution_id", "cast(id as string) as ts").repartition(8)
    found = ledger.decisions(ops).groupBy("op", "decision").count().collect()
    left, wanted, status = 0, {}, None
    for r in ops.orderBy("op_seq").select("op").toLocalIterator():
        decision = "ok"
        if r["op"] == "claim":
            decision = "execute" if status is None or left > 0 else "refused_failed" if status == "FAILED" else "refused_pending"
            if decision == "execute":
                left, status = max(left - 1, 0), "PENDING"
        elif r["op"] == "fail":
            left, status = 0, "FAILED"
        else:
            left += 1
        wanted[r["op"], decision] = wanted.get((r["op"], decision), 0) + 1
    assert {(r["op"], r["decision"]): r["count"] for r in found} == wanted
    record = ledger.records(ops).first()
    assert (record["retry_authorized"], record["status"], record["attempts"]) == (left, status, wanted["claim", "execute"])
