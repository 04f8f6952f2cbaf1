"""Long ledger logs in stretches: each stretch of a key's operations as a function of the state before it.

What decides an operation is the key's status, the authorisations left and the execution that holds the key.  Of a key that
was claimed and not completed, a stretch is known by pieces: for authorisations within bounds, and a holder that is or is
not one of those named, what the state is afterwards, where the authorisations are a constant or the former ones plus a
net change (claims use them up, down to none; an outcome sets them to none).  A completed key stays as it is, and a key that was never
claimed has one way only.  Functions of following stretches are applied one after the other, in the order of the log.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldlight.shipping import ship
from foldlight.staging import staged

COMPLETED, FAILED, PENDING = "COMPLETED", "FAILED", "PENDING"
#: Stands for what the state before the stretch says.
SAME = "same"


@dataclass(frozen=True)
class Piece:
    """States before a stretch, and the state after it.

    least, most: authorisations before (most None: no bound); holder: (execution,) if it is known, not_holder: executions that
    it is not.  status and owner after: SAME or a value (owner in a tuple); authorised after: `left`, plus those before if `adds`.
    """

    least: int = 0
    most: int | None = None
    holder: tuple | None = None
    not_holder: frozenset = frozenset()
    status: str = SAME
    adds: bool = True
    left: int = 0
    owner: tuple | str = SAME
    result: str | None = None

    def settled(self) -> "Piece":
        """With constants in place of what the bounds fix."""
        known = self
        if known.adds and known.least == known.most:
            known = replace(known, adds=False, left=known.left + known.least)
        if known.owner == SAME and known.holder is not None:
            known = replace(known, owner=known.holder)
        return known

    def after(self) -> tuple:
        return self.status, self.adds, self.left, self.owner, self.result


def _claimed(piece: Piece, execution: str | None) -> list[Piece]:
    taken = lambda p: replace(p, status=PENDING, left=p.left - 1, owner=(execution,))
    if not piece.adds:
        return [taken(piece) if piece.left > 0 else piece]
    none_left = -piece.left  # authorisations before that leave none here; fewer are in other pieces
    if piece.least > none_left:
        return [taken(piece)]
    return [replace(piece, most=none_left).settled(), *([taken(replace(piece, least=none_left + 1)).settled()] if piece.most is None or piece.most > none_left else [])]


def _asked_by(piece: Piece, by: str | None) -> list[tuple[Piece, bool]]:
    """The piece, divided where needed, each part with whether the asking execution may settle the key."""
    if by is None:
        return [(piece, True)]
    if piece.owner != SAME:
        return [(piece, piece.owner[0] is None or piece.owner[0] == by)]
    parts = [(replace(piece, holder=(e,)).settled(), True) for e in (by, None) if e not in piece.not_holder]
    return [*parts, (replace(piece, not_holder=piece.not_holder | {by, None}), False)]


def step(pieces: list[Piece], op: str | None, execution: str | None, by: str | None, result: str | None) -> list[Piece]:
    """The pieces after one more operation."""
    out: list[Piece] = []
    for piece in pieces:
        if piece.status == COMPLETED or op not in ("claim", "complete", "fail", "authorize_retry"):
            out.append(piece)
        elif op == "claim":
            out += _claimed(piece, execution)
        else:
            for part, may in _asked_by(piece, by):
                if may and op == "authorize_retry":
                    part = replace(part, left=part.left + 1)
                elif may:
                    part = replace(part, status=COMPLETED if op == "complete" else FAILED, adds=False, left=0, result=result if op == "complete" else None)
                out.append(part)
    return _united(out) if len(out) > 1 else out


def _united(pieces: list[Piece]) -> list[Piece]:
    """Neighbours in the authorisations before that come to the same state, as one piece."""
    groups: dict[tuple, list[Piece]] = {}
    for p in pieces:
        groups.setdefault((p.holder, p.not_holder, p.after()), []).append(p)
    out: list[Piece] = []
    for same in groups.values():
        same.sort(key=lambda p: p.least)
        joined = [same[0]]
        for p in same[1:]:
            if joined[-1].most is not None and joined[-1].most + 1 == p.least:
                joined[-1] = replace(joined[-1], most=p.most)
            else:
                joined.append(p)
        out += joined
    return out


def summed_up(ops: list[tuple]) -> tuple[dict | None, list[Piece]]:
    """Of (op, execution, by, result) in order: the state of a key never claimed before, and the pieces of a claimed one."""
    fresh, pieces = None, [Piece()]
    for op, execution, by, result in ops:
        pieces = step(pieces, op, execution, by, result)
        if fresh is not None:
            fresh = step(fresh, op, execution, by, result)
        elif op == "claim":
            fresh = [Piece(0, 0, (execution,), status=PENDING).settled()]
    return (_state(fresh[0], None) if fresh else None), pieces


def _state(piece: Piece, before: dict | None) -> dict:
    same = lambda v, key: before[key] if v == SAME else v
    owner = piece.owner if piece.owner == SAME else piece.owner[0]
    return {"status": same(piece.status, "status"), "authorized": piece.left + (before["authorized"] if piece.adds else 0), "owner": before["owner"] if piece.owner == SAME else owner, "served": piece.result}


def applied(before: dict | None, fresh: dict | None, pieces: list[Piece]) -> dict | None:
    """The state after a stretch; None: never claimed."""
    if before is None:
        return fresh
    if before["status"] == COMPLETED:
        return before
    for p in pieces:
        if p.least <= before["authorized"] and (p.most is None or before["authorized"] <= p.most):
            if before["owner"] == p.holder[0] if p.holder is not None else before["owner"] not in p.not_holder:
                return _state(p, before)
    raise AssertionError("the pieces of a stretch cover every state")


def _encoded(fresh: dict | None, pieces: list[Piece]) -> str:
    plain = [[p.least, p.most, p.holder and list(p.holder), sorted(p.not_holder, key=str), p.status, p.adds, p.left, p.owner if p.owner == SAME else list(p.owner), p.result] for p in pieces]
    return json.dumps([fresh, plain])


def _decoded(text: str) -> tuple[dict | None, list[Piece]]:
    fresh, plain = json.loads(text)
    made = [Piece(a, b, None if h is None else tuple(h), frozenset(n), s, adds, left, o if o == SAME else tuple(o), r) for a, b, h, n, s, adds, left, o, r in plain]
    return fresh, made


def cut(typed: DataFrame, stretch: int) -> DataFrame:
    """(idempotency_key, x, part, nth): operations in stretches of at most `stretch` of one key; (part, nth) orders a key's stretches.

    Range partitioned by key and place in the log, so that a long log is many tasks'.
    """
    keys = ["idempotency_key", "x.op_seq"]
    dealt = staged(typed.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "ledger-ops")
    nth = F.row_number().over(Window.partitionBy("part", "idempotency_key").orderBy("x")) - 1
    return staged(dealt.withColumn("nth", F.floor(nth / stretch).cast("int")), "stretches")


def states_before(cut_ops: DataFrame) -> DataFrame:
    """(idempotency_key, part, nth, status, authorized, owner, served): the state before each stretch; nulls: never claimed."""

    def sum_up(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        ops = [tuple(None if v is None or v != v else v for v in row) for row in group[["op", "execution_id", "by_execution", "result"]].itertuples(index=False)]
        return pd.DataFrame({"idempotency_key": group["idempotency_key"].iloc[:1], "part": group["part"].iloc[:1], "nth": group["nth"].iloc[:1], "does": [_encoded(*summed_up(ops))]})

    def run_over(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "nth"])
        state, before = None, []
        for text in group["does"]:
            before.append(state or {"status": None, "authorized": None, "owner": None, "served": None})
            state = applied(state, *_decoded(text))
        found = pd.DataFrame(before, columns=["status", "authorized", "owner", "served"], dtype=object)
        found["authorized"] = found["authorized"].astype("Int32")
        return pd.concat([group[["idempotency_key", "part", "nth"]].reset_index(drop=True), found], axis=1)

    ship(cut_ops.sparkSession)
    place = F.row_number().over(Window.partitionBy("part", "idempotency_key", "nth").orderBy("x"))
    flat = cut_ops.withColumn("place", place).select("idempotency_key", "part", "nth", "place", "x.op", "x.execution_id", "x.by_execution", F.when(F.col("x.op") == "complete", F.col("x.result")).alias("result"))
    sums = flat.groupBy("idempotency_key", "part", "nth").applyInPandas(sum_up, "idempotency_key string, part int, nth int, does string")
    return staged(staged(sums, "sums").groupBy("idempotency_key").applyInPandas(run_over, "idempotency_key string, part int, nth int, status string, authorized int, owner string, served string"), "states-before")
