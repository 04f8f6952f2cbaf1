"""Small journals written by hand, as (execution, sequence, type, fields)."""

FIELDS = "execution_id string, sequence long, event_type string, call_id string, tool string, arguments string, attempt int, result string, error string, failed_attempt int, delay double, timeout double, enforced boolean, idempotency_key string, deduplicated boolean, goal string"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
# Short names of the event types.
TYPES = {
    "S": "ExecutionStarted", "XOk": "ExecutionCompleted", "XFl": "ExecutionFailed", "XCx": "ExecutionCancelled", "Rq": "ToolRequested", "St": "ToolStarted", "Ok": "ToolCompleted",
    "Fl": "ToolFailed", "Rt": "ToolRetryScheduled", "To": "ToolTimedOut", "Cx": "ToolCancelled",
}


def event(kind, call=None, **fields):
    return {"event_type": TYPES[kind], "call_id": call} | fields


JOURNALS = {
    "happy": [event("S", goal="g"), event("Rq", "c", tool="add"), event("St", "c", attempt=1), event("Ok", "c", attempt=1, result="5")],
    "retries": [
        event("S"), event("Rq", "c", tool="add"), event("St", "c", attempt=1), event("Fl", "c", attempt=1, error="e1"), event("Rt", "c", attempt=2, failed_attempt=1, delay=0.1),
        event("St", "c", attempt=2), event("Fl", "c", attempt=2, error="e2"), event("Rt", "c", attempt=3, failed_attempt=2, delay=0.2), event("St", "c", attempt=3), event("Ok", "c", attempt=3, result="1"),
    ],
    "terminal_open": [event("S"), event("Rq", "c", tool="add"), event("St", "c", attempt=1), event("XFl", error="boom")],
    "cancel": [event("S"), event("Rq", "c", tool="add"), event("St", "c", attempt=1), event("Cx", "c", attempt=1, error="stop"), event("XCx", result="why")],
    "cancel_in_backoff": [event("S"), event("Rq", "c", tool="add"), event("St", "c", attempt=1), event("Fl", "c", attempt=1, error="e1"), event("Rt", "c", attempt=2, failed_attempt=1, delay=0.1), event("Cx", "c", attempt=1, error="stop")],
    "unenforced": [event("S"), event("Rq", "c", tool="add", timeout=5.0, idempotency_key="k"), event("St", "c", attempt=1), event("To", "c", attempt=1, error="late", timeout=5.0, enforced=False)],
    "dedup": [event("S"), event("Rq", "c", tool="add", idempotency_key="k", deduplicated=True), event("Ok", "c", attempt=1, result="7", deduplicated=True)],
    "no_attempt": [event("S"), event("Rq", "c", tool="add"), event("St", "c"), event("Ok", "c", result="5")],
    "same_call_id": [event("S"), event("Rq", "c", tool="add"), event("Rq", "c", tool="mul"), event("St", "c", attempt=1)],
    "two_calls": [event("S"), event("Rq", "a", tool="add"), event("St", "a", attempt=1), event("Ok", "a", attempt=1, result="1"), event("Rq", "b", tool="add"), event("St", "b", attempt=1)],
}


def frame(spark, journals, cut=None):
    rows = []
    for name, events in journals.items():
        for n, e in enumerate(events[:cut], 1):
            rows.append(tuple({"execution_id": name, "sequence": n, "deduplicated": False}.get(c) if c not in e else e[c] for c in NAMES))
    return spark.createDataFrame(rows, FIELDS)


def repeated_outcomes(n, length=12, seed=4):
    """Journals of a call in three attempts whose outcomes come without starts, twice, and between one another's."""
    import random

    pick = random.Random(seed)
    kinds = ("St", "Ok", "Ok", "Fl", "To", "Cx")
    return {f"x{k}": [event("S"), event("Rq", "c", tool="add"), *[event(pick.choice(kinds), "c", attempt=pick.choice((1, 1, 2, 3))) for _ in range(length)]] for k in range(n)}


def walked_attempts(journals):
    """{(execution, attempt): (start, outcome's sequence)}, an event after the other: an outcome of the attempt that the call is on takes over
    the call's start; any other keeps that of its attempt."""
    found = {}
    for name, events in journals.items():
        on, begun = 0, 0
        for n, e in enumerate(events, 1):
            if e["event_type"] in (TYPES["S"], TYPES["Rq"], TYPES["Rt"]):
                continue
            a = e["attempt"]
            start, _ = found.get((name, a), (0, 0))
            if e["event_type"] == TYPES["St"]:
                found[name, a], begun = (n, 0), n
            else:
                found[name, a] = ((begun if on == a else 0) or start, n)
            on = a
    return found
