"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A transcript is rows of text in order; a row may start with a speaker's name, hold several turns, or go on with the last
one.  States are (role, starts a turn / goes on); a line shows its speaker marker, whether it starts a row, its length
and whether it asks.  Viterbi finds the best states of each transcript.  A speaker whose name means no known role is the
role "other", and keeps the name.

A transcript may be longer than a task can hold.  Rows are range partitioned by transcript and order; every partition
sums up the transcripts that it may share with its neighbours (its first and last) by a best-score matrix from entry to
exit state; one row per transcript and partition is then walked to fix the states at the cuts, and each partition
decodes its lines between fixed states.  This gives a best path of the whole transcript, however it is cut.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlight.llm.common import in_arrow, staged

OTHER = "other"
ROLES = ("system", "user", "assistant", "tool", OTHER)
#: Names that mark a speaker, in lower case.  An unknown name counts in the explicit form <|name|> only: "Note:" is text.
NAMES = {
    "system": "system", "developer": "system", "instructions": "system", "tool": "tool", "function": "tool", "observation": "tool", "user": "user", "human": "user", "question": "user", "q": "user", "customer": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "model": "assistant", "answer": "assistant", "a": "assistant", "agent": "assistant",
}
#: Its parts share no characters, so that none has to give back what it took: linear in the line.
MARKER = re.compile(r"^\s*+(?:<\|(?P<tag>[^|\n]++)\|>|[\[(*#]*+\s*+(?P<name>\w++)\s*+[\])*#]*+\s*+:)\s*+", re.I)
#: Chance that a turn starts with a marker; that a marker names another role; that a line inside a turn looks marked.
MARKED, WRONG, STRAY = 0.85, 0.0005, 0.002
#: Chance that a turn starts a row, that a line inside a turn does, and that the next line goes on with the turn.
ROW_START, ROW_INSIDE, GOES_ON = 0.97, 0.03, 0.6
LENGTHS = 8
_STATES = 2 * len(ROLES)  # 2 r: starts a turn of role r; 2 r + 1: goes on with it


def canonical_role(role: Column) -> Column:
    """The role that a name means; null for null and blank names."""
    name = F.lower(F.trim(role))
    out = F.when(name != "", F.lit(OTHER))
    for known, means in NAMES.items():
        out = F.when(name == known, means).otherwise(out)
    return out


def line_feature(line: str) -> int:
    """Length class and question, as one number below 2 * LENGTHS."""
    return 2 * min(len(line).bit_length(), LENGTHS - 1) + line.rstrip().endswith("?")


@dataclass(frozen=True)
class Hmm:
    """Log-probabilities: start (states), step (states x states), feature (roles x features)."""

    start: np.ndarray
    step: np.ndarray
    feature: np.ndarray

    def emission(self, marker: int, row_start: bool, feature: int) -> np.ndarray:
        """Of a line by state; marker: a role's number, or -1 without one."""
        out = np.empty(_STATES)
        for r in range(len(ROLES)):
            begins = 1 - MARKED if marker < 0 else MARKED * (1 - WRONG) if marker == r else MARKED * WRONG / (len(ROLES) - 1)
            inside = 1 - STRAY if marker < 0 else STRAY / len(ROLES)
            out[2 * r] = np.log(begins * (ROW_START if row_start else 1 - ROW_START)) + self.feature[r, feature]
            out[2 * r + 1] = np.log(inside * (ROW_INSIDE if row_start else 1 - ROW_INSIDE)) + self.feature[r, feature]
        return out


def model_from_counts(first: dict[str, float], after: dict[tuple[str, str], float], features: dict[tuple[str, int], float]) -> Hmm:
    """Adds one to each count; first: roles of first turns, after: (role, next turn's role), features: (role, line feature)."""
    n = len(ROLES)
    begin = np.array([first.get(r, 0) + 1.0 for r in ROLES])
    turn = np.array([[after.get((a, b), 0) + 1.0 for b in ROLES] for a in ROLES])
    turn /= turn.sum(axis=1, keepdims=True)
    shown = np.array([[features.get((r, f), 0) + 1.0 for f in range(2 * LENGTHS)] for r in ROLES])
    start = np.full(_STATES, -np.inf)
    start[::2] = np.log(begin / begin.sum())
    step = np.full((_STATES, _STATES), -np.inf)
    for a in range(n):
        for state in (2 * a, 2 * a + 1):
            step[state, 2 * a + 1] = np.log(GOES_ON)
            step[state, ::2] = np.log((1 - GOES_ON) * turn[a])
    return Hmm(start, step, np.log(shown / shown.sum(axis=1, keepdims=True)))


def fit(labelled: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Hmm:
    """Counts over all rows with a role; only counts by role and feature come to the driver."""
    rows = labelled.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), canonical_role(F.col(role).cast("string")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("role is not null")
    first = rows.groupBy("conv").agg(F.min_by("role", "turn").alias("role")).groupBy("role").count().collect()
    turns = rows.select("conv", "turn", "role").distinct()
    follow = turns.select("conv", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    after = turns.join(follow, ["conv", "turn"]).groupBy("role", "next").count().collect()
    line = F.explode(F.split("text", "\n", -1)).alias("line")
    length = F.least(F.length(F.bin(F.length("line").cast("long"))), F.lit(LENGTHS - 1))
    length = F.when(F.length("line") == 0, 0).otherwise(length)
    asks = F.rtrim("line").endswith("?").cast("int")
    shown = rows.select("role", line).groupBy("role", (2 * length + asks).alias("f")).count().collect()
    return model_from_counts({r["role"]: r["count"] for r in first}, {(r["role"], r["next"]): r["count"] for r in after}, {(r["role"], r["f"]): r["count"] for r in shown})


def parse_line(line: str) -> tuple[int, str, str]:
    """(role's number or -1, the speaker's name in lower case, the line without its marker)."""
    if m := MARKER.match(line):
        name = (m["tag"] or m["name"]).strip().lower()
        known = NAMES.get(name, OTHER if m["tag"] and name else None)
        if known:
            return ROLES.index(known), name, line[m.end() :]
    return -1, "", line


def observations(texts: list[str], model: Hmm) -> tuple[list[int], list[str], list[str], np.ndarray]:
    """Of a run of rows: each line's row, speaker's name, text without marker, and emissions."""
    rows, names, lines, seen = [], [], [], []
    known: dict[tuple, np.ndarray] = {}
    for k, text in enumerate(texts):
        for j, raw in enumerate(text.split("\n")):
            marker, name, line = parse_line(raw)
            key = marker, j == 0, line_feature(line)
            if key not in known:
                known[key] = model.emission(*key)
            rows.append(k), names.append(name), lines.append(line), seen.append(known[key])
    return rows, names, lines, np.array(seen)


def transfer(emissions: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best score of the lines from the state before them (row) to the last one's state (column)."""
    best = step + emissions[0]
    for e in emissions[1:]:
        best = (best[:, :, None] + step[None, :, :]).max(axis=1) + e
    return best


def viterbi(emissions: np.ndarray, first: np.ndarray, step: np.ndarray, last: int = -1) -> np.ndarray:
    """The best states; first: log-chances of the first line's state; last: the last line's state, if given."""
    score, back = first + emissions[0], np.empty(emissions.shape, np.int8)
    for i in range(1, len(emissions)):
        reach = score[:, None] + step
        back[i] = reach.argmax(axis=0)
        score = reach.max(axis=0) + emissions[i]
    states = np.empty(len(emissions), np.int8)
    states[-1] = last if last >= 0 else score.argmax()
    for i in range(len(emissions) - 1, 0, -1):
        states[i - 1] = back[i, states[i]]
    return states


_SUMMARY = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("best", pa.list_(pa.float64()))])
_CUTS = "conv string, part int, before int, last int"


def viterbi_start(texts: list[str], model: Hmm) -> np.ndarray:
    """Best score by the last line's state if the transcript starts with these rows."""
    emissions = observations(texts, model)[3]
    score = model.start + emissions[0]
    for e in emissions[1:]:
        score = (score[:, None] + model.step).max(axis=0) + e
    return score


def _walk(group: pd.DataFrame) -> pd.DataFrame:
    """States at the cuts of one transcript; a row for each partition that has a part of it."""
    group = group.sort_values("part").reset_index(drop=True)
    values = np.array(group["best"].tolist())
    square = _STATES * _STATES
    score, back = values[0, square:], []
    for v in values[1:]:
        reach = score[:, None] + v[:square].reshape(_STATES, _STATES)
        back.append(reach.argmax(axis=0))
        score = reach.max(axis=0)
    last = [int(score.argmax())]
    for b in reversed(back):
        last.append(int(b[last[-1]]))
    last.reverse()
    return pd.DataFrame({"conv": group["conv"], "part": group["part"].astype("int32"), "before": np.array([-1, *last[:-1]], "int32"), "last": np.array(last, "int32")})


_TURNS = pa.schema([("conv", pa.string()), ("turn", pa.int64()), ("piece", pa.int64()), ("role", pa.string()), ("n_lines", pa.int64()), ("text", pa.large_string()), ("part", pa.int32()), ("continues", pa.bool_()), ("cut", pa.bool_())])
_TURNS_DDL = "conv string, turn long, piece long, role string, n_lines long, text string, part int, continues boolean, cut boolean"


def _decode(model: Hmm, size: int = 4096):
    """Turns; `continues`: it goes on with the last one of the partition before; `cut`: it may be one piece of several."""

    def run(batches):
        out: list[tuple] = []
        for (part, _), (convs, turns, texts, before, last) in _parts(batches):
            rows, names, lines, emissions = observations(texts, model)
            first = model.start if before[0] is None or before[0] < 0 else model.step[before[0]]
            states = viterbi(emissions, first, model.step, -1 if last[0] is None else last[0])
            begins = np.flatnonzero((states % 2 == 0) | (np.arange(len(states)) == 0))
            row, piece = -1, 0
            for a, b in zip(begins, [*begins[1:], len(states)], strict=True):
                continues = bool(states[a] % 2)
                if not continues:
                    row, piece = rows[a], piece + 1 if rows[a] == row else 0
                role = ROLES[states[a] // 2]
                cut = continues or (b == len(states) and last[0] is not None)
                out.append((convs[0], turns[rows[a]], piece, names[a] or OTHER if role == OTHER else role, int(b - a), "\n".join(lines[a:b]), part, continues, cut))
            if len(out) >= size:
                yield _table(out)
                out = []
        if out:
            yield _table(out)

    return run


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TURNS, strict=True)], schema=_TURNS)


def _parts(batches):
    """Runs of one partition number and transcript."""
    key, held = None, None
    for batch in batches:
        found = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", "conv", "turn", "text", "before", "last")]
        for part, *values in zip(*found, strict=True):
            if held is not None and key == (part, values[0]):
                for have, v in zip(held, values, strict=True):
                    have.append(v)
                continue
            if held is not None:
                yield key, held
            key, held = (part, values[0]), [[v] for v in values]
    if held is not None:
        yield key, held


def parse_transcripts(rows: DataFrame, model: Hmm, conv: str = "conv_id", turn: str = "turn", text: str = "text", marker: str | None = None) -> DataFrame:
    """(conv, turn, piece, role, n_lines, text, rendered): one row per recovered turn.

    `turn` and `piece` say where it starts: the row, and the number of turns that start in that row before.  `rendered` is the
    turn in the canonical form, `<|role|>` on a line of its own before the text; the texts in order of (turn, piece) are the
    transcript.
    `marker`: a column with the speaker's name, put before its row's text as <|name|>.  A name that means no known role is the role
    of its turn.  A null text is one empty line; a null or blank marker is none; rows without a conversation are one conversation, as are those of equal ids; rows of one turn number are
    ordered by their text; a null turn comes first.
    """
    name = F.trim(F.translate(F.col(marker).cast("string"), "|\n", "  ")) if marker else F.lit(None).cast("string")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    shown = rows.select(F.col(conv).cast("string").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.concat(F.lit("<|"), F.when(name != "", name), F.lit("|> "), body), body).alias("text"))
    keys = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]
    dealt = shown.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = staged(dealt.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "transcripts")
    back = lambda df: df.repartition("part").sortWithinPartitions("part", "place")
    ends = ordered.groupBy("part").agg(F.min("place").alias("a"), F.max("place").alias("b"))
    # Two transcripts a partition at most: a number that follows the partitions, not the rows.
    edge = ordered.join(F.broadcast(ends), "part").where("place = a or place = b").select("part", "conv").distinct()
    shared = edge.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv")
    cut = edge.join(shared, edge["conv"].eqNullSafe(shared["conv"]), "left_semi")
    cut = staged(cut, "cuts")
    lines = ordered.alias("o").join(F.broadcast(cut).alias("c"), F.expr("o.part = c.part and o.conv <=> c.conv"), "left_semi")
    pieces = in_arrow(back(lines), _summary_runs(model), "conv string, part int, best array<double>")
    cuts = staged(pieces.groupBy("conv").applyInPandas(_walk, _CUTS), "cut-states")
    known = ordered.alias("o").join(F.broadcast(cuts).alias("c"), F.expr("o.part = c.part and o.conv <=> c.conv"), "left").select("o.part", "o.place", "o.conv", "o.turn", "o.text", "c.before", "c.last")
    found = staged(in_arrow(back(known), _decode(model), _TURNS_DDL), "turns")
    turns = found.where("not cut").select(*_TURN).unionByName(_pieces_joined(found.where("cut")))
    return turns.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n")))


_TURN = ("conv", "turn", "piece", "role", "n_lines", "text")


def _pieces_joined(pieces: DataFrame) -> DataFrame:
    """Turns of the pieces at the partitions' edges, of which there are two a partition at most: each starts with one that does not continue."""
    place = F.struct("part", F.when(F.col("continues"), 0).otherwise(1).alias("place"))
    nth = F.count_if(~F.col("continues")).over(Window.partitionBy("conv").orderBy(place))
    listed = F.array_sort(F.collect_list(F.struct(place.alias("place"), "text")))
    one = pieces.withColumn("nth", nth).groupBy("conv", "nth").agg(F.min(F.struct(place.alias("place"), "turn", "piece", "role")).alias("first"), F.sum("n_lines").alias("n_lines"), listed.alias("listed"))
    return one.select("conv", "first.turn", "first.piece", "first.role", "n_lines", F.array_join(F.transform("listed", lambda x: x["text"]), "\n").alias("text"))


def _summary_runs(model: Hmm):
    def run(batches):
        key, texts = None, []
        for batch in batches:
            for part, conv, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", "conv", "text")), strict=True):
                if key is not None and (part, conv) != key:
                    yield _summary(key, texts, model)
                    texts = []
                key = part, conv
                texts.append(text)
        if key is not None:
            yield _summary(key, texts, model)

    return run


def _summary(key: tuple, texts: list[str], model: Hmm) -> pa.RecordBatch:
    best = transfer(observations(texts, model)[3], model.step)
    values = np.concatenate([best.ravel(), viterbi_start(texts, model)])
    return pa.RecordBatch.from_arrays([pa.array([key[1]], pa.string()), pa.array([key[0]], pa.int32()), pa.array([values.tolist()], pa.list_(pa.float64()))], schema=_SUMMARY)
