"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths mark the words inside n-grams that a text has more than once; the measure is the
share of the text's word characters inside them.  Lines are measured alike.  One pass, no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlight.llm import textkernel as tk
from foldlight.llm.common import in_arrow, record

#: Words in an n-gram, and the largest share of word characters that may lie inside repeated ones.
COVERAGE_LIMITS = {5: 0.25, 7: 0.22, 10: 0.20}
#: The largest share of word characters that may lie in lines equal to an earlier line.
LINE_LIMIT = 0.20
MIN_WORDS = 10
REPEAT_WORDS_PERCENT = 20
BASE_NGRAM = 5

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _schema(lengths) -> pa.Schema:
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = [f"dup_{n}gram_share" for n in lengths] + ["dup_line_share"]
    return pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in longs), *((c, pa.float64()) for c in shares)])


def _repeated_ngram_words(hashes, word_offsets, doc_of_word, length):
    """True for each word inside an n-gram that its own text has twice or more."""
    windows = tk.window_hashes(hashes, length)
    starts = np.flatnonzero(tk.window_mask(word_offsets, len(hashes), length))
    keys = tk.mix(windows[starts] + tk.mix(doc_of_word[starts].astype(np.uint64) + np.uint64(1)))
    return tk.covered(starts[tk.repeated(keys)], length, len(hashes))


def measure_chunk(part: pa.RecordBatch, lengths=tuple(COVERAGE_LIMITS)) -> pa.RecordBatch:
    data, offsets = tk.text_bytes(part.column(1))
    starts, ends, word_offsets = tk.words(data, offsets)
    n_words = np.diff(word_offsets)
    doc_of_word = tk.text_of(word_offsets)
    first_of_char = (data & 0xC0) != 0x80
    chars_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(first_of_char & tk.NO_WORD[data], out=chars_before[1:])
    word_chars = chars_before[ends] - chars_before[starts]
    total = tk.sums(word_chars, word_offsets)
    hashes = tk.span_hashes(data, starts, ends)
    columns = {"doc_id": part.column(0), "n_words": n_words, "word_chars": total, "n_symbols": tk.sums(SYMBOLS[data], offsets)}
    base = _repeated_ngram_words(hashes, word_offsets, doc_of_word, BASE_NGRAM)
    columns["n_repeat_words"] = tk.sums(base, word_offsets)
    whole = np.maximum(total, 1)
    for n in lengths:
        inside = base if n == BASE_NGRAM else _repeated_ngram_words(hashes, word_offsets, doc_of_word, n)
        columns[f"dup_{n}gram_share"] = tk.sums(word_chars * inside, word_offsets) / whole
    # A line starts with its text or after a \n, and ends before the next \n or with its text.
    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.concatenate([offsets[:-1], breaks + 1])
    line_doc = np.concatenate([np.arange(len(n_words)), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((line_starts, line_doc))
    line_starts, line_doc = line_starts[order], line_doc[order]
    line_ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, line_starts)], offsets[line_doc + 1])
    has_word = chars_before[line_ends] > chars_before[line_starts]
    line_starts, line_ends, line_doc = line_starts[has_word], line_ends[has_word], line_doc[has_word]
    keys = tk.mix(tk.span_hashes(data, line_starts, line_ends) + tk.mix(line_doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    later = np.zeros(len(keys), bool)
    later[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    n = len(n_words)
    columns["n_dup_lines"] = np.bincount(line_doc[later], minlength=n)
    line_chars = chars_before[line_ends] - chars_before[line_starts]
    columns["dup_line_share"] = np.bincount(line_doc[later], weights=line_chars[later], minlength=n) / whole
    return record(_schema(lengths), **columns)


def repetition_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths=tuple(COVERAGE_LIMITS)) -> DataFrame:
    """Counts and repetition shares of every text, one row per input row.

    Null and empty texts have zero words and zero shares; rows are judged one by one, so repeated ids and rows each get
    their own result; a null id stays null; further input columns are ignored.
    """
    schema = _schema(lengths)
    ddl = ", ".join(f"{f.name} {'double' if f.type == pa.float64() else 'long'}" for f in schema)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_arrow(rows, tk.over_chunks(lambda part: measure_chunk(part, lengths)), ddl)


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits=COVERAGE_LIMITS, line_limit: float = LINE_LIMIT) -> DataFrame:
    """Measures with `base_failed` and `kept`; see repetition_measures for nulls, empty texts and repeats."""
    m = repetition_measures(docs, id_col, text_col, tuple(limits))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_WORDS_PERCENT * F.col("n_words"))
    clean = F.col("dup_line_share") <= line_limit
    for n, most in limits.items():
        clean = clean & (F.col(f"dup_{n}gram_share") <= most)
    return m.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & clean)


def _covered(n: int) -> str:
    """SQL: word rows that lie in an n-gram which their text has twice or more."""
    return f"""SELECT doc, pos, max(hit) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) IS NOT NULL AS inside
      FROM words w LEFT JOIN (SELECT doc, pos, 1 AS hit FROM (SELECT doc, pos, count(*) OVER (PARTITION BY doc, gram) AS times
        FROM (SELECT doc, unnest(range(1, n_words - {n - 2})) AS pos, list_slice(w, pos, pos + {n - 1}) AS gram FROM texts WHERE n_words >= {n})) WHERE times > 1) USING (doc, pos)"""


#: The verdicts in DuckDB's SQL; ids are taken as unique.
ORACLE = f"""
WITH texts AS (
  SELECT doc_id AS doc, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, len(w)::BIGINT AS n_words FROM documents
), words AS (
  SELECT doc, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM texts
), lines AS (
  SELECT doc, line, row_number() OVER (PARTITION BY doc, line ORDER BY pos) AS nth, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars
  FROM (SELECT doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM texts)
), line_sums AS (
  SELECT doc, count(*) FILTER (nth > 1 AND chars > 0)::BIGINT AS n_dup_lines, coalesce(sum(chars) FILTER (nth > 1), 0) AS chars FROM lines GROUP BY doc
), {", ".join(f"inside{n} AS ({_covered(n)})" for n in COVERAGE_LIMITS)},
sums AS (
  SELECT doc, sum(length(word))::BIGINT AS word_chars, {", ".join(f"count(*) FILTER (i{n}.inside)::BIGINT AS n{n}, coalesce(sum(length(word)) FILTER (i{n}.inside), 0) AS c{n}" for n in COVERAGE_LIMITS)}
  FROM words {" ".join(f"JOIN inside{n} i{n} USING (doc, pos)" for n in COVERAGE_LIMITS)} GROUP BY doc
), measured AS (
  SELECT t.doc AS doc_id, n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, n_dup_lines, coalesce(n{BASE_NGRAM}, 0) AS n_repeat_words,
    {", ".join(f"coalesce(c{n}, 0)::DOUBLE / greatest(coalesce(word_chars, 0), 1) AS dup_{n}gram_share" for n in COVERAGE_LIMITS)}, l.chars::DOUBLE / greatest(coalesce(word_chars, 0), 1) AS dup_line_share
  FROM texts t LEFT JOIN sums s ON s.doc = t.doc JOIN line_sums l ON l.doc = t.doc
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_WORDS_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_WORDS_PERCENT} * n_words) AND dup_line_share <= {LINE_LIMIT} AND {" AND ".join(f"dup_{n}gram_share <= {m}" for n, m in COVERAGE_LIMITS.items())} AS kept
FROM measured
"""
