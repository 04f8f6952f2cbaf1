"""Document fingerprints by consistent weighted sampling: signatures whose collision rate is the generalised Jaccard similarity.

A text is a bag of words (A-Z in lower case), a word's weight w its count.  Sample j draws for each word, from the word's
hash alone, r and c from Gamma(2, 1) and b from the uniform distribution; t = floor(ln w / r + b), y = exp(r (t - b)),
a = c / (y exp(r)).  The word of least a and its t are the sample: two texts agree in it with chance
sum(min(w, w')) / sum(max(w, w')).  A fingerprint is SAMPLES samples, 16 bits of each one's hash, as hexadecimal text; the
share of equal samples estimates the likeness with a standard deviation of at most 0.5 / sqrt(SAMPLES).

Draws depend on the word only, so they are made once for the different words of a run of texts.

For texts of documents beside each other (next_likeness) rows are range partitioned and sorted by descending id, once:
each task streams its rows and holds one back; its first and last row are put out with their text, and those (two a
partition) are joined for the pairs that partitions share.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlight.llm import textkernel as tk
from foldlight.llm.common import in_arrow, record, staged

SAMPLES = 64
SAMPLE_DIGITS = 4
#: The edited text: this share of a document's code points, at its end, is replaced by the start of the next one.
EDIT_DIVISOR = 3

_ODD, _STEP, _ALL = 0x9E3779B97F4A7C15, np.uint64(0xA24BAED4963EE407), (1 << 64) - 1
_LOW = np.uint64(0xFFFFFFFF)


def _uniform(bits: np.ndarray) -> np.ndarray:
    """In (0, 1), from 32 bits."""
    return (bits.astype(np.float64) + 0.5) * 2.0**-32


def draws(words: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, ln c, b) of each word hash for one sample."""
    x = tk.mix(words + np.uint64(_ODD * (sample + 1) & _ALL))
    y = tk.mix(x ^ _STEP)
    z = tk.mix(y + _STEP)
    gamma = lambda bits: -np.log(_uniform(bits & _LOW) * _uniform(bits >> np.uint64(32)))
    return gamma(x), np.log(gamma(y)), _uniform(z >> np.uint64(32))


def word_weights(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different word hashes of each text, text by text, their counts, and n + 1 offsets of the texts' words."""
    data = tk.LOWER[data]
    starts, ends, word_offsets = tk.words(data, offsets)
    hashes, text = tk.span_hashes(data, starts, ends), tk.text_of(word_offsets)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return hashes[at], np.diff(np.append(at, len(hashes))), np.searchsorted(text[at], np.arange(len(offsets)))


def signatures(data: np.ndarray, offsets: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """(texts, samples) of uint16; a text without words is all zeros."""
    words, counts, bounds = word_weights(data, offsets)
    out = np.zeros((len(offsets) - 1, samples), np.uint16)
    filled = np.flatnonzero(np.diff(bounds))
    if not len(filled):
        return out
    starts, sizes = bounds[:-1][filled], np.diff(bounds)[filled]
    known, word = np.unique(words, return_inverse=True)
    logs = np.log(counts)
    for j in range(samples):
        r, log_c, b = (d[word] for d in draws(known, j))
        t = np.floor(logs / r + b)
        a = log_c - r * (t - b) - r
        hit = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), sizes))
        first = hit[np.searchsorted(hit, starts)]  # of words of equal a, which are as good as never, that of the least hash
        out[filled, j] = tk.mix(words[first] + tk.mix(t[first].astype(np.int64).view(np.uint64) + np.uint64(_ODD))) >> np.uint64(48)
    return out


def _hex(signature: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in signature.astype(">u2")]


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint): one row per input row, without a shuffle.  Null texts are empty; texts without a word have a fingerprint of zeros."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kernel = lambda part: record(schema, doc_id=part.column(0), fingerprint=_hex(signatures(*tk.text_bytes(part.column(1)), samples)))
    return in_arrow(rows, tk.over_chunks(kernel), "doc_id long, fingerprint string")


def likeness(one: Column, other: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    digits = lambda c, k: F.substring(c, k * SAMPLE_DIGITS + 1, SAMPLE_DIGITS)
    return sum((F.when(digits(one, k) == digits(other, k), 1).otherwise(0) for k in range(samples)), F.lit(0)) / F.lit(samples)


_FOUND = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_EDGES = pa.schema([*_FOUND, ("part", pa.int32()), ("edge", pa.string()), ("text", pa.large_string())])
_FOUND_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, after: str) -> str:
    """`text`, its end replaced by as many code points from the start of `after`, or all of them."""
    n = len(text) // EDIT_DIVISOR
    return text[: len(text) - n] + after[:n]


def _pairs(ids: list, texts: list[str], prints: np.ndarray, samples: int) -> dict:
    """Columns of _FOUND for all texts but the last, each with the one behind it."""
    changed = [edited(t, u) for t, u in zip(texts, texts[1:], strict=False)]
    of_edited = signatures(*tk.text_bytes(pa.array(changed, pa.large_string())), samples)
    mine, after = prints[:-1], prints[1:]
    return {
        "doc_id": ids[:-1], "n_chars": [len(t) for t in texts[:-1]], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed], "fingerprint": _hex(mine), "edited_fingerprint": _hex(of_edited),
        "near_edited": (mine == of_edited).mean(axis=1), "near_next": (mine == after).mean(axis=1),
    }


def _stream(samples: int):
    """Of a partition's rows (doc_id, text) in order: all pairs, and its first and last row as edges."""

    def edge(part: int, kind: str, doc_id, text: str) -> pa.RecordBatch:
        values = {f.name: [None] for f in _EDGES} | {"part": [part], "edge": [kind], "doc_id": [doc_id], "text": [text]}
        return record(_EDGES, **values)

    def run(batches):
        part, ids, texts, prints = TaskContext.get().partitionId(), [], [], np.zeros((0, samples), np.uint16)
        for batch in batches:
            for piece in tk.chunks(batch, "text"):
                if not ids:
                    yield edge(part, "first", piece.column(0)[0].as_py(), piece.column(1)[0].as_py())
                prints = np.concatenate([prints, signatures(*tk.text_bytes(piece.column(1)), samples)])
                ids, texts = ids + piece.column(0).to_pylist(), texts + piece.column(1).to_pylist()
                if len(ids) > 1:
                    found = _pairs(ids, texts, prints, samples)
                    none = [None] * (len(ids) - 1)
                    yield record(_EDGES, **found, part=none, edge=none, text=none)
                    ids, texts, prints = ids[-1:], texts[-1:], prints[-1:]
        if ids:
            yield edge(part, "last", ids[0], texts[0])

    return run


def _joined(samples: int):
    """Of rows (doc_id, text, next_text): their pairs."""

    def run(batches):
        for batch in batches:
            for doc_id, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                both = [text, after]
                yield record(_FOUND, **_pairs([doc_id, None], both, signatures(*tk.text_bytes(pa.array(both, pa.large_string())), samples), samples))

    return run


def next_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): one row per input row.

    The next document is that of the next smaller id; rows of one id are ordered by the hash of their text, rows without an
    id come last, and the first document follows the last one.  A single row is its own next one.  Null texts are empty.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("place"))
    # Rows of one id are dealt by their text, and those of one text too by where they stand, which changes no result.
    keys = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("place")]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    found = staged(in_arrow(ordered, _stream(samples), f"{_FOUND_DDL}, part int, edge string, text string"), "fingerprints")
    # A partition's last row is followed by the first row of the next partition that has any: as many rows as partitions.
    parts = found.where("edge = 'first'").select("part", F.lead("part").over(Window.orderBy("part")).alias("after"), F.min("part").over(Window.partitionBy()).alias("first_part"))
    firsts = found.where("edge = 'first'").select(F.col("part").alias("after"), F.col("text").alias("next_text"))
    lasts = found.where("edge = 'last'").join(parts.select("part", F.coalesce("after", "first_part").alias("after")), "part").join(firsts, "after")
    shared = in_arrow(lasts.select("doc_id", "text", "next_text"), _joined(samples), _FOUND_DDL)
    return found.where("edge is null").select(*_FOUND.names).unionByName(shared)
