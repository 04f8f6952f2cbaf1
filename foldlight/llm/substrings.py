"""Substring dedup by level-wise doubling.

A window of `window` words is removed if its word sequence starts earlier too.  Levels halve the window down to
LEAST_LEVEL words or more.  The first level looks at seeds: of the places in a window where a first-level window can
start so that its doublings stay inside, the one of least hash.  Equal windows have equal seeds at equal offsets, so
seeds lose no repeat, and there are about 2 / (window / 2 + 2) of them a word.  Seeds whose hash is repeated, and only
these, are extended to twice the length, until the last level, where each seed stands for the windows that chose it.
There every seed is compared with the first one of equal words; only windows that differ from it there (they repeat
elsewhere or not at all) are grouped by their own hash.

Repeats are counted by partial aggregation, and rows are joined to the counts by sort-merge joins that Spark can split
where a seed is in a third of all documents.  Each step's result is written to the shared folder, so that shuffle files
of finished steps can go.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlight.llm import textkernel as tk
from foldlight.llm.common import discard, in_arrow, record, release, staged

WINDOW = 20
LEAST_LEVEL = 10
#: Stands for a missing id, after all others.
LAST_ID = (1 << 63) - 1


def levels(window: int, least: int = LEAST_LEVEL) -> list[int]:
    """Lengths from the first level to the window, each half of the next."""
    out = [window]
    while out[0] % 2 == 0 and out[0] // 2 >= least:
        out.insert(0, out[0] // 2)
    return out


def _lengths(word_hashes: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    out = {lengths[0]: tk.window_hashes(word_hashes, lengths[0])}
    for n in lengths[1:]:
        out[n] = tk.doubled(out[n // 2], n // 2)
    return out


def _seeds(hashes: dict[int, np.ndarray], word_offsets: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Windows (start words) inside one text, and the seed that each chooses."""
    window = lengths[-1]
    n = len(hashes[window])
    total = int(word_offsets[-1])
    starts = np.flatnonzero(tk.window_mask(word_offsets, total, window)) if n else np.zeros(0, np.int64)
    places = window // 2 + 1 if len(lengths) > 1 else 1
    first = hashes[lengths[0]]
    least, reach = first[:n], 1
    while reach < places:  # least of first[i : i + reach], reach growing to places
        step = min(reach, places - reach)
        wider = first if reach == 1 else least
        most = len(wider) - step
        least, reach = np.minimum(wider[:most], wider[step : step + most]), reach + step
    seed = np.full(len(starts), -1, np.int64)
    for offset in range(places):
        hit = (seed < 0) & (first[starts + offset] == least[starts])
        seed[hit] = starts[hit] + offset
    return starts, seed


def repeated_ids(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id): ids that more than one row has; a missing id is LAST_ID.  Staged: how many there are decides how Spark joins them."""
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"))
    return staged(ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated-ids")


def _texts(docs: DataFrame, repeated: DataFrame | None, id_col: str, text_col: str) -> DataFrame:
    """(id, row, text, doc_id); row tells the texts of one id apart: their hash where an id is repeated, else 0 (which costs nothing
    in a shuffle)."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    if repeated is None:
        return rows.select("id", F.lit(0).cast("long").alias("row"), "text", "doc_id")
    marked = rows.join(repeated.withColumn("again", F.lit(True)), "id", "left")
    return marked.select("id", F.when(F.col("again"), F.xxhash64("text")).otherwise(0).cast("long").alias("row"), "text", "doc_id")


_PLACED = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("row", pa.int64()), ("at", pa.int64())])
_EXTENDED = pa.schema([*_PLACED, ("first", pa.bool_()), ("mask", pa.int64()), ("hashes", pa.list_(pa.int64()))])
_PLACED_DDL = "h long, id long, row long, at long"


def _prepare(part: pa.RecordBatch, lengths: list[int]):
    data, offsets = tk.text_bytes(part.column(2))
    starts, ends, word_offsets = tk.words(data, offsets)
    hashes = _lengths(tk.span_hashes(data, starts, ends), lengths)
    return hashes, word_offsets, *_seeds(hashes, word_offsets, lengths)


def _places(part: pa.RecordBatch, word_offsets: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray]:
    """The ids, rows and positions of words of a chunk."""
    text = np.searchsorted(word_offsets, words, "right") - 1
    return {"id": part.column(0).to_numpy()[text], "row": part.column(1).to_numpy()[text], "at": words - word_offsets[text]}


def _marked(part: pa.RecordBatch, word_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that `marks` (position * 2 + flag) names, and their flags, ordered by word."""
    marks = pc.fill_null(part.column(3), [])
    flat = pc.list_flatten(marks).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(part.num_rows), pc.list_value_length(marks).to_numpy(zero_copy_only=False))
    word = word_offsets[text] + (flat >> 1)
    order = np.argsort(word, kind="stable")
    return word[order], (flat[order] & 1).astype(bool)


def _scan(lengths: list[int]):
    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes, word_offsets, _, seed = _prepare(part, lengths)
        words = np.unique(seed)
        return record(_PLACED, h=hashes[lengths[0]][words].view(np.int64), **_places(part, word_offsets, words))

    return kernel


def _rescan(lengths: list[int], level: int):
    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes, word_offsets, _, _ = _prepare(part, lengths)
        words, _ = _marked(part, word_offsets)
        return record(_PLACED, h=hashes[level][words].view(np.int64), **_places(part, word_offsets, words))

    return kernel


def _extend(lengths: list[int]):
    """Per surviving seed: its last but one level's hash, and the hashes of the windows that chose it, by offset."""

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch | None:
        hashes, word_offsets, windows, seed = _prepare(part, lengths)
        words, first = _marked(part, word_offsets)
        if not len(words):
            return None
        slot = np.minimum(np.searchsorted(words, seed), len(words) - 1)
        mine = words[slot] == seed
        windows, seed, slot = windows[mine], seed[mine], slot[mine]
        order = np.lexsort((seed - windows, slot))  # by offset
        windows, seed, slot = windows[order], seed[order], slot[order]
        mask = np.bincount(slot, weights=np.ldexp(1.0, (seed - windows).astype(np.int32)), minlength=len(words)).astype(np.int64)
        counts = np.bincount(slot, minlength=len(words))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(hashes[lengths[-1]][windows].view(np.int64)))
        last = hashes[lengths[-2] if len(lengths) > 1 else lengths[-1]][words].view(np.int64)
        return record(_EXTENDED, h=last, first=first, mask=mask, hashes=lists, **_places(part, word_offsets, words))

    return kernel


def _repeats(placed: DataFrame) -> DataFrame:
    """(id, row, marks): the places of hashes found twice or more; a mark's flag tells the first place of its hash."""
    placed = staged(placed, "seeds")
    counted = placed.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("id", "row", "at")).alias("first"))
    counted = staged(counted.where("n > 1").select("h", F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row"), F.col("first.at").alias("first_at")), "repeated")
    flag = F.expr("cast(id = first_id and row = first_row and at = first_at as long)")
    found = placed.join(counted, "h").select("id", "row", (F.col("at") * 2 + flag).alias("mark"))
    out = staged(found.groupBy("id", "row").agg(F.collect_list("mark").alias("marks")), "marks")
    discard(placed, counted)
    return out


def _with_marks(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """Texts that have marks; marks are the smaller side and are built into a hash table a partition."""
    return texts.join(marks.hint("shuffle_hash"), ["id", "row"]).select("id", "row", "text", "marks")


def _free(spark) -> None:
    gc.collect()
    release(spark)


def _differing(batches):
    """Bits of `mask` whose window equals the first seed's at that offset, and the hashes of the other windows."""
    schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("at", pa.int64()), ("same", pa.int64()), ("other", pa.list_(pa.int64())), ("other_offsets", pa.list_(pa.int64()))])
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        get = lambda k, b=batch: b.column(b.schema.get_field_index(k))

        def flat(mask: str, hashes: str, get=get, n=n):
            bits = get(mask).to_numpy()
            values = pc.list_flatten(get(hashes)).to_numpy(zero_copy_only=False)
            rows, offsets = [], []
            for o in range(int(bits.max()).bit_length()):
                at = np.flatnonzero((bits >> o) & 1)
                rows.append(at), offsets.append(np.full(len(at), o))
            rows, offsets = np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*offsets, np.zeros(0, np.int64)])
            order = np.lexsort((offsets, rows))
            return rows[order], offsets[order], values

        rows, offsets, values = flat("mask", "hashes")
        first_rows, first_offsets, first_values = flat("first_mask", "first_hashes")
        key, first_key = rows * 64 + offsets, first_rows * 64 + first_offsets
        slot = np.minimum(np.searchsorted(first_key, key), max(len(first_key) - 1, 0))
        same = (first_key[slot] == key) & (first_values[slot] == values) if len(first_key) else np.zeros(len(key), bool)
        bits = np.bincount(rows[same], weights=np.ldexp(1.0, offsets[same].astype(np.int32)), minlength=n).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(np.bincount(rows[~same], minlength=n))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[~same].astype(np.int64))) for x in (values, offsets)]
        yield record(schema, id=get("id"), row=get("row"), at=get("at"), same=bits, other=lists[0], other_offsets=lists[1])


def repeated_windows(texts: DataFrame, window: int = WINDOW, least: int = LEAST_LEVEL) -> DataFrame:
    """(id, row, seeds): per text of (id, row, text), (place of a seed, bits): bit o is set if the window o words before the seed starts earlier too."""
    spark = texts.sparkSession
    lengths = levels(window, least)
    if window // 2 + 1 > 60:
        raise ValueError("windows of more than 118 words are not supported")
    marks = _repeats(in_arrow(texts, tk.over_chunks(_scan(lengths)), _PLACED_DDL))
    _free(spark)
    for level in lengths[1:-1]:
        before, marks = marks, _repeats(in_arrow(_with_marks(texts, marks), tk.over_chunks(_rescan(lengths, level)), _PLACED_DDL))
        discard(before)
        _free(spark)
    extended = staged(in_arrow(_with_marks(texts, marks), tk.over_chunks(_extend(lengths)), _PLACED_DDL + ", first boolean, mask long, hashes array<long>"), "extended")
    discard(marks)
    _free(spark)
    firsts = extended.where("first").select("h", F.col("mask").alias("first_mask"), F.col("hashes").alias("first_hashes"))
    later = extended.where("not first").select("h", "id", "row", "at", "mask", "hashes")
    compared = later.join(firsts, "h").select("id", "row", "at", "mask", "hashes", "first_mask", "first_hashes")
    compared = staged(in_arrow(compared, _differing, "id long, row long, at long, same long, other array<long>, other_offsets array<long>"), "compared")
    discard(extended)
    _free(spark)
    others = compared.where("size(other) > 0").select("id", "row", "at", F.explode(F.arrays_zip("other", "other_offsets")).alias("w")).select("id", "row", "at", F.col("w.other").alias("h"), F.col("w.other_offsets").alias("o"))
    place = F.struct("id", "row", (F.col("at") - F.col("o")).alias("start"))
    firsts = staged(others.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("h", F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row"), F.col("first.start").alias("first_start")), "others")
    more = others.join(firsts, "h").where("id <> first_id or row <> first_row or at - o <> first_start").select("id", "row", "at", F.expr("shiftleft(1L, cast(o as int))").alias("bits"))
    every = compared.where("same <> 0").select("id", "row", "at", F.col("same").alias("bits")).unionByName(more)
    out = staged(every.groupBy("id", "row").agg(F.collect_list(F.struct("at", "bits")).alias("seeds")), "windows")
    discard(compared, firsts)
    _free(spark)
    return out


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.large_string())])


def _keep(window: int):
    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = tk.text_bytes(part.column(0))
        starts, ends, word_offsets = tk.words(data, offsets)
        at = pc.list_flatten(pc.fill_null(part.column(2), [])).to_numpy(zero_copy_only=False)
        bits = pc.list_flatten(pc.fill_null(part.column(3), [])).to_numpy(zero_copy_only=False)
        text = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(part.column(2)), 0).to_numpy(zero_copy_only=False))
        seed = word_offsets[text] + at
        begins = [seed[((bits >> o) & 1).astype(bool)] - o for o in range(window // 2 + 1)]
        gone = tk.covered(np.concatenate(begins), window, len(starts))
        # Kept words' bytes, each but a text's last with a blank behind it.
        starts, ends = starts[~gone], ends[~gone]
        removed = tk.sums(gone, word_offsets)
        kept_offsets = word_offsets - np.concatenate([[0], np.cumsum(removed)])
        sizes = ends - starts + 1
        to = np.cumsum(sizes)
        joined = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
        joined[np.arange(len(joined))] = data[np.minimum(np.repeat(starts - (to - sizes), sizes) + np.arange(len(joined)), max(len(data) - 1, 0))] if len(data) else joined
        joined[to - 1] = 0x20
        bounds = np.concatenate([[0], to])[kept_offsets]
        # The blank behind a text's last word goes.
        last = np.zeros(len(joined), bool)
        last[bounds[1:][np.diff(bounds) > 0] - 1] = True
        bounds = bounds - np.concatenate([[0], np.cumsum(np.diff(bounds) > 0)])
        kept = pa.LargeStringArray.from_buffers(part.num_rows, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(joined[~last].tobytes()))
        return record(_KEPT, doc_id=part.column(1), n_words=np.diff(word_offsets), n_removed=removed, kept=kept)

    return kernel


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, least: int = LEAST_LEVEL) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): one row per input row; kept: the remaining words joined by one space.

    Null and empty texts have no words.  Rows without an id come after all others; different texts of one id (or without one)
    are documents of their own, ordered by a 64-bit hash of the text.  Equal texts of one id, or without one, are one text:
    none takes words from the other.
    """
    repeated = repeated_ids(docs, id_col)
    texts = _texts(docs, None if repeated.isEmpty() else repeated, id_col, text_col)
    windows = repeated_windows(texts.drop("doc_id"), window, least)
    joined = texts.join(windows.hint("shuffle_hash"), ["id", "row"], "left")
    out = joined.select("text", "doc_id", F.col("seeds.at").alias("at"), F.col("seeds.bits").alias("bits"))
    return in_arrow(out, tk.over_chunks(_keep(window)), "doc_id long, n_words long, n_removed long, kept string")


#: The query's digest in DuckDB's SQL; ids are taken as unique and present.
ORACLE = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, len(w)::BIGINT AS n_words FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM texts
), later AS (
  SELECT doc_id, pos, 1 AS hit FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY gram ORDER BY doc_id, pos) AS nth
    FROM (SELECT doc_id, unnest(range(1, n_words - 18)) AS pos, md5(array_to_string(list_slice(w, pos, pos + 19), ' ')) AS gram FROM texts WHERE n_words >= 20)) WHERE nth > 1
), marked AS (
  SELECT doc_id, pos, word, max(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM words LEFT JOIN later USING (doc_id, pos)
), kept AS (
  SELECT doc_id, count(*) FILTER (gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS text FROM marked GROUP BY doc_id
)
SELECT t.doc_id, n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""
