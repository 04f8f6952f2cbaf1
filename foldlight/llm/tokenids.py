"""Token ids of documents in Re-Pair compressed shards.

Documents are range partitioned by id and sorted, encoded, and written as shards of about SHARD_IDS ids: Parquet rows
with the grammar, the symbols and the documents' ids and symbol counts as little-endian arrays.  Reading back needs one
row per shard; a document's place in the whole follows from its shard's place and the lengths before it.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldlight.llm import repair
from foldlight.llm import textkernel as tk
from foldlight.llm.common import in_arrow, new_path, record

#: Ids in a shard, about; a longer document has a shard of its own.
SHARD_IDS = 1 << 20
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"

_SHARD = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("base", pa.int32()),
    ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("symbol_counts", pa.binary()),
])
_SHARD_DDL = "part int, shard int, before long, n_ids long, base int, rules binary, lengths binary, symbols binary, doc_ids array<bigint>, symbol_counts binary"


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def _write_shards(path: str, base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from foldlight.llm import bpe

        encoder = bpe.encoder(path)
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        names, ids, counts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, before, names, ids, counts, held
            every, n = np.concatenate(ids), np.concatenate(counts)
            rules, lengths, symbols, symbol_counts = repair.compress(every, n, base)
            out = record(_SHARD, part=[part], shard=[shard], before=[before], n_ids=[len(every)], base=[base], rules=[rules.tobytes()], lengths=[lengths.tobytes()],
                         symbols=[symbols.tobytes()], doc_ids=[[x for a in names for x in a.to_pylist()]], symbol_counts=[symbol_counts.astype(np.uint32).tobytes()])
            shard, before = shard + 1, before + len(every)
            names, ids, counts, held = [], [], [], 0
            return out

        for batch in batches:
            for piece in tk.chunks(batch, "text"):
                found, offsets = encoder.encode(*tk.text_bytes(piece.column(1)))
                # The end id behind each document.
                n = np.diff(offsets) + 1
                whole = np.full(len(found) + len(n), END_ID, np.uint32)
                inside = np.ones(len(whole), bool)
                inside[np.cumsum(n) - 1] = False
                whole[inside] = found
                names.append(piece.column(0)), ids.append(whole), counts.append(n)
                held += len(whole)
                if held >= SHARD_IDS:
                    yield flush()
        if held:
            yield flush()

    return run


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", base: int = 1 << 17) -> None:
    """Encodes every text and writes shards to `path`, in ascending order of id.

    Null texts are empty: the end id alone.  Rows without an id come last; rows of one id are ordered by text.
    `base`: the first nonterminal, above all ids of the vocabulary.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc()]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # The first characters split the rows of one id, or without one, over partitions in the order of their texts.
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_last(), F.substring("text", 1, 64).asc()).sortWithinPartitions(*order)
    in_arrow(ordered, _write_shards(vocabulary or default_vocabulary(), base), _SHARD_DDL).write.option("compression", "zstd").parquet(path)


def _shard_arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    read = lambda k: np.frombuffer(row[k], np.uint32)
    return read("rules").reshape(-1, 2), read("lengths"), read("symbols"), read("symbol_counts").astype(np.int64)


_DOC = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {f.name: batch.column(k)[i].as_py() if f.name != "doc_ids" else None for k, f in enumerate(batch.schema)}
            rules, lengths, symbols, counts = _shard_arrays(row)
            ids = repair.expand(symbols, rules, lengths, row["base"])
            size = np.where(symbols < row["base"], 1, lengths[np.maximum(symbols.astype(np.int64) - row["base"], 0)] if len(lengths) else 1)
            n = tk.sums(size, np.concatenate([[0], np.cumsum(counts)]))
            ends = np.cumsum(n)
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
            names = pc.list_flatten(batch.column(batch.schema.get_field_index("doc_ids")).slice(i, 1))
            yield record(_DOC, doc_id=names, start=row["place"] + ends - n, n_tokens=n, ids_crc32=np.array(crc, np.int64))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the shards at `path`.

    start: ids of all documents before; ids_crc32: over the ids as little-endian unsigned 32-bit integers.
    """
    shards = spark.read.schema(_SHARD_DDL).parquet(path)
    # One row per written partition, a number that does not follow the data: ordered in one task and broadcast.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    upto = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = shards.join(F.broadcast(parts.select("part", F.coalesce(upto, F.lit(0)).alias("part_start"))), "part")
    needed = placed.select(F.expr("part_start + before").alias("place"), "base", "rules", "lengths", "symbols", "doc_ids", "symbol_counts")
    return in_arrow(needed, _documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encoded_documents(docs: DataFrame, what: str = "token-ids", vocabulary: str | None = None) -> DataFrame:
    """Writes the shards of `docs` in the shared folder and reads the documents back from them."""
    path = new_path(docs.sparkSession, what)
    write_ids(docs, path, vocabulary)
    return read_documents(docs.sparkSession, path)
