"""Line dedup: range-partitioned line hashes, first occurrences streamed, per-document bitmaps returned instead of text.

A line's key is the line without blanks at its ends, A-Z in lower case; two 64-bit hashes stand for it.  Hashes are range
partitioned and sorted by document and position, so a key's first row names the document that keeps it.  A 2^20-bucket
histogram of the hashes finds buckets over a share of all lines (at most 4,096 of them, so that list is broadcast); their
keys are resolved by partial aggregation and a join instead, which no hot line can unbalance.  DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlight.llm.common import staged

MIN_KEY_CHARS = 10
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A hash bucket is hot beyond this share of all lines (and HOT_LEAST lines): there are at most HOT_SHARE such buckets.
HOT_SHARE = 4096
HOT_LEAST = 1000
#: Stands for a missing id, after all others: rows without an id count as one document.
LAST_ID = (1 << 63) - 1


def line_key(line: Column) -> Column:
    bare = F.trim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_KEY_CHARS) -> DataFrame:
    """(id, row, pos, h1, h2) for each line whose key has at least `least` code points; row: the hash of the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), text.alias("text"))
    # The text is hashed before its lines are told apart: beside them it would be hashed for each line.
    each = rows.withColumn("row", F.xxhash64("text")).select("id", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = each.select("id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least)
    return keyed.select("id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped_lines(lines: DataFrame) -> DataFrame:
    """(id, row, pos) of the lines whose key a smaller id holds too."""
    lines = lines.withColumn("bucket", F.shiftrightunsigned("h1", 44))
    counts = staged(lines.groupBy("bucket").count(), "line-buckets")
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("count") > max(HOT_LEAST, total / HOT_SHARE)).select("bucket"))
    cold = lines.join(hot, "bucket", "left_anti").select("id", "row", "pos", "h1", "h2").repartitionByRange("h1", "h2")
    stream = Window.partitionBy("h1", "h2").orderBy("id", "row", "pos")
    cold = cold.withColumn("first_id", F.first("id").over(stream))
    hot_lines = lines.join(hot, "bucket", "left_semi").select("id", "row", "pos", "h1", "h2")
    firsts = hot_lines.groupBy("h1", "h2").agg(F.min("id").alias("first_id"))
    both = cold.unionByName(hot_lines.join(firsts, ["h1", "h2"]))
    return both.where("id <> first_id").select("id", "row", "pos")


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_KEY_CHARS) -> DataFrame:
    """(id, row, n_dropped, drops): per document and text, the words of its bitmap in order: (word, bits), bit i of a word is line 64 word + i.

    Words without a drop are left out (the compression), as are documents without one.
    """
    lines = staged(line_hashes(docs, id_col, text_col, least), "line-hashes")
    words = dropped_lines(lines).groupBy("id", "row", F.expr("pos div 64").cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    return words.groupBy("id", "row").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("drops"), F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"))


#: SQL: the words of `drops` up to the last one, those left out as zeros, so that a line's bit is looked up by position.
_WORDS = "flatten(transform(drops, (d, k) -> concat(array_repeat(0L, d.word - if(k = 0, 0, drops[k - 1].word + 1)), array(d.bits))))"
_KEPT = f"""array_join(element_at(transform(array({_WORDS}), words -> filter(split(text, '\\n', -1), (l, i) -> (shiftright(coalesce(get(words, cast(i div 64 as int)), 0L), i % 64) & 1L) = 0L)), 1), '\\n')"""


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_KEY_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): one row per input row, with the text of its remaining lines.

    Null and empty texts are one empty line.  Rows without an id are one document that comes after all others; rows of
    one id are one document, so none takes lines from another.  Lines repeated within the first document all stay.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), text.alias("text"))
    rows = rows.withColumn("row", F.xxhash64("text"))
    bitmaps = drop_bitmaps(docs, id_col, text_col, least)
    joined = rows.join(bitmaps.hint("shuffle_hash"), ["id", "row"], "left")
    n_lines = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return joined.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.expr(_KEPT)).alias("kept"))


ORACLE = r"""
WITH lines AS (
  SELECT coalesce(doc_id, 9223372036854775807) AS id, doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), firsts AS (
  SELECT key, min(id) AS first_id FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT id) >= 2
), marked AS (
  SELECT l.*, coalesce(f.first_id <> l.id, false) AS gone FROM lines l LEFT JOIN firsts f ON l.key = f.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
