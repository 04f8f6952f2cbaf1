"""Mixing sources to target weights with hash-threshold histograms.

Each document has a fixed hash; a source's part of the mix is every document up to a hash threshold, so a smaller budget
takes a subset of a larger one.  The threshold comes from sums by (source, leading hash bits): the bucket in which the
budget ends is found, and only that bucket is summed again by further bits, until it cannot be divided.  Nothing is
sorted but a source's bucket sums (at most 2^BUCKET_BITS rows).  DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlight.llm.common import staged, unused

#: Bits of the hash, and the bits by which each level divides a bucket.
HASH_BITS = 60
BUCKET_BITS = 12
#: Weights of the sources in code point order, repeating; words asked for; the most repeats of a document.
WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_REPEATS = 2
WORD = r"[^\x20\x09-\x0D]+"


def document_hash(doc_id: Column, text: Column) -> Column:
    """The leading 60 bits of md5 over the id's decimal text; without an id, over `text:` and the text."""
    named = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text.cast("string"), F.lit(""))))
    return F.conv(F.substring(F.md5(named), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target): one row per source; null is a source of its own, the last.

    sum(min(cap, weight * level)) = share * all sizes is solved for the level by ordering the sources by cap / weight: the
    fixed point of resharing what stands above a cap.  One row per source is ordered in one task; there are as many rows
    as sources, however many documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    caps = by_source.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    ordered = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    everything = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = caps.withColumn("level", level)
    first_free = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)
    solved = levels.withColumn("free", first_free["level"])
    return solved.select("source", "source_size", F.when(F.col("free").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("free") * F.col("weight"))).alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, full, threshold): every document is taken `full` times, and once more if hash <= threshold."""
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = targets.withColumn("full", full).withColumn("need", F.col("target") - F.col("full") * F.col("source_size"))
    # Per source: the prefix of the boundary bucket, and the words of the documents below it.
    state = staged(state.withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")), "mix-level")
    for left in range(HASH_BITS - BUCKET_BITS, -1, -BUCKET_BITS):
        inside = sized.alias("d").join(state.alias("s"), F.expr(f"d.source <=> s.source and shiftright(d.hash, {left + BUCKET_BITS}) = s.prefix"))
        sums = inside.groupBy(F.col("d.source").alias("source"), F.expr(f"shiftright(d.hash, {left})").alias("bucket")).agg(F.sum("d.size").alias("words"))
        ordered = Window.partitionBy("source").orderBy("bucket")
        upto = sums.withColumn("upto", F.sum("words").over(ordered))
        # The boundary: the first bucket with which the need is met, else the last one.
        met = upto.alias("b").join(state.alias("s"), F.expr("b.source <=> s.source")).select(
            "s.*", F.col("b.bucket").alias("bucket"), F.col("b.words").alias("words"), (F.col("s.below") + F.col("b.upto")).alias("reached"))
        edge = met.groupBy("source", "source_size", "target", "full", "need").agg(
            F.coalesce(F.min(F.when(F.col("reached") >= F.col("need"), F.struct("bucket", "words", "reached"))), F.max(F.struct("bucket", "words", "reached"))).alias("e"))
        state = staged(edge.select("source", "source_size", "target", "full", "need", F.col("e.bucket").alias("prefix"), (F.col("e.reached") - F.col("e.words")).alias("below"), F.col("e.words").alias("edge")), "mix-level")
    # The boundary is one hash now: take it if that comes nearer to the need than leaving it.
    take = F.abs(F.col("below") + F.col("edge") - F.col("need")) < F.abs(F.col("need") - F.col("below"))
    return state.select("source", "source_size", "target", "full", F.when(take, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("threshold"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return staged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), document_hash(F.col(id_col), F.col(text_col)).alias("hash")), "mix-sizes")


def _times(doc_hash: Column) -> Column:
    return F.col("t.full") + F.when(doc_hash <= F.col("t.threshold"), 1).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, times): one row per input row; taken = times * size, times <= `most`.

    Null texts have size 0.  Equal ids have equal hashes: their rows are taken together, as are equal texts without an id.
    An empty table gives no rows.  Each source's taken words differ from its target by less than the documents at its
    threshold hold.  Reruns agree, since the hash depends on the row alone.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    found = thresholds(sized, source_targets(sized, weights, share, most))
    times = _times(F.col("d.hash"))
    joined = sized.alias("d").join(found.alias("t"), F.expr("d.source <=> t.source"))
    return joined.select("d.doc_id", "d.source", "d.size", "t.source_size", "t.target", (F.col("d.size") * times).cast("long").alias("taken"), times.cast("long").alias("times"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """The rows of the mix, columns of `docs` kept: each row as often as `mix` takes it.  See there for nulls and ties."""
    sized = _sized(docs, id_col, text_col, source_col)
    found = thresholds(sized, source_targets(sized, weights, share, most))
    hash_, times, copy = unused(docs, "hash"), unused(docs, "times"), unused(docs, "copy")
    rows = docs.withColumn(hash_, document_hash(F.col(id_col), F.col(text_col))).alias("d")
    joined = rows.join(found.alias("t"), F.col(f"d.`{source_col}`").cast("string").eqNullSafe(F.col("t.source")))
    kept = joined.select(*[F.col(f"d.`{c}`") for c in docs.columns], _times(F.col(f"d.{hash_}")).cast("int").alias(times)).where(F.col(times) > 0)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).drop(copy)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))), 1, 15) AS BIGINT) AS hash
  FROM {docs}
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM sources
), leveled AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM sources)
     - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / ((SELECT sum(weight) FROM ranked) - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM ranked
), solved AS (
  SELECT source, source_size, weight, cap, (SELECT arg_min(level, cap / weight) FROM leveled WHERE cap > level * weight) AS free FROM leveled
), targets AS (
  SELECT source, source_size, CASE WHEN free IS NULL THEN cap ELSE least(cap, free * weight) END AS target FROM solved
), needs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS full_times FROM targets
), hashed AS (
  SELECT s.source, hash, sum(size) AS words FROM sized s GROUP BY ALL
), running AS (
  SELECT h.source, h.hash, h.words, n.target - n.full_times * n.source_size AS need,
         sum(h.words) OVER (PARTITION BY h.source ORDER BY h.hash) AS reached
  FROM hashed h JOIN needs n ON h.source IS NOT DISTINCT FROM n.source
), edge AS (
  SELECT source, coalesce(min(hash) FILTER (reached >= need), max(hash)) AS hash FROM running GROUP BY source
), cut AS (
  SELECT r.source, CASE WHEN abs(reached - need) < abs(need - (reached - words)) THEN r.hash ELSE r.hash - 1 END AS threshold
  FROM running r JOIN edge e ON r.source IS NOT DISTINCT FROM e.source AND r.hash = e.hash
)
SELECT s.doc_id, s.source, s.size, n.source_size, n.target,
       CAST(s.size * (n.full_times + CASE WHEN s.hash <= c.threshold THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(n.full_times + CASE WHEN s.hash <= c.threshold THEN 1 ELSE 0 END AS BIGINT) AS times
FROM sized s JOIN needs n ON s.source IS NOT DISTINCT FROM n.source JOIN cut c ON s.source IS NOT DISTINCT FROM c.source
"""
