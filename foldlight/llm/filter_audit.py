"""Filter interaction audit: what each filter removes after every set of others, in every order of the filters.

Filters only look at the document, so what a step of an order does depends on the set of filters applied before it and on
its own filter: an edge of the lattice of subsets.  Five filters have 80 edges, however many of the 600 steps of their 120
orders pass over one.  Documents are counted by part and mask of failed filters first; each count then goes to the edges,
and the aggregated edges are joined with the steps, a table of fixed size.  DataFrame operations only.

The text-identity filter needs no join of documents: copies of a text fail the same other filters, so documents are counted
by (digest, part, labels) with their least id, and per digest only the rows of the least id pass.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlight.llm.common import staged

#: Thresholds of the filters: words; percent of words that are distinct; percent of code points that are A-Z; signs.
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SIGNS = 50, 65, 5, "[#$%&*|]"
#: Letters of the filters in bit order; the last one is text identity.
LETTERS = "ABCDE"
BLANKS = "\t\n\x0b\x0c\r"
#: Stands for a missing id, after all others.
LAST_ID = (1 << 63) - 1
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions of A to D, by letter; `text` is not null."""
    words = F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " ", -1), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < MIN_WORDS,
        "B": 100 * distinct.cast("long") < DISTINCT_PERCENT * n.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > UPPER_PERCENT * F.char_length(text).cast("long"),
        "D": text.rlike(SIGNS),
    }


def _mask(failures: Mapping[str, Column], letters: str) -> Column:
    out = F.lit(0)
    for letter, fails in failures.items():
        out = out.bitwiseOR(F.when(fails, 1 << letters.index(letter)).otherwise(0))
    return out


def labelled_failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, digest, part, mask, good, toxic): one row per input row, mask over A to D; a missing id is LAST_ID.

    A document is good (toxic) if any of its label rows says so; without a label it is neither.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    facts = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), _mask(text_failures(F.col("text")), LETTERS).alias("mask"))
    # Rows without an id meet no label: they are dealt by their text, not to one task.
    keyed = facts.select(F.col("id").isNotNull().alias("named"), F.coalesce("id", F.xxhash64("digest")).alias("key"), "part", "digest", "mask")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).withColumn("named", F.lit(True))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return keyed.join(known, ["key", "named"], "left").select(F.when(F.col("named"), F.col("key")).otherwise(F.lit(LAST_ID)).alias("id"), "digest", "part", "mask", flag("good"), flag("toxic"))


def mask_counts(rows: DataFrame, identity_bit: int = 1 << LETTERS.index("E")) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters, text identity included; good and toxic: how many of them.

    rows: those of labelled_failures.  A row fails identity if a smaller id has its text; rows of one id do not fail by each other.
    """
    same = ["digest", "part", "mask", "good", "toxic"]
    ids = rows.groupBy("id", *same).agg(F.count("*").alias("times"))
    groups = staged(ids.groupBy(*same).agg(F.sum("times").alias("n"), F.min(F.struct("id", "times")).alias("least")), "copies")
    firsts = groups.groupBy("digest").agg(F.min("least.id").alias("first_id"))
    passing = F.when(F.col("least.id") == F.col("first_id"), F.col("least.times")).otherwise(F.lit(0))
    split = groups.join(firsts, "digest").select("part", "mask", "good", "toxic", F.col("n").alias("all"), passing.alias("first"))
    dealt = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("first").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(identity_bit)).alias("mask"), (F.col("all") - F.col("first")).alias("n"))))
    each = split.select("part", "good", "toxic", dealt.alias("d")).where("d.n > 0")
    count = lambda c: F.sum(F.when(F.col(c), F.col("d.n")).otherwise(0)).alias(c)
    return each.groupBy("part", F.col("d.mask").alias("mask")).agg(F.sum("d.n").alias("n"), count("good"), count("toxic"))


def lattice_edges(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, applied, filter, kept, removed, ...): a row per part and lattice edge: a set of filters, as bits, and one outside of it."""
    every = [(s, 1 << f) for f in range(len(letters)) for s in range(1 << len(letters)) if not s >> f & 1]
    edge = F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter")) for s, f in every]))
    at = counts.select("part", "mask", "n", "good", "toxic", edge.alias("e")).select("part", "mask", "n", "good", "toxic", "e.*")
    reached, fails = F.col("mask").bitwiseAND(F.col("applied")) == 0, F.col("mask").bitwiseAND(F.col("filter")) != 0
    count = lambda where, what, name: F.sum(F.when(where, F.col(what)).otherwise(0)).cast("long").alias(name)
    return at.groupBy("part", "applied", "filter").agg(
        count(reached & ~fails, "n", "kept"), count(reached & fails, "n", "removed"), count(~reached & fails, "n", "redundant"),
        count(F.col("mask") == F.col("filter"), "n", "unique_fails"), count(reached & fails, "good", "good_lost"), count(reached & fails, "toxic", "toxic_lost"),
    )


def order_steps(letters: str = LETTERS) -> list[tuple[str, int, int, int]]:
    """(filter_order, step, applied, filter) of every step of every order."""
    out = []
    for order in permutations(letters):
        applied = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            out.append(("".join(order), step, applied, bit))
            applied |= bit
    return out


def order_audit(edges: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, counts, shapley): the edges along the paths of all orders.

    As many orders pass over an edge as there are orders of the filters before it and of those after it: by that weight the
    removed documents add up to a filter's sum over all orders.
    """
    before = F.bit_count("applied")
    orders = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(len(letters) - 1 - k)) for k in range(len(letters))]), before + 1)
    sums = edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders).cast("long").alias("shapley"))
    steps = edges.sparkSession.createDataFrame(order_steps(letters), "filter_order string, step int, applied int, filter int")
    return edges.join(sums, ["part", "filter"]).join(F.broadcast(steps), ["applied", "filter"]).select("part", "filter_order", "step", *_COUNTS, "shapley")


def interaction_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, counts, shapley): 600 rows per part, zeros included; an empty table gives none.

    Null texts are empty (and identical to empty ones), null parts the empty string.  Rows without an id come after all
    others, so they fail identity by any row with an id and their text, and not by one another.  Rows of one id are
    counted each.  Further columns are ignored.
    """
    edges = staged(lattice_edges(mask_counts(labelled_failures(docs, labels, id_col, text_col, part_col))), "lattice-edges")
    return order_audit(edges)


#: The same in DuckDB's SQL, order by order: each document's first failed step decides.
ORACLE = r"""
WITH RECURSIVE docs AS (
  SELECT d.doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, l.quality = 1 AS good, l.toxic = 1 AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)
), fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END) || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS failed FROM docs
), orders(o) AS (
  SELECT '' UNION ALL SELECT o || f FROM orders, unnest(string_split('ABCDE', '')) AS t(f) WHERE NOT contains(o, f)
), steps AS (
  SELECT o AS filter_order, s::INT AS step, o[s] AS f, o[1:s - 1] AS before FROM orders, range(1, 6) AS r(s) WHERE length(o) = 5
), counted AS (
  SELECT part, good, toxic, failed, count(*) AS n FROM fails GROUP BY ALL
), stepped AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (translate(failed, before || f, '') = failed), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (contains(failed, f) AND translate(failed, before, '') = failed), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (contains(failed, f) AND translate(failed, before, '') <> failed), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (failed = f), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (good AND contains(failed, f) AND translate(failed, before, '') = failed), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (toxic AND contains(failed, f) AND translate(failed, before, '') = failed), 0)::BIGINT AS toxic_lost
  FROM counted, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM stepped
"""
