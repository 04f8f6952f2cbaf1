"""Fill-in-the-middle: a document's units are cut in prefix, middle and suffix, and put out in another order between marks.

A pandas UDF over Arrow batches: finditer of the regex library collects the ends of the units in a compact array, so that
two look-ups give the cuts and slices the parts; hashlib gives the seeds and the digests.  Rows are transformed one by
one: no shuffle.  The output holds no mark but the three put in (texts with marks stay as they are), so text and form
come back from it exactly.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlight.llm.common import bounded_batches, unused

#: Marks of prefix, suffix and middle. None can overlap another: each begins with its only `<` and ends with its only `>`.
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
UNIT = regex.compile(r"[^\n]*\n|[^\n]+")
SEED = 7
#: Of a hundred documents: how many are transformed, and how many of these have the suffix first.
RATE_PERCENT, SPM_PERCENT = 100, 50

_CUT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"
_RESTORED = "restored string, restored_sha256 string"


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def unit_ends(text: str) -> array:
    """Code points up to the end of each line."""
    return array("i", (m.end() for m in UNIT.finditer(text)))


def transform(key: str, text: str, rate: int = RATE_PERCENT, spm: int = SPM_PERCENT) -> tuple:
    """(units, form, prefix's and middle's code points or None, output) of a text with this seed key."""
    ends = unit_ends(text)
    n = len(ends)
    digest = _sha256(key)
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or h3 % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restore(output: str, form: str) -> str:
    """The text that `transform` made this output of."""
    if form == "plain":
        return output
    second, third = output.index(PREFIX if form == "spm" else SUFFIX), output.index(MIDDLE)
    one, two, middle = output[len(SUFFIX) : second], output[second + len(PREFIX) : third], output[third + len(MIDDLE) :]
    return two + middle + one if form == "spm" else one + middle + two


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, output_sha256): one row per input row.

    The seed key is `seed:` and the decimal id; rows without an id take `seed:text:` and their text, so reruns agree.  Rows
    of one id are cut by the same numbers.  Null texts are empty; empty texts and texts that hold a mark stay as they are
    (form plain, the counts of code points null).  Further columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(_CUT)
    def cut(key: pd.Series, text: pd.Series) -> pd.DataFrame:
        found = [transform(k, t, rate, spm) for k, t in zip(key, text, strict=True)]
        n, form, prefix, middle, output = zip(*found, strict=True) if found else ((),) * 5
        lengths = {"prefix_chars": pd.array(prefix, "Int64"), "middle_chars": pd.array(middle, "Int64")}
        return pd.DataFrame({"n": n, "form": form, **lengths, "output": output, "output_sha256": [_sha256(o) for o in output]})

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), text)))
    return docs.select(F.col(id_col).alias("doc_id"), cut(key, text).alias("cut")).select("doc_id", "cut.*")


def restore_texts(found: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """`found` with (restored, restored_sha256): the exact text of each output, and its digest."""
    bounded_batches(found.sparkSession)

    @F.pandas_udf(_RESTORED)
    def back(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        texts = [restore(o, f) for o, f in zip(outputs, forms, strict=True)]
        return pd.DataFrame({"restored": texts, "restored_sha256": [_sha256(t) for t in texts]})

    name = unused(found, "back")
    return found.withColumn(name, back(F.col(output), F.col(form))).select(*[F.col(f"`{c}`") for c in found.columns], f"{name}.*")


#: The digests in DuckDB's SQL: cuts from lists of lines, restored by the parts that the marks divide.
ORACLE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || doc_id::VARCHAR) AS seed FROM documents
), drawn AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n, ('0x' || seed[1:8])::BIGINT AS h1, ('0x' || seed[9:16])::BIGINT AS h2, ('0x' || seed[17:24])::BIGINT AS h3, ('0x' || seed[25:32])::BIGINT AS h4 FROM docs
), cut AS (
  SELECT doc_id, text, n, array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix, array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
    array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:n], '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), made AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN split_part(split_part(output, '<S>', 1), '<P>', 2) || split_part(output, '<M>', 2) || split_part(split_part(output, '<M>', 1), '<S>', 2)
    ELSE split_part(split_part(output, '<M>', 1), '<P>', 2) || split_part(output, '<M>', 2) || split_part(split_part(output, '<P>', 1), '<S>', 2) END) AS restored_sha256
FROM made
"""
