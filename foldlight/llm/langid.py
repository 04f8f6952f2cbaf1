"""Language identification by Bayesian evidence fusion.

Four pieces of evidence about a row's language are multiplied: the text's likelihood (naive Bayes over byte trigrams),
the language that the markup declares, the one that the address suffix suggests, and a prior for the host.  Host priors
are shrunk towards their domain's, and these towards the whole table's, from grouped counts of what the texts alone say.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlight.llm import textkernel as tk
from foldlight.llm.common import in_arrow, record, staged, unused

#: Hashed trigrams; distinct texts (at most, about) of each language that the model is fitted on.  Every label is a language,
#: of 256 KB in the model.
BUCKETS = 1 << 16
LANGUAGE_ROWS = 5_000
#: Languages whose counts a task holds at once when fitting.
HELD = 64
#: A text's log-likelihood ratio counts as that of at most so many trigrams: neighbouring trigrams are not independent.
TEXT_WEIGHT = 60.0
#: Chance that a declaration (a suffix) names the language of the text.
DECLARED_TRUST, SUFFIX_TRUST = 0.9, 0.8
#: Counts that a parent's distribution is worth in its child's prior.
HOST_STRENGTH, DOMAIN_STRENGTH = 20.0, 50.0
#: Share of a language's trigrams that the model leaves to unseen ones.
UNSEEN = 0.02
MIN_PROBABILITY = 0.5
MIN_TRIGRAMS = 1

#: Bytes as the model sees them: ASCII letters in lower case, other bytes below 0x80 as a blank.
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x61:0x7B] = _LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)
_SCALE = 1 << 12


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at each byte, and whether it counts (inside its text, not two blanks in a row)."""
    seen = _LETTERS[data]
    n = max(len(seen) - 2, 0)
    a, b, c = (seen[i : i + n].astype(np.uint32) for i in range(3))
    bucket = ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F) >> np.uint32(16)
    counts = ~((b == 0x20) & ((a == 0x20) | (c == 0x20)))
    for back in (1, 2):
        at = offsets[1:] - back
        counts[at[(at >= 0) & (at < n)]] = False
    return bucket, counts


def _counts(batches):
    """Trigram counts of a task's texts by label, in parts: a label may come several times."""
    total: dict[str, np.ndarray] = {}

    def flush():
        for label, found in total.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_pydict({"label": pa.array([label] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(found[at])})
        total.clear()

    for batch in batches:
        for part in tk.chunks(batch, "text"):
            data, offsets = tk.text_bytes(part.column(1))
            bucket, counts = trigrams(data, offsets)
            labels = part.column(0).to_pylist()
            names = sorted(set(labels))
            number = np.array(list(map({x: k for k, x in enumerate(names)}.get, labels)))
            row = np.minimum(np.searchsorted(offsets, np.arange(len(bucket)), "right") - 1, len(labels) - 1)
            owner, bucket = number[row[counts]], bucket[counts]
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(len(names) + 1))
            for k, label in enumerate(names):
                if label not in total and len(total) >= HELD:
                    yield from flush()
                mine = bucket[order[cuts[k] : cuts[k + 1]]]
                total[label] = total.get(label, 0) + np.bincount(mine, minlength=BUCKETS)
    yield from flush()


class Model:
    """Languages, and scaled log-probabilities of the trigram buckets in each."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        # A share of each distribution is uniform: unseen trigrams say nothing, however much text a language had.
        shares = [(1 - UNSEEN) * counts[x] / counts[x].sum() + UNSEEN / BUCKETS for x in self.languages]
        self.tables = [np.round(np.log(p) * _SCALE).astype(np.int32) for p in shares]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Trigrams of each text, and its tempered log-likelihood by language (best: 0)."""
        bucket, counts = trigrams(data, offsets)
        ends = np.minimum(offsets, len(bucket))
        n = tk.sums(counts, ends)
        total = np.stack([tk.sums(np.where(counts, t[bucket], 0), ends) for t in self.tables], axis=1) / _SCALE
        weight = TEXT_WEIGHT / (TEXT_WEIGHT + n)
        return n, (total - total.max(axis=1, keepdims=True)) * weight[:, None]


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", rows: int = LANGUAGE_ROWS) -> Model:
    """A model from about `rows` distinct texts at most of each label, chosen by a hash of the text; whole texts count, equal ones once.

    A label with fewer texts has them all, whatever the table's size.  Without labelled rows the model knows no language,
    and every row is rejected.
    """
    known = labelled.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text")).where("label is not null and text is not null")
    known = known.withColumn("hash", F.xxhash64("text"))
    by_label = known.groupBy("label").agg(F.approx_count_distinct("hash").alias("n")).collect()  # one row a language
    if not by_label:
        return Model({})
    limits = [(r["label"], min(1 << 40, int((1 << 40) * rows / max(r["n"], 1)) + 1)) for r in by_label]
    limits = labelled.sparkSession.createDataFrame(limits, "label string, most long")
    chosen = known.join(F.broadcast(limits), "label").where(F.pmod("hash", F.lit(1 << 40)) < F.col("most")).select("label", "text")
    chosen = chosen.distinct()  # copies of a text count once, so that one of them cannot be the sample
    found = in_arrow(chosen, _counts, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    found = found.groupBy("label").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for part in found.toArrow().to_batches():  # a row a language, of at most BUCKETS entries
        for label, bucket, n in zip(*part.columns, strict=True):
            counts[label.as_py()] = full = np.zeros(BUCKETS, np.int64)
            full[bucket.values.to_numpy()] = n.values.to_numpy()
    return Model(counts)


#: Elements whose contents are no text.
_HIDDEN = ("script", "style")
_TAG = re.compile(r"/?[a-z][a-z0-9]*", re.I)
_LANG = re.compile(r"""\blang\s*=\s*["']?([a-z]{2,3})\b""", re.I)


def visible_text(html: str | None) -> tuple[str | None, str | None]:
    """(text outside of tags, comments, scripts and styles; language that the html tag declares) of a page, in linear time.

    Read from `<` to `<`: what does not begin like a tag is text; an element or comment without an end hides the rest.
    """
    if html is None:
        return None, None
    first, *rest = html.split("<")
    out, declared, hidden = [first], None, None
    for piece in rest:
        if hidden == "-->":
            if (at := piece.find("-->")) >= 0:
                hidden = None
                out.append(piece[at + 3 :])
            continue
        tag = _TAG.match(piece)
        name = tag[0].lower() if tag else ""
        if hidden:
            if name != f"/{hidden}":
                continue
            hidden = None
        elif piece.startswith("!--"):
            hidden = "-->" if (at := piece.find("-->", 3)) < 0 else None
            out.append("" if hidden else piece[at + 3 :])
            continue
        elif not tag and piece[:1] not in ("!", "?", "/"):
            out.append("<" + piece)
            continue
        at = piece.find(">")
        if name == "html" and declared is None and (found := _LANG.search(piece, 0, at if at >= 0 else len(piece))):
            declared = found[1].lower()
        if name in _HIDDEN:
            hidden = name
        elif at >= 0:
            out.append(piece[at + 1 :])
    return " ".join(out), declared


_VISIBLE = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.large_string()), ("declared", pa.string())])


def _visible(part: pa.RecordBatch) -> pa.RecordBatch:
    seen = [visible_text(x) for x in part.column(2).to_pylist()]
    return record(_VISIBLE, id=part.column(0), url=part.column(1), text=pa.array([t for t, _ in seen], pa.large_string()), declared=pa.array([d for _, d in seen], pa.string()))


def page_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, text, declared, host, domain, suffix) of raw pages; a null page has a null text and no evidence."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    read = in_arrow(rows, tk.over_chunks(_visible, "html"), "id long, url string, text string, declared string")
    url = F.col("url")
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    domain = F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -2))
    path = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1)
    suffix = F.coalesce(_named(F.lower(path)), _named(F.regexp_extract(host, r"\.([a-z]{2})$", 1)))
    return read.select("id", "text", "declared", _named(host).alias("host"), _named(domain).alias("domain"), suffix.alias("suffix"))


def document_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", declared_col: str | None = None) -> DataFrame:
    """The same of documents: the source stands for the host.  A column with declared languages counts only if it is named: a label
    that the model is fitted on must not come back as evidence."""
    none = F.lit(None).cast("string")
    declared = F.lower(F.col(declared_col).cast("string")) if declared_col else none
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), declared.alias("declared"), F.col(source_col).cast("string").alias("host"), none.alias("domain"), none.alias("suffix"))


def _named(c: Column) -> Column:
    return F.when(c != "", c)


def text_evidence(rows: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """`keep` columns of the rows, with trigrams (long) and loglik (array of doubles, by language)."""
    kept = rows.select(*keep, "text")
    schema = kept.select(*keep).schema.add("trigrams", "long").add("loglik", T.ArrayType(T.DoubleType()))
    bc = rows.sparkSession.sparkContext.broadcast(model)

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        n, scores = bc.value.scores(*tk.text_bytes(part.column(part.num_columns - 1)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * scores.shape[1]), pa.array(scores.ravel()))
        return pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n), lists], names=[*keep, "trigrams", "loglik"])

    return in_arrow(kept, tk.over_chunks(kernel), schema)


def _best(values: Column, languages: Column) -> Column:
    """The language of the greatest value (the first of equals)."""
    return F.get(languages, F.array_position(values, F.array_max(values)).cast("int") - 1)


def fuse(evidence: DataFrame, languages: list[str]) -> DataFrame:
    """Adds text_lang, lang and probability to rows of text_evidence that keep host, domain, declared and suffix."""
    langs = F.array(*[F.lit(x) for x in languages])
    lowered = F.array(*[F.lit(x.lower()) for x in languages])
    n_langs = len(languages)
    alone = F.size(F.filter("loglik", lambda x: x == F.array_max("loglik"))) == 1  # a tie says nothing
    said = evidence.withColumn("text_lang", F.when((F.col("trigrams") >= MIN_TRIGRAMS) & alone, _best(F.col("loglik"), langs)))
    # Counts by (domain, host, language): few rows a task, whatever a host's share of the table.
    counts = staged(said.where("text_lang is not null").groupBy("domain", "host", "text_lang").agg(F.count("*").cast("double").alias("n")), "langid-counts")

    def spread(grouped, parent, strength):
        """Per group: the languages' shares, shrunk towards `parent` (a Column with the parent's shares)."""
        shares = F.array(*[F.coalesce(F.sum(F.when(F.col("text_lang") == x, F.col("n"))), F.lit(0.0)) for x in languages])
        out = grouped.agg(shares.alias("own"))
        total = F.aggregate("own", F.lit(0.0), lambda a, x: a + x)
        return out, F.zip_with("own", parent, lambda x, p: (x + strength * p) / (total + strength))

    # The whole table's shares: one number per language.
    whole = {r["text_lang"]: r["n"] for r in counts.groupBy("text_lang").agg(F.sum("n").alias("n")).collect()}
    everyone = F.array(*[F.lit((whole.get(x, 0.0) + 1 / n_langs) / (sum(whole.values()) + 1)) for x in languages])
    domains, shrunk = spread(counts.where("domain is not null").groupBy("domain"), everyone, DOMAIN_STRENGTH)
    domains = staged(domains.select("domain", shrunk.alias("domain_prior")), "langid-domains")
    hosts, shrunk = spread(counts.where("host is not null").groupBy("domain", "host"), F.coalesce("domain_prior", everyone), HOST_STRENGTH)
    hosts = staged(hosts.join(domains, "domain", "left").select("domain", "host", shrunk.alias("host_prior")), "langid-hosts")
    joined = said.alias("e").join(hosts.alias("h"), F.expr("e.domain <=> h.domain and e.host = h.host"), "left").join(domains.alias("m"), F.expr("e.domain = m.domain"), "left")
    prior = F.coalesce("h.host_prior", "m.domain_prior", everyone)

    def trust(column, share):
        """Log-chance of what `column` (lower case) says, by language; nothing said, or no known language: no evidence."""
        other = float(np.log((1 - share) / max(n_langs - 1, 1))) if n_langs > 1 else 0.0
        return F.when(F.array_contains(lowered, column), F.transform(lowered, lambda x: F.when(x == column, float(np.log(share))).otherwise(other))).otherwise(F.array(*[F.lit(0.0)] * n_langs))

    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = add(add(F.col("loglik"), F.transform(prior, lambda p: F.log(p))), add(trust(F.col("declared"), DECLARED_TRUST), trust(F.col("suffix"), SUFFIX_TRUST)))
    summed = joined.select("e.*", total.alias("total"))
    best = summed.withColumn("lang", F.when(F.col("trigrams") >= MIN_TRIGRAMS, _best(F.col("total"), langs)))
    chance = 1 / F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("total")))
    return best.withColumn("probability", F.when(F.col("lang").isNotNull(), F.round(chance, 6))).drop("total")


def identify(rows: DataFrame, model: Model, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """`keep` columns, trigrams, text_lang, lang, probability, kept; one row per row of document_rows or page_rows.

    Texts with fewer than MIN_TRIGRAMS trigrams of letters (null, empty, signs only) have lang null and are not kept, nor
    is a row whose best language has less than MIN_PROBABILITY.  A host without counts has its domain's prior, a row
    without a host the table's.  Repeated rows and ids are rows like any others.
    """
    if not model.languages:
        return rows.select(*keep, F.lit(0).cast("long").alias("trigrams"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(False).alias("kept"))
    fields = tuple(dict.fromkeys((*keep, "declared", "host", "domain", "suffix")))
    found = fuse(staged(text_evidence(rows, model, fields), "langid-text"), model.languages)
    kept = F.coalesce(F.col("probability") >= MIN_PROBABILITY, F.lit(False))
    return found.select(*keep, "trigrams", "text_lang", "lang", "probability", kept.alias("kept"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` (columns kept) whose language is found.

    A document is told by its id and its text; rows that share both share the verdict.
    """
    key = lambda t: F.xxhash64(F.coalesce(t.cast("string"), F.lit("")))
    rows = document_rows(docs).withColumn("row", key(F.col("text")))
    id_, row = unused(docs, "id"), unused(docs, "row")
    # Staged, so that its size is known where Spark chooses between a broadcast and a shuffle of the documents.
    rejected = staged(identify(rows, model, ("id", "row")).where("not kept").select(F.col("id").alias(id_), F.col("row").alias(row)).distinct(), "langid-rejected")
    return docs.join(rejected, docs["doc_id"].cast("long").eqNullSafe(rejected[id_]) & (key(docs["text"]) == rejected[row]), "left_anti")
