"""One query per operator over its whole table, and DuckDB SQL where that can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlight.llm import chat, decontaminate, filter_audit, fim, fingerprints, langid, lines, mixing, quality, secrets, simhash, substrings, tokenids
from foldlight.llm.common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of `conversations`, parsed and rendered turn by turn.

    Two rows of three show their role as a speaker's marker; the other third (by hash) shows none, so that its role has to be
    inferred.  Conversations are decoded by a model fitted on the other half of them.
    """
    rows = table(spark, sf_dir, "conversations")
    half = F.pmod(F.xxhash64(F.lit("half"), "conv_id"), F.lit(2))
    shown = rows.withColumn("shown", F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)) != 0, F.col("role")))
    found = None
    for k in (0, 1):
        part = chat.parse_transcripts(shown.where(half == k), chat.fit(rows.where(half != k)), marker="shown")
        found = part if found is None else found.unionByName(part)
    return found.select(F.col("conv").cast("long").alias("conv_id"), *[c for c in found.columns if c != "conv"])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_verdicts(table(spark, sf_dir, "documents"))
    first = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return found.select(*first, *[c for c in found.columns if c not in first])


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each benchmark item found in a document; clean documents have none."""
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (doc_id set) and raw pages (page_id set) by one model, fitted on labelled documents; their label is no evidence."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    none = F.lit(None).cast("long")
    rows = langid.document_rows(docs).withColumnsRenamed({"id": "doc_id"}).withColumn("page_id", none)
    pages = langid.page_rows(table(spark, sf_dir, "pages")).withColumnsRenamed({"id": "page_id"}).withColumn("doc_id", none)
    return langid.identify(rows.unionByName(pages), model, ("doc_id", "page_id"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.encoded_documents(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut, put out and restored; the digests of both stand for the texts."""
    found = fim.restore_texts(fim.fill_in_middle(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.next_likeness(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_quality_rules": op2_quality_rules,
    "op3_mix_sources": op3_mix_sources,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_token_ids": op8_token_ids,
    "op9_line_dedup": op9_line_dedup,
    "op10_secret_scans": op10_secret_scans,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_filter_audit": op12_filter_audit,
    "op13_document_fingerprints": op13_document_fingerprints,
}

ORACLES = {
    "op2_quality_rules": quality.ORACLE,
    "op5_substring_dedup": substrings.ORACLE,
    "op3_mix_sources": mixing.ORACLE.replace("{docs}", "documents"),
    "op9_line_dedup": lines.ORACLE,
    "op10_secret_scans": secrets.ORACLE,
    "op11_fill_in_middle": fim.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
}
