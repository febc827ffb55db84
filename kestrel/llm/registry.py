"""The operators' registered queries and, where SQL can express them, their
DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import (alignment, cotrain, decontaminate, hilbert, huffman, negatives, packing, perplexity, redirects,
                         simhash, substring, toxicity, viterbi)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against all benchmark items. Nulls and blank texts have no words; repeated rows
    come back as often; an empty benchmark marks nothing (``decontaminate.contamination``)."""
    return decontaminate.digest(decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and the perplexity band of every text. Null and empty texts fail the base
    rules; a null language is one of its own (``perplexity.quality_rules``)."""
    return perplexity.digest(perplexity.quality_rules(_table(spark, sf_dir, "documents")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words under repeated 13-word windows go. A null doc_id counts as larger than any other;
    rows of one doc_id take no words from each other (``substring.repeated_spans``)."""
    return substring.substring_dedup(_table(spark, sf_dir, "documents"))


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards along the curve, counts at most one apart; ties are cut
    anywhere in a run of equal rows (``hilbert.hilbert_shards``)."""
    return hilbert.digest(hilbert.hilbert_shards(_table(spark, sf_dir, "documents")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-trained scores of all documents; texts without words are rejected
    (``cotrain.quality``)."""
    return cotrain.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written and read back as Huffman blocks; a null text is the end id alone
    (``huffman.write_ids``)."""
    return huffman.digest(huffman.read_ids(spark, huffman.write_ids(_table(spark, sf_dir, "documents"))))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in as few sequences of 4096 as best fit finds; a null text is
    the end id alone (``packing.pack``)."""
    return packing.digest(packing.pack(_table(spark, sf_dir, "documents")))


def op8_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece counts of the best segmentation; null and empty texts have none
    (``viterbi.token_counts``)."""
    return viterbi.token_counts(_table(spark, sf_dir, "documents"))


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints within 2 bits form groups; blank and null texts share fingerprint zero
    (``simhash.simhash_groups``)."""
    return simhash.digest(simhash.simhash_groups(_table(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, empty ones included, by the network fitted on the labelled
    rows that are not held out (``toxicity.toxicity``)."""
    return toxicity.digest(toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of both tokenizers' tokens; texts that are null, empty or not spelled
    byte for byte give zeros (``alignment.alignment_digest``)."""
    return alignment.alignment_digest(_table(spark, sf_dir, "documents"))


def op12_redirect_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest rule of every url, else what its aliases say; a null url has empty host and
    path (``redirects.url_verdicts``)."""
    rules = spark.createDataFrame(redirects.RULES, "verdict string, host string, path string")
    return redirects.digest(redirects.url_verdicts(_table(spark, sf_dir, "pages"), rules))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector, where every 7th has its label moved on; rows with
    nulls take no part, ties go to the smaller id (``negatives.hard_negatives``)."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label))


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_quality_rules, op3_substring_dedup, op4_hilbert_shards, op5_quality_classifier,
    op6_huffman_ids, op7_best_fit_packing, op8_viterbi_counts, op9_simhash_groups, op10_toxicity,
    op11_token_alignment, op12_redirect_verdicts, op13_hard_negatives)}

ORACLES = {"op1_decontamination": decontaminate.ORACLE_SQL, "op3_substring_dedup": substring.ORACLE_SQL,
           "op12_redirect_verdicts": redirects.ORACLE_SQL, "op13_hard_negatives": negatives.ORACLE_SQL}
