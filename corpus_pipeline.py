"""Training-corpus pipeline over the operators of ``kestrel.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kestrel.llm import cotrain, decontaminate, packing, simhash, substring
from kestrel.llm.common import bound_batches
from kestrel.session import ensure_checkpoint_dir, ship_package

#: Rows of a batch of the Parquet reader.
READER_ROWS = 512


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _prepare(spark: SparkSession) -> None:
    """Python workers can import the package, and get bounded batches; so
    does the Parquet reader, whose batches of 4096 rows of text are many
    megabytes in one array each."""
    ship_package(spark)
    bound_batches(spark, size="1m")
    rows = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.set(rows, str(min(int(spark.conf.get(rows)), READER_ROWS)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    _prepare(spark)
    return cotrain.keep_quality(docs, _table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group one row stays, with the smallest doc_id."""
    _prepare(spark)
    return simhash.near_dedup(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under windows that a smaller doc_id holds go."""
    _prepare(spark)
    return substring.remove_repeats(docs, n_chars="n_chars")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows contaminated with benchmark items go."""
    _prepare(spark)
    return decontaminate.remove_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their place in the sequences."""
    _prepare(spark)
    return packing.digest(packing.pack(docs))


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("substring_dedup", substring_stage),
          ("decontamination", decontaminate_stage), ("packing", packing_stage)]

#: The classifier and the fingerprints have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    _prepare(spark)
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kestrel-tables/pipeline-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
