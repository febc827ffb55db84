"""Structured Streaming forms of the batch operators (optional in the
reference, which has no streams): windowed aggregates with a watermark and
the run-ledger transition audit with per-run state.

Outputs go to folders under the session's ``spark.checkpoint.dir`` (a
shared file system on a cluster), together with the stream checkpoints,
so a restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from kestrel.operators.ledger import ALLOWED_TRANSITIONS
from kestrel.session import ensure_checkpoint_dir


def stream_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/kestrel-streams/{name}-{uuid.uuid4().hex[:12]}"


def read_parquet_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A parquet folder (or one file, through its folder and a glob
    filter) as a stream."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        folder, name = path.rsplit("/", 1)
        return r.option("pathGlobFilter", name).parquet(folder)
    return r.parquet(path)


def windowed_aggregates(stream: DataFrame, ts_col: str, value_col: str, window: str = "1 hour",
                        watermark: str = "1 hour", by: list[str] | None = None) -> DataFrame:
    """T1/K1 on a stream: count, sum, mean, min, max of ``value_col`` per
    tumbling window (and ``by`` keys); late rows within the watermark
    update their window, older state is dropped."""
    by = list(by or [])
    v = F.col(value_col).cast("double")
    # Watermarks need TIMESTAMP; NTZ values are read as UTC instants.
    stream = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    return (stream.withWatermark(ts_col, watermark)
            .groupBy(F.window(ts_col, window).alias("w"), *by)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"),
                 F.min(v).alias("min"), F.max(v).alias("max"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by,
                    "n", "total", "mean", "min", "max"))


def run_versioned(agg_stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run an update-mode aggregation to the end of its input
    (availableNow); every micro-batch appends its updated rows with the
    batch id, and the returned batch DataFrame keeps each key's latest
    version."""
    spark = agg_stream.sparkSession
    base = stream_folder(spark, name)
    out, ckpt = f"{base}/data", f"{base}/checkpoint"

    def sink(batch: DataFrame, batch_id: int):
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out)

    q = (agg_stream.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    res = _read_or_empty(spark, out, agg_stream.schema.add("_batch", "long"))
    others = [c for c in res.columns if c not in keys and c != "_batch"]
    latest = res.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col("_batch")).alias("_r"))
    return latest.select(*keys, "_r.*")


def ledger_transitions_stream(stream: DataFrame, run_col: str, ts_col: str, status_col: str,
                              tiebreak: str) -> DataFrame:
    """LG1 on a stream: per run, the last seen status is kept in state and
    every new event yields (from_status, to_status, allowed). Events of one
    micro-batch are ordered by (ts, tiebreak) inside the group."""
    allowed = {(a, b) for a, bs in ALLOWED_TRANSITIONS.items() for b in (a, *bs)}
    key_type = stream.schema[run_col].dataType.simpleString()
    ts_type = stream.schema[ts_col].dataType.simpleString()
    tb_type = stream.schema[tiebreak].dataType.simpleString()
    out_schema = (f"{run_col} {key_type}, {ts_col} {ts_type}, {tiebreak} {tb_type}, from_status string, "
                  "to_status string, allowed boolean")

    def step(key, pdfs, state):
        prev = state.get[0] if state.exists else None
        frames = [p for p in pdfs]
        if not frames:
            return
        pdf = pd.concat(frames).sort_values([ts_col, tiebreak])
        rows = []
        for ts, tb, st in zip(pdf[ts_col], pdf[tiebreak], pdf[status_col]):
            if prev is not None:
                rows.append((key[0], ts, tb, prev, st, (prev, st) in allowed))
            prev = st
        state.update((prev,))
        yield pd.DataFrame(rows, columns=[run_col, ts_col, tiebreak, "from_status", "to_status", "allowed"])

    return (stream.select(run_col, ts_col, tiebreak, status_col).groupBy(run_col)
            .applyInPandasWithState(step, out_schema, "last_status string", "append", GroupStateTimeout.NoTimeout))


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream to the end of its input into a parquet
    folder under the checkpoint dir and return it as a batch DataFrame."""
    spark = stream.sparkSession
    base = stream_folder(spark, name)
    q = (stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/data")
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return _read_or_empty(spark, f"{base}/data", stream.schema)


def _read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """The sink folder, or an empty result when no micro-batch wrote rows
    (any other failure to read it is raised). Micro-batches may be retried
    after a failure: versioned rows of one batch are identical, so keeping
    the latest version stays exact."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def windowed_missingness(stream: DataFrame, ts_col: str, window: str = "1 hour",
                         watermark: str = "1 hour", columns: list[str] | None = None) -> DataFrame:
    """Q1 on a stream: rows and missing values per column for every
    tumbling window (NaN counts as missing for floating columns)."""
    from pyspark.sql import types as T
    cols = columns or [c for c in stream.columns if c != ts_col]
    fields = {f.name: f.dataType for f in stream.schema.fields}

    def miss(c):
        m = F.col(c).isNull()
        if isinstance(fields[c], (T.DoubleType, T.FloatType)):
            m = m | F.isnan(c)
        return m
    s = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark)
    return (s.groupBy(F.window(ts_col, window).alias("w"))
            .agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(miss(c)).alias(f"missing_{c}") for c in cols])
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_rows",
                    *[f"missing_{c}" for c in cols]))


def run_state_stream(stream: DataFrame, run_col: str, ts_col: str, status_col: str,
                     error_col: str | None = None) -> DataFrame:
    """LG2 on a stream: the batch run-state aggregates as an update-mode
    streaming aggregation (partial aggregates in the state store)."""
    from kestrel.operators.ledger import run_state
    return run_state(stream, run_col, ts_col, status_col, error_col)


def windowed_kpis(stream: DataFrame, ts_col: str, domain: str, window: str = "1 day",
                  watermark: str = "7 days", by: list[str] | None = None) -> DataFrame:
    """K1 on a stream: the template's base KPIs per event-time window (and
    ``by`` keys) as an update-mode aggregation; derived KPIs are computed on
    the aggregated rows."""
    from kestrel.operators.kpi import kpi_aggregates
    by = list(by or [])
    aggs, outs = kpi_aggregates(stream, domain)
    s = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark)
    for b in by:
        s = s.where(F.col(b).isNotNull())
    g = s.groupBy(F.window(ts_col, window).alias("w"), *by).agg(*aggs)
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *outs)
