"""C1-C3: cohort retention in long and matrix form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.columns import require_columns, timestamp_col
from kestrel.functions.periods import norm_freq, period_diff, period_label, period_start


def cohort_long(df: DataFrame, entity_col: str, date_col: str, freq: str = "M") -> DataFrame:
    """C1: (cohort_period, period_number, active_entities, cohort_size,
    retention_rate).

    Distinct (entity, period) pairs first: after that an entity holds at
    most one row per period, so the per-entity window that finds its first
    period is bounded by the number of periods even for a hot entity.
    Cohort size is a window over the (small) cohort × period result.
    """
    f = norm_freq(freq)
    require_columns(df, entity_col, date_col)
    e = (df.select(F.col(entity_col).alias("_e"), period_start(timestamp_col(df, date_col), f).alias("_p"))
         .where(F.col("_e").isNotNull() & F.col("_p").isNotNull()).distinct())
    e = e.withColumn("_c", F.min("_p").over(Window.partitionBy("_e")))
    g = (e.groupBy("_c", period_diff(F.col("_p"), F.col("_c"), f).alias("period_number"))
         .agg(F.count(F.lit(1)).alias("active_entities")))
    size = F.max(F.when(F.col("period_number") == 0, F.col("active_entities"))).over(Window.partitionBy("_c"))
    g = g.withColumn("cohort_size", size)
    return g.select(period_label(F.col("_c"), f).alias("cohort_period"),
                    F.col("period_number").cast("int").alias("period_number"),
                    "active_entities", "cohort_size",
                    (F.col("active_entities") / F.col("cohort_size")).alias("retention_rate"))


def cohort_matrix(df: DataFrame, entity_col: str, date_col: str, freq: str = "M",
                  periods: list[int] | None = None) -> DataFrame:
    """C2: one row per cohort, one column per period number, missing -> 0.0.

    ``pivot`` always gets an explicit value list (no extra job, bounded
    width); by default the distinct period numbers, which number at most the
    periods spanned by the data.
    """
    long = cohort_long(df, entity_col, date_col, freq)
    if periods is None:
        periods = sorted(r[0] for r in long.select("period_number").distinct().collect())
    m = long.groupBy("cohort_period").pivot("period_number", list(periods)).agg(F.first("retention_rate"))
    return m.select("cohort_period", *[F.coalesce(F.col(str(p)), F.lit(0.0)).alias(str(p)) for p in periods])
