"""CI1 and CI3 as operators (one row per group)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.columns import numeric_col, require_columns
from kestrel.operators.stats import effects as E
from kestrel.operators.stats.tests import _binary_ok, _success


def mean_confidence_interval(df: DataFrame, metric: str, alpha: float = 0.05,
                             by: list[str] | None = None) -> DataFrame:
    """CI1: t interval of the mean (degenerate when n <= 1)."""
    by = list(by or [])
    require_columns(df, metric, *by)
    x = numeric_col(df, metric).cast("double")
    src = df
    for c in by:
        src = src.where(F.col(c).isNotNull())
    aggs = [F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd")]
    s = src.groupBy(*by).agg(*aggs) if by else src.agg(*aggs)
    lo, hi = E.mean_ci(F.col("mean"), F.col("sd"), F.col("n"), alpha)
    return s.select(*by, "n", "mean", (F.col("sd") / F.sqrt("n")).alias("sem"), lo.alias("lower_bound"),
                    hi.alias("upper_bound"), F.lit(1.0 - alpha).alias("confidence_level"))


def proportion_confidence_interval(df: DataFrame, metric: str, success_value=1, alpha: float = 0.05,
                                   by: list[str] | None = None) -> DataFrame:
    """CI3: Wilson score interval of the success rate."""
    by = list(by or [])
    require_columns(df, metric, *by)
    src = df.where(F.col(metric).isNotNull())
    for c in by:
        src = src.where(F.col(c).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(_success(df, metric, success_value)).alias("successes"),
            F.count_if(~_binary_ok(df, metric, success_value)).alias("non_binary")]
    s = src.groupBy(*by).agg(*aggs) if by else src.agg(*aggs)
    lo, hi = E.wilson_ci(F.col("successes"), F.col("n"), alpha)
    return s.select(*by, "n", "successes", F.when(F.col("n") > 0, F.col("successes") / F.col("n")).otherwise(0.0)
                    .alias("proportion"), lo.alias("lower_bound"), hi.alias("upper_bound"), "non_binary",
                    F.lit(1.0 - alpha).alias("confidence_level"))
