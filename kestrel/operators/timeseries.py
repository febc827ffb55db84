"""T1: resampled time series with pandas-style labels and gap filling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.columns import agg_column, numeric_col, require_columns, timestamp_col
from kestrel.functions.periods import norm_freq, period_end_label, period_sequence, period_start

GAP_FILLED = ("sum", "count")


def timeseries_agg(df: DataFrame, date_col: str, metric: str, freq: str = "M",
                   agg: str = "sum", by: list[str] | None = None) -> DataFrame:
    """Aggregate ``metric`` per calendar period of ``date_col``.

    Rows with an unparsable date or metric are dropped first. For sum and
    count every period between the first and last non-empty one appears
    (0 when empty), as pandas resample does; other aggregates keep only the
    non-empty periods. The calendar is built from a one-row min/max with
    ``sequence`` (its length is bounded by the time span, not the data) and
    left-joined to the partial-aggregated buckets. Output: (by..., period,
    value) with ``period`` the pandas label (period end for W/M/Q/Y).
    """
    f = norm_freq(freq)
    by = list(by or [])
    require_columns(df, date_col, metric, *by)
    base = df.select(*by, period_start(timestamp_col(df, date_col), f).alias("_p"),
                     numeric_col(df, metric).alias("_x")) \
        .where(F.col("_p").isNotNull() & F.col("_x").isNotNull())
    for b in by:
        base = base.where(F.col(b).isNotNull())
    g = base.groupBy(*by, "_p").agg(agg_column(agg, F.col("_x")).cast("double").alias("value"))
    return timeseries_from_grouped(g, f, agg, by)


def timeseries_from_grouped(g: DataFrame, freq: str, agg: str, by: list[str] | None = None) -> DataFrame:
    """T1 post-processing of per-period aggregates (by..., _p, value) built
    from rows with a valid date and metric: gap filling and labels."""
    f = norm_freq(freq)
    by = list(by or [])
    if agg.lower() in GAP_FILLED:
        span = g.groupBy(*by).agg(F.min("_p").alias("_lo"), F.max("_p").alias("_hi"))
        cal = span.select(*by, F.explode(period_sequence(F.col("_lo"), F.col("_hi"), f)).alias("_p"))
        g = cal.join(g, [*by, "_p"], "left").select(
            *by, "_p", F.coalesce(F.col("value"), F.lit(0.0)).alias("value"))
    else:
        g = g.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return g.select(*by, period_end_label(F.col("_p"), f).alias("period"), "value")
