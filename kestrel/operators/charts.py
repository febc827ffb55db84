"""CH1-CH5: chart data as tables (no images)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.columns import agg_column, numeric_col, require_columns
from kestrel.operators.quality import numeric_measure_columns


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """CH1: equal-width bins between min and max, the last bin closed;
    every bin is listed (empty ones with 0). The min/max row is one row
    joined back; the bin list has a fixed length."""
    require_columns(df, column)
    x = numeric_col(df, column).cast("double")
    vals = df.select(x.alias("_x")).where(F.col("_x").isNotNull())
    mm = vals.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(w > 0, F.least(F.floor((F.col("_x") - F.col("_lo")) / w), F.lit(bins - 1))).otherwise(0)
    counts = vals.crossJoin(F.broadcast(mm)).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = mm.where(F.col("_lo").isNotNull()).select("_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return grid.join(counts, "bin", "left").select(
        F.lit(column).alias("column"), "bin", (F.col("_lo") + F.col("bin") * width).alias("lower"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("upper"), F.coalesce("count", F.lit(0)).alias("count"))


def histograms(df: DataFrame, columns: list[str] | None = None, bins: int = 10) -> DataFrame:
    """CH1 for the given columns, or all numeric ones (unioned)."""
    cols = columns or numeric_measure_columns(df)
    out = None
    for c in cols:
        h = histogram(df, c, bins)
        out = h if out is None else out.unionByName(h)
    return out


def top_categories(df: DataFrame, column: str, top_k: int | None = None, min_unique: int = 2,
                   max_unique: int | None = None) -> DataFrame:
    """CH2: values of a column by frequency, the ``top_k`` first if asked
    for; nothing for a column with fewer than ``min_unique`` or, if given,
    more than ``max_unique`` distinct values."""
    require_columns(df, column)
    counts = (df.select(F.col(column).cast("string").alias("value")).where(F.col("value").isNotNull())
              .groupBy("value").agg(F.count(F.lit(1)).alias("count")))
    nu = counts.agg(F.count(F.lit(1)).alias("_nu"))
    fits = F.col("_nu") >= min_unique
    if max_unique is not None:
        fits &= F.col("_nu") <= max_unique
    out = counts.crossJoin(F.broadcast(nu)).where(fits).select(F.lit(column).alias("column"), "value", "count") \
        .orderBy(F.col("count").desc(), F.col("value").asc())
    return out.limit(int(top_k)) if top_k else out


def bar_data(result: DataFrame, key: str, value: str = "value", top_k: int | None = None) -> DataFrame:
    """CH3: the bars of a key -> value result, the ``top_k`` highest if asked for."""
    out = result.select(F.col(key).cast("string").alias("label"), F.col(value).cast("double").alias("value")) \
        .orderBy(F.col("value").desc_nulls_last(), F.col("label"))
    return out.limit(int(top_k)) if top_k else out


def line_data(series: DataFrame, x: str = "period", y: str = "value") -> DataFrame:
    """CH4: a series sorted by its x axis (the sort is a range-partitioned
    distributed sort)."""
    return series.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y")).orderBy("x")


def heatmap_cells(df: DataFrame, x_col: str, y_col: str, metric: str, agg: str = "sum",
                  max_labels: int | None = None, fill: bool = True) -> DataFrame:
    """CH5: summed cells of all labels of both axes, missing cells as 0;
    ``max_labels`` keeps only the first sorted labels of each axis.
    ``fill=False`` returns the cells that occur and builds no grid, which
    is the form for axes with very many labels."""
    require_columns(df, x_col, y_col, metric)
    base = df.select(F.col(x_col).cast("string").alias("x"), F.col(y_col).cast("string").alias("y"),
                     numeric_col(df, metric).alias("_m")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    xs, ys, kept = base.select("x").distinct(), base.select("y").distinct(), base
    if max_labels:
        xs, ys = xs.orderBy("x").limit(int(max_labels)), ys.orderBy("y").limit(int(max_labels))
        kept = base.join(xs, "x", "left_semi").join(ys, "y", "left_semi")
    cells = (kept.groupBy("x", "y").agg(agg_column(agg, F.col("_m")).cast("double").alias("value")))
    if not fill:
        return cells.select("x", "y", F.coalesce("value", F.lit(0.0)).alias("value"))
    grid = xs.crossJoin(ys)
    return grid.join(cells, ["x", "y"], "left").select("x", "y", F.coalesce("value", F.lit(0.0)).alias("value"))
