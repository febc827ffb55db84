"""Grouped and scalar aggregates (PF2, AG1-AG12).

Results are DataFrames. Sorting is ``value desc nulls last, key asc`` so
ties are deterministic; ``orderBy(...).limit(n)`` plans as a top-k
(TakeOrderedAndProject: every partition keeps n rows), so a limited result
never sorts the whole key set. NULL keys are dropped, as pandas does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.columns import (
    SCALAR_AGG_NAMES, ColumnError, agg_column, key_equals, numeric_col, require_columns,
    timestamp_col,
)
from kestrel.operators.ranks import quantile_name, value_summary

DEFAULT_QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
GROUP_QUANTILES = (0.5, 0.75, 0.9, 0.95, 0.99)


def _not_null(*cols: str):
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def _grouped(df: DataFrame, keys: list[str], metric: str, agg: str, order_by: str | None = None):
    require_columns(df, *keys, metric, order_by)
    x = numeric_col(df, metric) if agg not in ("count", "nunique", "first", "last") else F.col(metric)
    ob = F.col(order_by) if order_by else None
    return (df.where(_not_null(*keys))
              .groupBy(*keys)
              .agg(agg_column(agg, x, ob).cast("double").alias("value")))


def _ordered(res: DataFrame, keys: list[str], limit: int | None) -> DataFrame:
    order = [F.col("value").desc_nulls_last(), *[F.col(k).asc() for k in keys]]
    res = res.orderBy(*order)
    if limit is not None and limit > 0:
        res = res.limit(int(limit))
    return res


def groupby_agg(df: DataFrame, group_by: str, metric: str, agg: str = "sum",
                limit: int | None = None, order_by: str | None = None) -> DataFrame:
    """AG1: one key, one aggregate, sorted desc, top ``limit`` (none or <=0: all)."""
    return _ordered(_grouped(df, [group_by], metric, agg, order_by), [group_by], limit)


def groupby2_agg(df: DataFrame, group_by_1: str, group_by_2: str, metric: str,
                 agg: str = "sum", limit: int | None = None) -> DataFrame:
    """AG2: two keys -> rows (g1, g2, value)."""
    keys = [group_by_1, group_by_2]
    return _ordered(_grouped(df, keys, metric, agg), keys, limit)


def topk(df: DataFrame, by: str, metric: str, agg: str = "sum", k: int = 10) -> DataFrame:
    """AG3: AG1 with head(k); k is always applied."""
    return _grouped(df, [by], metric, agg).orderBy(
        F.col("value").desc_nulls_last(), F.col(by).asc()).limit(max(int(k), 0))


def segment_analysis(df: DataFrame, segment_by: str, metric: str, agg: str = "sum",
                     limit: int | None = None) -> DataFrame:
    """AG4: AG1 plus ``share_pct`` = value / sum of the *kept* values, and
    ``share_of_total`` = value / sum over all groups.

    The totals are one-row aggregates joined back (broadcast of one row),
    never an unpartitioned window over a possibly huge group list.
    """
    return segment_from_grouped(_grouped(df, [segment_by], metric, agg), segment_by, limit)


def segment_from_grouped(g: DataFrame, segment_by: str, limit: int | None) -> DataFrame:
    """AG4 post-processing of a grouped (key, value) result."""
    all_total = g.agg(F.sum("value").alias("_all"))
    kept = _ordered(g, [segment_by], limit)
    kept_total = kept.agg(F.sum("value").alias("_kept"))
    return (kept.crossJoin(F.broadcast(kept_total)).crossJoin(F.broadcast(all_total))
            .select(F.col(segment_by).cast("string").alias("segment"), "value",
                    F.when(F.col("_kept") != 0, F.col("value") / F.col("_kept"))
                     .otherwise(F.lit(0.0)).alias("share_pct"),
                    F.when(F.col("_all") != 0, F.col("value") / F.col("_all"))
                     .otherwise(F.lit(0.0)).alias("share_of_total")))


def filter_agg(df: DataFrame, filter_col: str, filter_val, metric: str, agg: str = "sum") -> DataFrame:
    """PF2: aggregate of ``metric`` over rows where ``filter_col == filter_val``.

    Numeric columns compare natively, so the predicate is pushed to the
    Parquet scan. One row: (filter_col, filter_val, value).
    """
    require_columns(df, filter_col, metric)
    if agg not in SCALAR_AGG_NAMES:
        raise ColumnError(f"unsupported aggregate {agg!r}")
    sub = df.where(key_equals(df, filter_col, filter_val))
    return sub.agg(agg_column(agg, numeric_col(df, metric)).cast("double").alias("value")) \
        .select(F.lit(filter_col).alias("filter_col"), F.lit(str(filter_val)).alias("filter_val"), "value")


def scalar_agg(df: DataFrame, metric: str, agg: str = "sum") -> DataFrame:
    """AG9: one of sum/mean/min/max/median/count on the coerced column."""
    require_columns(df, metric)
    if agg not in SCALAR_AGG_NAMES:
        raise ColumnError(f"unsupported aggregate {agg!r}")
    return df.agg(agg_column(agg, numeric_col(df, metric)).cast("double").alias("value"))


def _valid_quantiles(qs, default):
    out = []
    for q in (qs if isinstance(qs, (list, tuple)) else []):
        try:
            qf = float(q)
        except (TypeError, ValueError):
            continue
        if 0.0 <= qf <= 1.0:
            out.append(qf)
    return out or list(default)


def distribution(df: DataFrame, column: str, quantiles=DEFAULT_QUANTILES,
                 by: list[str] | None = None, approx: bool = False) -> DataFrame:
    """AG5: count, mean, std (ddof=1; 0 when n=1), min, max and quantiles.

    Exact quantiles use the range-partitioned prefix counts (no per-group
    value map); ``approx=True`` uses ``percentile_approx`` instead. Groups
    with no numeric value produce no row (the reference skips them).
    """
    require_columns(df, column, *(by or []))
    by = list(by or [])
    qs = _valid_quantiles(quantiles, DEFAULT_QUANTILES)
    x = numeric_col(df, column).cast("double")
    base = df.select(*by, x.alias("_x")).where(F.col("_x").isNotNull())
    if by:
        base = base.where(_not_null(*by))
    if approx:
        mom = base.groupBy(*by).agg(
            F.count("_x").alias("count"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"),
            F.min("_x").alias("min"), F.max("_x").alias("max"))
        qcols = F.percentile_approx("_x", qs, 10000)
        qt = base.groupBy(*by).agg(qcols.alias("_qa")).select(
            *by, *[F.col("_qa")[i].alias(quantile_name("q", q)) for i, q in enumerate(qs)])
        out = mom.join(qt, by) if by else mom.crossJoin(qt)
    else:
        out = value_summary(base, "_x", qs, by)
    out = out.where(F.col("count") > 0).withColumn("std", F.coalesce(F.col("std"), F.lit(0.0)))
    return out.select(F.lit(column).alias("column"), *by, "count", "mean", "std", "min", "max",
                      *[quantile_name("q", q) for q in qs])


def group_distribution(df: DataFrame, group_by: str, metric: str, agg: str = "sum",
                       quantiles=GROUP_QUANTILES) -> DataFrame:
    """AG6: distribution of the per-group aggregates (two-level aggregate)."""
    qs = _valid_quantiles(quantiles, GROUP_QUANTILES)
    return group_distribution_from_grouped(_grouped(df, [group_by], metric, agg), group_by, metric, agg, qs)


def group_distribution_from_grouped(g: DataFrame, group_by: str, metric: str, agg: str, qs) -> DataFrame:
    """AG6 post-processing of a grouped (key, value) result."""
    qs = _valid_quantiles(qs, GROUP_QUANTILES)
    g = g.where(F.col("value").isNotNull() & ~F.isnan("value"))
    v = value_summary(g, "value", qs)
    return v.where(F.col("count") > 0).select(
        F.lit(group_by).alias("group_by"), F.lit(metric).alias("metric"), F.lit(agg).alias("agg"),
        F.col("count").alias("n_groups"), *[quantile_name("q", q) for q in qs],
        F.col("max").alias("max_group_value"), F.col("min").alias("min_group_value"),
        F.col("mean").alias("mean_group_value"))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """AG7: Pearson on pairwise-complete rows; ``status`` skipped when n<3
    or undefined (NaN in pandas = NULL here)."""
    return correlation_matrix(df, [x], [y])


def correlation_matrix(df: DataFrame, xs: list[str], ys: list[str] | None = None) -> DataFrame:
    """AG7 for many pairs in one aggregation: rows (x, y, n, r, status)."""
    ys = ys or xs
    pairs = [(a, b) for a in xs for b in ys if a != b] if ys is xs else [(a, b) for a in xs for b in ys]
    require_columns(df, *xs, *ys)
    exprs = correlation_pair_aggs(df, pairs)
    return correlation_from_row(df.agg(*exprs), pairs)


def correlation_pair_aggs(df: DataFrame, pairs, prefix: str = "") -> list:
    exprs = []
    for i, (a, b) in enumerate(pairs):
        xa, yb = numeric_col(df, a).cast("double"), numeric_col(df, b).cast("double")
        both = xa.isNotNull() & yb.isNotNull()
        exprs += [F.count_if(both).alias(f"{prefix}n{i}"),
                  F.corr(F.when(both, xa), F.when(both, yb)).alias(f"{prefix}r{i}")]
    return exprs


def correlation_from_row(row: DataFrame, pairs, prefix: str = "") -> DataFrame:
    """AG7 rows (x, y, n, r, status) from one aggregated row."""
    stacked = F.inline(F.array(*[
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"{prefix}n{i}").alias("n"),
                 F.col(f"{prefix}r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]))
    res = row.select(stacked)
    ok = (F.col("n") >= 3) & F.col("r").isNotNull() & ~F.isnan("r")
    return res.select("x", "y", "n", F.when(ok, F.col("r")).alias("r"),
                      F.when(ok, F.lit("computed")).otherwise(F.lit("skipped")).alias("status"))


def recency_by_group(df: DataFrame, group_by: str, date_col: str) -> DataFrame:
    """AG8: whole days from each group's last date to the table's last date.

    The global maximum is a one-row aggregate joined back (broadcast of one
    row); per-group maxima are a partial (map-side) aggregate.
    """
    require_columns(df, group_by, date_col)
    base = df.select(F.col(group_by).alias("_k"), timestamp_col(df, date_col).alias("_d")) \
        .where(F.col("_k").isNotNull() & F.col("_d").isNotNull())
    per = base.groupBy("_k").agg(F.max("_d").alias("last_date"))
    return recency_from_grouped(per, group_by)


def recency_from_grouped(per: DataFrame, group_by: str) -> DataFrame:
    """AG8 post-processing of per-group last dates (_k, last_date): the
    reference date is the max of the group maxima (one row, broadcast)."""
    latest = per.agg(F.max("last_date").alias("reference_date"))
    secs = F.unix_micros(F.col("reference_date").cast("timestamp")) - \
        F.unix_micros(F.col("last_date").cast("timestamp"))
    return per.crossJoin(F.broadcast(latest)).select(
        F.col("_k").alias(group_by), "last_date", "reference_date",
        F.floor(secs / F.lit(86_400_000_000)).cast("long").alias("recency_days"))


def distinct_count(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """AG10: distinct non-NULL values per column, long form (column, n_unique).

    Exact form unpivots to (column, value) and counts distinct pairs with
    two shuffling group-bys instead of one Expand per count_distinct.
    """
    cols = columns or df.columns
    require_columns(df, *cols)
    if approx:
        row = df.agg(*[F.approx_count_distinct(c).alias(f"c{i}") for i, c in enumerate(cols)])
        return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n_unique"))
                                             for i, c in enumerate(cols)])))
    long = _unpivot_as_string(df, cols)
    return (long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.lit(1).alias("_o"))
            .groupBy("column").agg(F.count(F.lit(1)).alias("n_unique")))


def _unpivot_as_string(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value as text); -0.0 counts as 0.0, as it does in a group-by."""
    def text(c):
        kind = dict(df.dtypes)[c]
        x = F.col(c) + F.lit(0).cast(kind) if kind in ("float", "double") else F.col(c)
        return x.cast("string")
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in cols])))


def contingency(df: DataFrame, left: str, right: str) -> DataFrame:
    """AG11: long contingency counts (left, right, n) of string labels."""
    require_columns(df, left, right)
    return (df.select(F.col(left).cast("string").alias(left), F.col(right).cast("string").alias(right))
            .where(_not_null(left, right)).groupBy(left, right).agg(F.count(F.lit(1)).alias("n")))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """AG12: non-NULL values as text, most frequent first, the first ``top`` if asked for."""
    require_columns(df, column)
    out = (df.select(F.col(column).cast("string").alias("value")).where(F.col("value").isNotNull())
           .groupBy("value").agg(F.count(F.lit(1)).alias("count"))
           .orderBy(F.col("count").desc(), F.col("value").asc()))
    return out.limit(int(top)) if top else out


def cube_agg(df: DataFrame, keys: list[str], metric: str, agg: str = "sum") -> DataFrame:
    """Totals for every subset of ``keys`` in one scan (GROUPING SETS);
    ``grouping_id`` tells which keys are rolled up."""
    require_columns(df, *keys, metric)
    x = numeric_col(df, metric)
    return (df.cube(*keys).agg(agg_column(agg, x).cast("double").alias("value"),
                               F.grouping_id().alias("grouping_id")))
