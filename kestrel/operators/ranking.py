"""Ranking and comparison over grouped results (RK1-RK5).

Grouped results can be as large as the key set (one row per customer), so
ranks are computed without windows: the focus row is one row, and its rank
is a single conditional count against it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.columns import key_equals, require_columns
from kestrel.operators.aggregate import _grouped


def focus_rank(df: DataFrame, group_by: str, metric: str, focus, agg: str = "sum") -> DataFrame:
    """RK1 + RK2: value and rank of the focus segment, number of segments,
    top value and gap to the top (one row; empty when the focus is absent).

    rank = 1 + #(value > v or (value = v and key < k)) - same order as the
    sorted grouped result.
    """
    require_columns(df, group_by, metric)
    g = _grouped(df, [group_by], metric, agg)
    f = g.where(key_equals(g, group_by, focus)).select(
        F.col(group_by).alias("_fk"), F.col("value").alias("focus_value"))
    j = g.crossJoin(F.broadcast(f))
    before = (F.col("value") > F.col("focus_value")) | \
             ((F.col("value") == F.col("focus_value")) & (F.col(group_by) < F.col("_fk")))
    return j.groupBy("_fk", "focus_value").agg(
        (F.lit(1) + F.count_if(before)).alias("rank"),
        F.count(F.lit(1)).alias("n_segments"),
        F.max("value").alias("top_value"),
    ).select(F.col("_fk").cast("string").alias("focus"), "focus_value", "rank", "n_segments",
             "top_value", (F.col("top_value") - F.col("focus_value")).alias("gap_to_top"))


def leader_margin(df: DataFrame, group_by: str, metric: str, agg: str = "sum") -> DataFrame:
    """RK3: leader minus runner-up and second-lowest minus lowest.

    Top-2 from each end are two top-k plans (each partition keeps 2 rows).
    """
    g = _grouped(df, [group_by], metric, agg).where(F.col("value").isNotNull())
    top2 = g.orderBy(F.col("value").desc(), F.col(group_by).asc()).limit(2)
    bot2 = g.orderBy(F.col("value").asc(), F.col(group_by).desc()).limit(2)
    t = top2.agg(F.max_by(group_by, "value").cast("string").alias("leader"),
                 F.max("value").alias("leader_value"),
                 F.when(F.count(F.lit(1)) == 2, F.max("value") - F.min("value")).alias("leader_margin"))
    b = bot2.agg(F.min_by(group_by, "value").cast("string").alias("laggard"),
                 F.min("value").alias("laggard_value"),
                 F.when(F.count(F.lit(1)) == 2, F.max("value") - F.min("value")).alias("laggard_margin"))
    return t.crossJoin(b)


def high_value_groups(df: DataFrame, group_by: str, metric: str, agg: str = "sum",
                      quantile: float = 0.9) -> DataFrame:
    """RK4: groups whose aggregate is at or above the P90 (or given) of all
    group aggregates. The threshold is one exact quantile (one row)."""
    from kestrel.operators.ranks import exact_quantiles
    from kestrel.session import cut_lineage
    # The grouped result is read twice (threshold, then filter): write it
    # once to the checkpoint folder instead of aggregating the source twice.
    g = cut_lineage(_grouped(df, [group_by], metric, agg).where(F.col("value").isNotNull()))
    thr = exact_quantiles(g, "value", [quantile], prefix="thr")
    name = thr.columns[-1]
    return g.crossJoin(F.broadcast(thr)).where(F.col("value") >= F.col(name)).select(
        group_by, "value", F.col(name).alias("threshold"))


def top_pair(df: DataFrame, group_by_1: str, group_by_2: str, metric: str, agg: str = "sum") -> DataFrame:
    """RK5: the first row of the two-key grouped result."""
    from kestrel.operators.aggregate import groupby2_agg
    return groupby2_agg(df, group_by_1, group_by_2, metric, agg, limit=1)
