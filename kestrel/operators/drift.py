"""Drift monitoring: how far a window's values and ids moved from another's.

Each day is read once, into a KLL sketch of its values and a theta sketch of
its ids; any two windows are then compared from the days' sketches. The exact
two-sample Kolmogorov-Smirnov statistic, from prefix counts over
range-partitioned values, is the cross-check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators.ranks import counted_prefix

#: Items of a KLL sketch (rank error about 0.1 %) and log2 of the entries of
#: a theta sketch (relative standard error about 0.8 %).
KLL_ITEMS, THETA_BITS = 4096, 14
#: Quantiles by which a sketch's distribution is read (steps of 0.25 %).
GRID = 400


def daily_sketches(df: DataFrame, ts_col: str, value_col: str, id_col: str, by: list[str] | None = None) -> DataFrame:
    """(by..., day, n, kll, theta): one row per day and group from a single
    scan. Sketches are partial aggregates of bounded size, so a hot group
    shuffles one row per task. Rows without time, group or finite value are
    left out of the values, ids that are null of the ids."""
    by = list(by or [])
    v = F.col(value_col).cast("double")
    v = F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)
    rows = df.select(*by, F.to_date(ts_col).alias("day"), v.alias("_v"), F.col(id_col).alias("_id")).where("day IS NOT NULL")
    for b in by:
        rows = rows.where(F.col(b).isNotNull())
    return rows.groupBy(*by, "day").agg(F.count("_v").alias("n"), F.kll_sketch_agg_double("_v", KLL_ITEMS).alias("kll"),
                                        F.theta_sketch_agg("_id", THETA_BITS).alias("theta"))


def window_sketches(days: DataFrame, first, last, by: list[str] | None = None) -> DataFrame:
    """One row per group for the days from ``first`` to ``last`` (both in),
    merged from ``daily_sketches``."""
    some = days.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & (F.col("n") > 0))
    return some.groupBy(*(by or [])).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("kll").alias("kll"),
                                         F.theta_union_agg("theta", THETA_BITS).alias("theta"))


def drift_report(days: DataFrame, reference: tuple, current: tuple, by: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Per group that has values in both windows (pairs of first and last
    day): n_ref, n_cur, ks (the largest distance of the two distributions,
    within about 0.01), psi (population stability index over ``bins``
    reference quantiles, shares of at least 1e-4), median_ref, median_cur,
    new_ids (share of the current ids that the reference window lacks)."""
    by = list(by or [])
    a = window_sketches(days, *reference, by).select(*by, F.col("n").alias("n_ref"), F.col("kll").alias("ka"), F.col("theta").alias("ta"))
    b = window_sketches(days, *current, by).select(*by, F.col("n").alias("n_cur"), F.col("kll").alias("kb"), F.col("theta").alias("tb"))
    both = a.join(b, by) if by else a.crossJoin(b)          # without groups, one row on each side
    both = both.where("n_ref > 0 AND n_cur > 0")
    ranks = F.array(*[F.lit((i + 0.5) / GRID) for i in range(GRID)])
    both = both.withColumn("qa", F.kll_sketch_get_quantile_double("ka", ranks)).withColumn("qb", F.kll_sketch_get_quantile_double("kb", ranks))

    def share(q, x):
        """The share of a distribution at or below x, from its quantiles."""
        return F.size(F.filter(q, lambda y: y <= x)) / F.lit(float(GRID))
    points = F.array_distinct(F.concat("qa", "qb"))
    both = both.withColumn("ks", F.array_max(F.transform(points, lambda x: F.abs(share(F.col("qa"), x) - share(F.col("qb"), x)))))
    cuts = F.kll_sketch_get_quantile_double("ka", F.array(*[F.lit(i / bins) for i in range(1, bins)]))
    both = both.withColumn("cuts", F.array_distinct(cuts))

    def shares(q):
        at = F.transform("cuts", lambda x: share(F.col(q), x))
        upper, lower = F.concat(at, F.array(F.lit(1.0))), F.concat(F.array(F.lit(0.0)), at)
        return F.zip_with(upper, lower, lambda p, r: F.greatest(p - r, F.lit(1e-4)))
    psi = F.aggregate(F.zip_with(shares("qa"), shares("qb"), lambda p, q: (q - p) * F.log(q / p)), F.lit(0.0), lambda s, x: s + x)
    half = F.lit(0.5)
    fresh = F.theta_sketch_estimate(F.theta_difference("tb", "ta")) / F.theta_sketch_estimate("tb")
    return both.select(*by, "n_ref", "n_cur", "ks", psi.alias("psi"), F.kll_sketch_get_quantile_double("ka", half).alias("median_ref"),
                       F.kll_sketch_get_quantile_double("kb", half).alias("median_cur"), fresh.alias("new_ids"))


def ks_exact(df: DataFrame, value_col: str, current, by: list[str] | None = None) -> DataFrame:
    """Per group: n_ref, n_cur, ks (exact) and p_value (asymptotic) of the
    two-sample Kolmogorov-Smirnov test between rows where ``current`` (a
    boolean column) is false and true. Null and NaN values, and rows where
    it is null, are left out; groups that lack one side are, too.

    Rows are counted per distinct value and side; prefix sums over range
    partitions give both distributions at every value, so neither a hot
    group nor a hot value meets in one task."""
    by = list(by or [])
    live = df.where(~F.isnan(F.col(value_col).cast("double")) & current.isNotNull())
    pre = counted_prefix(live, value_col, by, {"cur": current.cast("long"), "ref": (~current).cast("long")})
    total = (pre.groupBy(*by) if by else pre.groupBy()).agg(F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur")).where("n_ref > 0 AND n_cur > 0")
    j = pre.join(total, by) if by else pre.crossJoin(F.broadcast(total))
    # exact in integers until the last division
    gap = F.abs((F.col("ref_before") + F.col("ref")) * F.col("n_cur").cast("decimal(19,0)") -
                (F.col("cur_before") + F.col("cur")) * F.col("n_ref").cast("decimal(19,0)"))
    out = j.groupBy(*by, "n_ref", "n_cur").agg(F.max(gap).alias("_gap"))
    ks = (F.col("_gap").cast("double") / F.col("n_ref")) / F.col("n_cur")
    out = out.select(*by, "n_ref", "n_cur", ks.alias("ks"))
    x = F.col("ks") * F.sqrt(F.col("n_ref").cast("double") * F.col("n_cur") / (F.col("n_ref") + F.col("n_cur")))
    # the two series of the limit law: one converges at once where the other does not
    tail = sum((2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * x * x) for k in range(1, 8))
    head = F.lit((2 * 3.141592653589793) ** 0.5) / x * sum(F.exp(-((2 * k - 1) ** 2) * 9.869604401089358 / (8.0 * x * x)) for k in range(1, 8))
    p = F.when(x <= 0, 1.0).when(x < 1.0, 1.0 - head).otherwise(tail)
    return out.withColumn("p_value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))
