"""ST20 normality: Jarque-Bera at every size; Shapiro-Wilk where it is named.

The reference changes from Shapiro-Wilk to a skewness rule above 5000
values, so that the same data pass or fail with their number; here one rule
holds. Shapiro-Wilk needs the sorted sample: ``shapiro_normality`` runs it in
``applyInPandas`` on groups whose size was counted first and is <= 5000.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.columns import numeric_col, require_columns
from kestrel.functions.special import norm_ppf, norm_sf

SW_MAX_N = 5000

# Polynomial coefficients of Royston's (1992, 1995)
# approximation to the Shapiro-Wilk weights and W distribution.
_C1 = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_GAMMA = (-2.273, 0.459)
_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -6.714e-4)
_SMALL_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_LARGE_SD = (-0.4803, -0.082676, 0.0030302)


def _poly(c, x):
    return sum(ci * x ** i for i, ci in enumerate(c))


def shapiro_wilk(x) -> tuple[float, float]:
    """(W, p) for 3 <= n <= 5000 values."""
    x = np.sort(np.asarray(x, dtype="float64"))
    n = len(x)
    if n < 3:
        return math.nan, math.nan
    rng = x[-1] - x[0]
    if rng <= 0:
        return 1.0, 1.0
    m = np.array([norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm = float(np.dot(m, m))
    a = np.zeros(n)
    if n == 3:
        a[-1] = math.sqrt(0.5)
    else:
        u = 1.0 / math.sqrt(n)
        an = m[-1] / math.sqrt(mm) + _poly(_C1, u)
        if n > 5:
            an1 = m[-2] / math.sqrt(mm) + _poly(_C2, u)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
            a[:] = m / math.sqrt(phi)
            a[-1], a[-2] = an, an1
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * an ** 2)
            a[:] = m / math.sqrt(phi)
            a[-1] = an
    half = n // 2
    a[:half] = -a[::-1][:half]
    if n % 2 == 1:
        a[half] = 0.0
    xc = x - x.mean()
    w = float(np.dot(a, x) ** 2 / np.dot(xc, xc))
    w = min(w, 1.0)
    if n == 3:
        p = max(0.0, 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
        return w, min(p, 1.0)
    if n <= 11:
        gamma = _poly(_SMALL_GAMMA, n)
        if 1 - w <= 0 or gamma - math.log(1 - w) <= 0:
            return w, 1.0 if w >= 1 else 0.0
        y = -math.log(gamma - math.log(1 - w))
        mu, sd = _poly(_SMALL_MEAN, n), math.exp(_poly(_SMALL_SD, n))
    else:
        if 1 - w <= 0:
            return w, 1.0
        ln = math.log(n)
        y = math.log(1 - w)
        mu, sd = _poly(_LARGE_MEAN, ln), math.exp(_poly(_LARGE_SD, ln))
    return w, norm_sf((y - mu) / sd)


def _moments(df: DataFrame, metric: str, by: list[str]):
    """The values ``_v`` with their keys, and per key n, the bias-corrected
    skewness and the Jarque-Bera statistic (NULL below three values and for
    constant ones)."""
    require_columns(df, metric, *by)
    vals = df.select(*by, numeric_col(df, metric).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    for c in by:
        vals = vals.where(F.col(c).isNotNull())
    if not by:
        vals = vals.withColumn("_k", F.lit(0))
    n, g = F.col("n").cast("double"), F.col("_skw")
    rows = vals.groupBy(*(by or ["_k"])).agg(F.count(F.lit(1)).alias("n"), F.skewness("_v").alias("_skw"),
                                             F.kurtosis("_v").alias("_kur"))
    enough = F.col("n") >= 3
    return vals, rows.withColumn("skew", F.when(enough, g * F.sqrt(n * (n - 1)) / (n - 2))) \
        .withColumn("_jb", F.when(enough, n / 6 * (g * g + F.col("_kur") * F.col("_kur") / 4))).drop("_skw", "_kur")


def normality(df: DataFrame, metric: str, by: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """ST20 by one rule at every size: Jarque-Bera from the moments of one
    aggregation, p = exp(-JB / 2). Rows (by..., n, method, statistic,
    p_value, skew, passed); with fewer than three values or constant ones
    ``passed`` is NULL (unknown)."""
    by = list(by or [])
    _, rows = _moments(df, metric, by)
    p = F.exp(-F.col("_jb") / 2)
    return rows.select(*by, "n", F.when(F.col("n") < 3, "insufficient").otherwise("jarque_bera").alias("method"),
                       F.col("_jb").alias("statistic"), p.alias("p_value"), "skew", (p >= alpha).alias("passed"))


def shapiro_normality(df: DataFrame, metric: str, by: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Shapiro-Wilk, where a caller names it, with ``normality``'s columns.
    Its approximation holds for 3 to 5000 values: other groups keep their
    row, with ``method`` 'insufficient' or 'too_many' and ``passed`` NULL."""
    user_by = list(by or [])
    by = user_by or ["_k"]
    vals, mom = _moments(df, metric, user_by)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in vals.schema.fields if f.name in by]
                       + ["sw_statistic double", "sw_p double"])

    def sw(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(pdf["_v"].to_numpy())
        row = {c: pdf[c].iloc[0] for c in by}
        row.update(sw_statistic=w, sw_p=p)
        return pd.DataFrame([row])

    small = mom.where((F.col("n") >= 3) & (F.col("n") <= SW_MAX_N)).select(*by)
    swr = vals.join(small, by, "left_semi").groupBy(*by).applyInPandas(sw, schema)
    out = mom.join(swr, by, "left")
    method = F.when(F.col("n") < 3, "insufficient").when(F.col("n") <= SW_MAX_N, "shapiro_wilk").otherwise("too_many")
    return out.select(*user_by, "n", method.alias("method"), F.col("sw_statistic").alias("statistic"),
                      F.col("sw_p").alias("p_value"), "skew", (F.col("sw_p") >= alpha).alias("passed"))
