"""ST1-ST9: two-group hypothesis tests, one row per test (per segment).

Each test is: label rows (ST1) -> one groupBy(by) with conditional
aggregates (counts, means, variances, success counts) -> closed form in
Column arithmetic -> tails/quantiles by an Arrow-batched UDF on the result
rows. Mann-Whitney ranks come from range-partitioned prefix sums, never a
global window.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.columns import key_equals, numeric_col, require_columns
from kestrel.functions.special import col_chi2_sf, col_norm_sf, col_t_pvalue, norm_sf
from kestrel.operators.ranks import counted_prefix, quantile_lookup, weighted_moments
from kestrel.operators.stats import effects as E

REST = "rest"


def resolve_labels(df: DataFrame, group_col: str, group_a=None, group_b=None,
                   compare_to_rest: bool = False):
    """ST1 labels. Unnamed labels: the two distinct values, alphabetical
    (Spark rows have no first-seen order). Returns (a, b)."""
    if group_a is not None and (group_b is not None or compare_to_rest):
        return str(group_a), (REST if compare_to_rest else str(group_b))
    vals = sorted(str(r[0]) for r in df.select(F.col(group_col).cast("string"))
                  .where(F.col(group_col).isNotNull()).distinct().limit(3).collect())
    if group_a is not None:
        others = [v for v in vals if v != str(group_a)]
        if compare_to_rest:
            return str(group_a), REST
        if len(others) != 1:
            raise ValueError("group_b is required when the column has more than two groups")
        return str(group_a), others[0]
    if len(vals) != 2:
        raise ValueError(f"expected exactly two groups in {group_col}, found {len(vals)}+; name them")
    return vals[0], vals[1]


def _tagged(df: DataFrame, group_col: str, a: str, b: str, by: list[str]) -> DataFrame:
    """Rows of group a or b with tag 'a'/'b'; NULL keys dropped."""
    require_columns(df, group_col, *by)
    tag = F.when(key_equals(df, group_col, a), F.lit("a"))
    if b == REST:
        tag = tag.when(F.col(group_col).isNotNull(), F.lit("b"))
    else:
        tag = tag.when(key_equals(df, group_col, b), F.lit("b"))
    out = df.withColumn("_g", tag).where(F.col("_g").isNotNull())
    for c in by:
        out = out.where(F.col(c).isNotNull())
    return out


def _moments(base: DataFrame, x: Column, by: list[str]) -> DataFrame:
    def cond(t):
        return F.when(F.col("_g") == t, x)
    aggs = []
    for t in ("a", "b"):
        aggs += [F.count(cond(t)).alias(f"n_{t}"), F.avg(cond(t)).alias(f"mean_{t}"),
                 F.var_samp(cond(t)).alias(f"var_{t}"),
                 F.count_if((F.col("_g") == t) & x.isNull()).alias(f"dropped_{t}")]
    return base.groupBy(*by).agg(*aggs) if by else base.agg(*aggs)


def _labels_cols(a, b):
    return [F.lit(a).alias("group_a"), F.lit(b).alias("group_b")]


def welch_t_test(df: DataFrame, group_col: str, metric: str, group_a=None, group_b=None,
                 compare_to_rest: bool = False, alpha: float = 0.05, alternative: str = "two-sided",
                 by: list[str] | None = None) -> DataFrame:
    """ST4: Welch's unequal-variance t-test of mean(a) vs mean(b)."""
    by = list(by or [])
    a, b = resolve_labels(df, group_col, group_a, group_b, compare_to_rest)
    base = _tagged(df, group_col, a, b, by)
    m = _moments(base, numeric_col(df, metric).cast("double"), by)
    na, nb, ma, mb, va, vb = (F.col(c) for c in ("n_a", "n_b", "mean_a", "mean_b", "var_a", "var_b"))
    se = F.sqrt(va / na + vb / nb)
    t = F.when(se > 0, (ma - mb) / se)
    dof = E.satterthwaite_df(va, na, vb, nb)
    lo, hi = E.diff_means_ci(ma, va, na, mb, vb, nb, alpha)
    d = E.cohens_d(ma, va, na, mb, vb, nb)
    out = m.select(*by, F.lit("welch_t_test").alias("method"), *_labels_cols(a, b),
                   "n_a", "n_b", "mean_a", "mean_b", (ma - mb).alias("mean_difference"),
                   t.alias("statistic"), F.when((na >= 2) & (nb >= 2), dof).alias("df"),
                   lo.alias("ci_lower"), hi.alias("ci_upper"), d.alias("cohens_d"),
                   (F.least(na, nb) >= 2).alias("reliable"))
    out = out.withColumn("p_value", col_t_pvalue(F.col("statistic"), F.col("df"), alternative))
    return out.select("*", E.cohens_d_label(F.col("cohens_d")).alias("effect_label"),
                      E.decision(F.col("p_value"), alpha, F.col("reliable")).alias("decision"),
                      F.lit(alpha).alias("alpha"), F.lit(1.0 - alpha).alias("confidence_level"))


def paired_t_test(df: DataFrame, group_col: str, metric: str, pair_id_col: str, group_a=None,
                  group_b=None, alpha: float = 0.05, alternative: str = "two-sided",
                  by: list[str] | None = None) -> DataFrame:
    """ST5 with J7 pair matching: mean metric per (pair, group), pairs with
    both sides, t on the differences. ``ci_lower/ci_upper`` and
    ``cohens_d`` follow the reference (independent-samples formulas on the
    paired columns); ``paired_ci_*`` and ``cohens_dz`` are the paired ones."""
    by = list(by or [])
    a, b = resolve_labels(df, group_col, group_a, group_b)
    base = _tagged(df, group_col, a, b, by).where(F.col(pair_id_col).isNotNull())
    x = numeric_col(df, metric).cast("double")
    pairs = (base.groupBy(*by, pair_id_col)
             .agg(F.avg(F.when(F.col("_g") == "a", x)).alias("_xa"), F.avg(F.when(F.col("_g") == "b", x)).alias("_xb"))
             .where(F.col("_xa").isNotNull() & F.col("_xb").isNotNull())
             .withColumn("_d", F.col("_xa") - F.col("_xb")))
    aggs = [F.count(F.lit(1)).alias("n_pairs"), F.avg("_d").alias("mean_difference"), F.stddev_samp("_d").alias("sd_d"),
            F.avg("_xa").alias("mean_a"), F.var_samp("_xa").alias("var_a"),
            F.avg("_xb").alias("mean_b"), F.var_samp("_xb").alias("var_b")]
    s = pairs.groupBy(*by).agg(*aggs) if by else pairs.agg(*aggs)
    n, md, sd = F.col("n_pairs"), F.col("mean_difference"), F.col("sd_d")
    ma, mb, va, vb = F.col("mean_a"), F.col("mean_b"), F.col("var_a"), F.col("var_b")
    t = F.when((n >= 2) & (sd > 0), md / (sd / F.sqrt(n)))
    lo, hi = E.diff_means_ci(ma, va, n, mb, vb, n, alpha)
    plo, phi = E.mean_ci(md, sd, n, alpha)
    out = s.select(*by, F.lit("paired_t_test").alias("method"), *_labels_cols(a, b), "n_pairs",
                   "mean_a", "mean_b", "mean_difference", t.alias("statistic"),
                   F.when(n >= 2, (n - 1).cast("double")).alias("df"),
                   lo.alias("ci_lower"), hi.alias("ci_upper"), plo.alias("paired_ci_lower"), phi.alias("paired_ci_upper"),
                   E.cohens_d(ma, va, n, mb, vb, n).alias("cohens_d"),
                   F.when(sd > 0, md / sd).otherwise(0.0).alias("cohens_dz"), (n >= 2).alias("reliable"))
    out = out.withColumn("p_value", col_t_pvalue(F.col("statistic"), F.col("df"), alternative))
    return out.select("*", E.decision(F.col("p_value"), alpha, F.col("reliable")).alias("decision"),
                      F.lit(alpha).alias("alpha"))


def _mwu_exact_sf(u_max: float, m: int, n: int) -> float:
    """P(U >= u_max) under H0 for sample sizes m, n with no ties: the
    coefficients of the Gaussian binomial [m+n choose m]_q."""
    m, n = int(min(m, n)), int(max(m, n))
    poly = np.zeros(m * n + 1)
    poly[0] = 1.0
    # prod_{i=1..m} (1 - q^(n+i)) / (1 - q^i)
    for i in range(1, m + 1):
        shifted = np.zeros_like(poly)
        shifted[n + i:] = poly[:len(poly) - (n + i)]
        poly = poly - shifted
        for k in range(i, len(poly)):
            poly[k] += poly[k - i]
    total = poly.sum()
    k = int(math.ceil(u_max - 1e-9))
    return float(poly[k:].sum() / total) if k <= m * n else 0.0


@F.pandas_udf(T.DoubleType())
def _mwu_p_udf(u1: pd.Series, na: pd.Series, nb: pd.Series, ties: pd.Series, exact: pd.Series,
               alt: pd.Series) -> pd.Series:
    out = []
    for u, m, n, tt, ex, al in zip(u1, na, nb, ties, exact, alt):
        if any(v is None or (isinstance(v, float) and math.isnan(v)) for v in (u, m, n)) or m == 0 or n == 0:
            out.append(math.nan)
            continue
        u2 = m * n - u
        if ex:
            if al == "greater":
                p = _mwu_exact_sf(u, m, n)
            elif al == "less":
                p = _mwu_exact_sf(u2, m, n)
            else:
                p = min(1.0, 2.0 * _mwu_exact_sf(max(u, u2), m, n))
            out.append(p)
            continue
        big_n = m + n
        mu = m * n / 2.0
        var = m * n / 12.0 * ((big_n + 1) - tt / (big_n * (big_n - 1)))
        if var <= 0:
            out.append(math.nan)
            continue
        s = math.sqrt(var)
        if al == "greater":
            p = norm_sf((u - mu - 0.5) / s)
        elif al == "less":
            p = norm_sf((u2 - mu - 0.5) / s)
        else:
            p = min(1.0, 2.0 * norm_sf((max(u, u2) - mu - 0.5) / s))
        out.append(p)
    return pd.Series(out, dtype="float64")


def mann_whitney_u(df: DataFrame, group_col: str, metric: str, group_a=None, group_b=None,
                   compare_to_rest: bool = False, alpha: float = 0.05, alternative: str = "two-sided",
                   by: list[str] | None = None) -> DataFrame:
    """ST6: U for group a = sum over distinct values v of
    n_a(v) * (#b below v + n_b(v) / 2). The '#b below v' prefix counts come
    from range partitions over (by, value) plus partition offsets, so a hot
    segment is spread over many tasks. Normal approximation with tie
    correction and continuity 0.5; exact null distribution when a side has
    <= 8 values and there are no ties."""
    by = list(by or [])
    a, b = resolve_labels(df, group_col, group_a, group_b, compare_to_rest)
    base = _tagged(df, group_col, a, b, by)
    x = numeric_col(df, metric).cast("double")
    # One pass: per distinct value the two group counts and their prefix
    # sums; U, ties, medians and moments all come from that table.
    pre = counted_prefix(base.withColumn("_x", x), "_x", by,
                         {"_na": (F.col("_g") == "a").cast("long"), "_nb": (F.col("_g") == "b").cast("long")})
    t = F.col("_na") + F.col("_nb")
    aggs = [F.sum(F.col("_na") * (F.col("_nb_before") + F.col("_nb") / 2.0)).alias("u_statistic"),
            F.sum(F.pow(t.cast("double"), 3) - t).alias("tie_term"), F.max(t).alias("_maxt")]
    u = pre.groupBy(*by).agg(*aggs) if by else pre.agg(*aggs)
    # Both groups' (value, count) columns stacked: one moments pass and one
    # median lookup serve a and b together.
    long = pre.select(*by, "_v", F.inline(F.array(
        F.struct(F.lit("a").alias("_t"), F.col("_na").alias("_cnt"), F.col("_na_before").alias("_cnt_before")),
        F.struct(F.lit("b").alias("_t"), F.col("_nb").alias("_cnt"), F.col("_nb_before").alias("_cnt_before")))))
    mom = weighted_moments(long, [*by, "_t"]).join(
        quantile_lookup(long, [*by, "_t"], [0.5], prefix="med"), [*by, "_t"], "left")
    stats_cols = []
    for t in ("a", "b"):
        for c, name in (("count", "n"), ("mean", "mean"), ("var", "var"), ("med0_5", "median")):
            stats_cols.append(F.max(F.when(F.col("_t") == t, F.col(c))).alias(f"{name}_{t}"))
    per = mom.groupBy(*by).agg(*stats_cols) if by else mom.agg(*stats_cols)
    j = u.join(per, by, "left") if by else u.crossJoin(per)
    j = j.withColumn("n_a", F.coalesce(F.col("n_a"), F.lit(0))).withColumn("n_b", F.coalesce(F.col("n_b"), F.lit(0)))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")      # their products pass 2**63
    exact = (F.least(na, nb) <= 8) & (F.col("_maxt") <= 1)
    mu = na * nb / 2.0
    sigma = F.sqrt(na * nb / 12.0 * ((na + nb + 1) - F.col("tie_term") / ((na + nb) * (na + nb - 1))))
    umax = F.greatest(F.col("u_statistic"), na * nb - F.col("u_statistic"))
    ma, mb, va, vb = F.col("mean_a"), F.col("mean_b"), F.col("var_a"), F.col("var_b")
    lo, hi = E.diff_means_ci(ma, va, na, mb, vb, nb, alpha)
    out = j.select(*by, F.lit("mann_whitney_u").alias("method"), *_labels_cols(a, b), "n_a", "n_b",
                   "u_statistic", "tie_term", F.when(sigma > 0, (umax - mu - 0.5) / sigma).alias("z"),
                   exact.alias("exact"), "median_a", "median_b", (ma - mb).alias("mean_difference"),
                   lo.alias("ci_lower"), hi.alias("ci_upper"), E.cohens_d(ma, va, na, mb, vb, nb).alias("cohens_d"),
                   (F.least(na, nb) >= 2).alias("reliable"))
    out = out.withColumn("p_value", _mwu_p_udf(F.col("u_statistic"), F.col("n_a").cast("double"),
                                               F.col("n_b").cast("double"), F.col("tie_term"), F.col("exact"),
                                               F.lit(alternative)))
    return out.select("*", E.decision(F.col("p_value"), alpha, F.col("reliable")).alias("decision"),
                      F.lit(alpha).alias("alpha"))


def chi_square_independence(df: DataFrame, left: str, right: str, alpha: float = 0.05,
                            by: list[str] | None = None) -> DataFrame:
    """ST7: chi-square test of independence on the full contingency table.

    Only observed (non-zero) cells are materialised: the absent cells
    contribute sum(E) = N - sum(E over observed cells), so no row x column
    cross join is needed. With one degree of freedom (2x2) the Yates
    correction shrinks every |O-E| (equal in all four cells) by
    min(0.5, |O-E|)."""
    by = list(by or [])
    require_columns(df, left, right, *by)
    base = df.select(*by, F.col(left).cast("string").alias("_l"), F.col(right).cast("string").alias("_r"))
    base = base.where(F.col("_l").isNotNull() & F.col("_r").isNotNull())
    for c in by:
        base = base.where(F.col(c).isNotNull())
    cells = base.groupBy(*by, "_l", "_r").agg(F.count(F.lit(1)).alias("_o"))
    rows = cells.groupBy(*by, "_l").agg(F.sum("_o").alias("_rt"))
    cols = cells.groupBy(*by, "_r").agg(F.sum("_o").alias("_ct"))
    tot_aggs = [F.sum("_o").alias("_n")]
    tot = cells.groupBy(*by).agg(*tot_aggs) if by else cells.agg(*tot_aggs)
    rstat = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_levels_left"), F.min("_rt").alias("_rmin"),
                                  F.sum(F.log("_rt")).alias("_rlog")) if by else \
        rows.agg(F.count(F.lit(1)).alias("n_levels_left"), F.min("_rt").alias("_rmin"), F.sum(F.log("_rt")).alias("_rlog"))
    cstat = cols.groupBy(*by).agg(F.count(F.lit(1)).alias("n_levels_right"), F.min("_ct").alias("_cmin"),
                                  F.sum(F.log("_ct")).alias("_clog")) if by else \
        cols.agg(F.count(F.lit(1)).alias("n_levels_right"), F.min("_ct").alias("_cmin"), F.sum(F.log("_ct")).alias("_clog"))
    e = cells.join(rows, [*by, "_l"]).join(cols, [*by, "_r"])
    e = (e.join(tot, by) if by else e.crossJoin(F.broadcast(tot))).withColumn("_e", F.col("_rt").cast("double") * F.col("_ct") / F.col("_n"))
    obs_aggs = [F.sum(F.pow(F.col("_o") - F.col("_e"), 2) / F.col("_e")).alias("_x_obs"), F.sum("_e").alias("_e_obs")]
    obs = e.groupBy(*by).agg(*obs_aggs) if by else e.agg(*obs_aggs)
    j = tot
    for part in (rstat, cstat, obs):
        j = j.join(part, by) if by else j.crossJoin(part)
    n = F.col("_n")
    chi_unc = F.col("_x_obs") + (n - F.col("_e_obs"))
    dof = (F.col("n_levels_left") - 1) * (F.col("n_levels_right") - 1)
    # 2x2: |O-E| = D in every cell and sum(1/E) = N^3 / (r1 r2 c1 c2).
    inv_sum = F.exp(3 * F.log(n) - F.col("_rlog") - F.col("_clog"))
    dd = F.sqrt(chi_unc / inv_sum)
    chi_yates = F.pow(dd - F.least(F.lit(0.5), dd), 2) * inv_sum
    chi = F.when(dof == 1, chi_yates).otherwise(chi_unc)
    min_e = F.col("_rmin").cast("double") * F.col("_cmin") / n
    out = j.select(*by, F.lit("chi_square_independence").alias("method"), n.alias("n"), "n_levels_left",
                   "n_levels_right", chi.alias("statistic"), dof.cast("long").alias("dof"),
                   min_e.alias("min_expected"), (dof == 1).alias("yates_correction"))
    out = out.withColumn("cramers_v", E.cramers_v(F.col("statistic"), F.col("n"), F.col("n_levels_left"),
                                                  F.col("n_levels_right")))
    out = out.withColumn("p_value", F.when(F.col("dof") > 0, col_chi2_sf(F.col("statistic"), F.col("dof"))))
    reliable = F.col("min_expected") >= 5
    return out.select("*", E.cramers_v_label(F.col("cramers_v")).alias("effect_label"), reliable.alias("reliable"),
                      E.decision(F.col("p_value"), alpha, reliable).alias("decision"), F.lit(alpha).alias("alpha"))


def _success(df: DataFrame, metric: str, success_value) -> Column:
    c = F.col(metric)
    dt = df.schema[metric].dataType
    if isinstance(dt, T.BooleanType):
        return c.cast("int")
    return F.when(key_equals(df, metric, success_value), 1).otherwise(0)


def _binary_ok(df: DataFrame, metric: str, success_value) -> Column:
    """ST23: value is 0, 1, True/False or the success value."""
    dt = df.schema[metric].dataType
    if isinstance(dt, T.BooleanType):
        return F.lit(True)
    c = F.col(metric)
    ok = key_equals(df, metric, success_value)
    if isinstance(dt, T.NumericType):
        return ok | c.isin(0, 1)
    return ok | c.cast("string").isin("0", "1", "True", "False", "true", "false")


def two_proportion_z_test(df: DataFrame, group_col: str, metric: str, group_a=None, group_b=None,
                          compare_to_rest: bool = False, success_value=1, alpha: float = 0.05,
                          by: list[str] | None = None) -> DataFrame:
    """ST8: pooled two-proportion z-test (two-sided), unpooled difference
    CI, Wilson CI of group b, relative lift and odds ratio."""
    by = list(by or [])
    a, b = resolve_labels(df, group_col, group_a, group_b, compare_to_rest)
    base = _tagged(df, group_col, a, b, by).where(F.col(metric).isNotNull())
    s = _success(df, metric, success_value)
    ok = _binary_ok(df, metric, success_value)
    aggs = []
    for t in ("a", "b"):
        g = F.col("_g") == t
        aggs += [F.count_if(g).alias(f"n_{t}"), F.coalesce(F.sum(F.when(g, s)), F.lit(0)).alias(f"successes_{t}"),
                 F.count_if(g & ~ok).alias(f"non_binary_{t}")]
    m = base.groupBy(*by).agg(*aggs) if by else base.agg(*aggs)
    na, nb, xa, xb = F.col("n_a"), F.col("n_b"), F.col("successes_a"), F.col("successes_b")
    pa = F.when(na > 0, xa / na).otherwise(0.0)
    pb = F.when(nb > 0, xb / nb).otherwise(0.0)
    pooled = (xa + xb) / F.greatest(F.lit(1), na + nb)
    se = F.sqrt(F.greatest(F.lit(1e-12), pooled * (1 - pooled) * (1.0 / F.greatest(F.lit(1), na) + 1.0 / F.greatest(F.lit(1), nb))))
    z = (pa - pb) / se
    lo, hi = E.diff_proportions_ci(xa, na, xb, nb, alpha)
    wlo, whi = E.wilson_ci(xb, nb, alpha)
    lift = E.relative_lift(pa, pb)
    orr = E.odds_ratio(xa, na - xa, xb, nb - xb)
    reliable = (na > 0) & (nb > 0) & (F.col("non_binary_a") == 0) & (F.col("non_binary_b") == 0)
    out = m.select(*by, F.lit("two_proportion_z_test").alias("method"), *_labels_cols(a, b), "n_a", "n_b",
                   "successes_a", "successes_b", pa.alias("rate_a"), pb.alias("rate_b"),
                   (pa - pb).alias("rate_difference"), z.alias("statistic"), lo.alias("ci_lower"), hi.alias("ci_upper"),
                   wlo.alias("control_ci_lower"), whi.alias("control_ci_upper"), lift.alias("relative_lift"),
                   orr.alias("odds_ratio"),
                   (F.least(xa, na - xa, xb, nb - xb) >= 5).alias("normal_approximation_ok"),
                   reliable.alias("reliable"))
    out = out.withColumn("p_value", F.least(F.lit(1.0), 2.0 * col_norm_sf(F.abs(F.col("statistic")))))
    return out.select("*", E.lift_label(F.col("relative_lift")).alias("lift_label"),
                      E.odds_ratio_label(F.col("odds_ratio")).alias("odds_ratio_label"),
                      E.decision(F.col("p_value"), alpha, F.col("reliable")).alias("decision"),
                      F.lit(alpha).alias("alpha"))


def levene_test(df: DataFrame, group_col: str, metric: str, group_a=None, group_b=None,
                compare_to_rest: bool = False, alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """ST21: Brown-Forsythe (median-centred Levene) for two groups: medians
    per group (exact quantiles, joined back), then a one-way F on
    |x - median|."""
    from kestrel.functions.special import col_f_sf
    by = list(by or [])
    a, b = resolve_labels(df, group_col, group_a, group_b, compare_to_rest)
    base = _tagged(df, group_col, a, b, by)
    keys = by + ["_g"]
    pre = counted_prefix(base.withColumn("_x", numeric_col(df, metric).cast("double")), "_x", keys)
    med = quantile_lookup(pre, keys, [0.5], prefix="med")
    z = pre.join(med, keys).select(*keys, "_cnt", F.abs(F.col("_v") - F.col("med0_5")).alias("_z"))
    zb = z.groupBy(*keys).agg(F.sum("_cnt").alias("_n"), (F.sum(F.col("_cnt") * F.col("_z")) / F.sum("_cnt")).alias("_zb"))
    g = z.join(zb, keys).groupBy(*keys, "_n", "_zb").agg(
        (F.sum(F.col("_cnt") * F.pow(F.col("_z") - F.col("_zb"), 2)) / F.col("_n")).alias("_vv"))
    aggs = [F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_zb") * F.col("_zb")).alias("_s2"),
            F.sum(F.col("_n") * F.col("_zb")).alias("_s1"), F.sum(F.col("_n") * F.col("_vv")).alias("_w"),
            F.count(F.lit(1)).alias("_k")]
    s = g.groupBy(*by).agg(*aggs) if by else g.agg(*aggs)
    n, k = F.col("n"), F.col("_k")
    fstat = F.when(F.col("_w") > 0, (n - k) / (k - 1) * (F.col("_s2") - F.pow(F.col("_s1"), 2) / n) / F.col("_w"))
    out = s.where(k == 2).select(*by, F.lit("levene_median").alias("method"), *_labels_cols(a, b), "n",
                                 fstat.alias("statistic"), (k - 1).cast("double").alias("df1"),
                                 (n - k).cast("double").alias("df2"))
    out = out.withColumn("p_value", col_f_sf(F.col("statistic"), F.col("df1"), F.col("df2")))
    return out.select("*", (F.col("p_value") >= alpha).alias("passed"), F.lit(alpha).alias("alpha"))


def tukey_outliers(df: DataFrame, metric: str, by: list[str] | None = None, k: float = 1.5,
                   warn_share: float = 0.05) -> DataFrame:
    """ST22: share of values outside [Q1 - k*IQR, Q3 + k*IQR] per group
    (exact quartiles; n < 4 -> unknown; IQR 0 -> share 0)."""
    by = list(by or [])
    require_columns(df, metric, *by)
    vals = df.select(*by, numeric_col(df, metric).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    for c in by:
        vals = vals.where(F.col(c).isNotNull())
    pre = counted_prefix(vals, "_v", by)
    q = quantile_lookup(pre, by, [0.25, 0.75], prefix="q")
    j = pre.join(q, by) if by else pre.crossJoin(F.broadcast(q))
    iqr = F.col("q0_75") - F.col("q0_25")
    lo, hi = F.col("q0_25") - k * iqr, F.col("q0_75") + k * iqr
    aggs = [F.sum("_cnt").alias("n"), F.max("q0_25").alias("q1"), F.max("q0_75").alias("q3"),
            F.coalesce(F.sum(F.when((iqr > 0) & ((F.col("_v") < lo) | (F.col("_v") > hi)), F.col("_cnt"))),
                       F.lit(0)).alias("n_outliers")]
    s = j.groupBy(*by).agg(*aggs) if by else j.agg(*aggs)
    share = F.when(F.col("n") >= 4, F.col("n_outliers") / F.col("n"))
    return s.select(*by, "n", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"),
                    (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lower_fence"),
                    (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("upper_fence"),
                    "n_outliers", share.alias("outlier_share"),
                    F.when(F.col("n") < 4, F.lit(None).cast("boolean")).otherwise(share <= warn_share).alias("passed"))
