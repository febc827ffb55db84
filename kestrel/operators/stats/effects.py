"""CI1-CI6, EF1-EF5 and DE1 as Column expressions over aggregate rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kestrel.functions.special import col_norm_ppf, col_t_ppf


def satterthwaite_df(va: Column, na: Column, vb: Column, nb: Column) -> Column:
    num = F.pow(va / na + vb / nb, 2)
    den = F.when(na > 1, F.pow(va / na, 2) / (na - 1)).otherwise(0.0) + \
        F.when(nb > 1, F.pow(vb / nb, 2) / (nb - 1)).otherwise(0.0)
    return F.when(den != 0, num / den).otherwise(F.greatest(F.lit(1), F.least(na, nb) - 1).cast("double"))


def diff_means_ci(ma, va, na, mb, vb, nb, alpha: float):
    """CI2: Welch-Satterthwaite interval for mean(a) - mean(b);
    degenerate (point) when a group has <= 1 value."""
    diff = ma - mb
    se = F.sqrt(va / na + vb / nb)
    crit = col_t_ppf(F.lit(1.0 - alpha / 2.0), satterthwaite_df(va, na, vb, nb))
    ok = (na > 1) & (nb > 1)
    margin = F.when(ok, crit * se).otherwise(0.0)
    return diff - margin, diff + margin


def mean_ci(mean: Column, sd: Column, n: Column, alpha: float):
    """CI1: t interval for a mean; degenerate when n <= 1."""
    crit = col_t_ppf(F.lit(1.0 - alpha / 2.0), (n - 1).cast("double"))
    margin = F.when(n > 1, crit * sd / F.sqrt(n)).otherwise(0.0)
    return mean - margin, mean + margin


def wilson_ci(x: Column, n: Column, alpha: float):
    """CI3: Wilson score interval clipped to [0, 1]; (0, 0) when n = 0."""
    z = col_norm_ppf(F.lit(1.0 - alpha / 2.0))
    p = x / n
    denom = 1.0 + z * z / n
    center = (p + z * z / (2.0 * n)) / denom
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / denom
    lo = F.when(n > 0, F.greatest(F.lit(0.0), center - margin)).otherwise(0.0)
    hi = F.when(n > 0, F.least(F.lit(1.0), center + margin)).otherwise(0.0)
    return lo, hi


def diff_proportions_ci(xa, na, xb, nb, alpha: float):
    """CI4: unpooled Wald interval for p_a - p_b."""
    z = col_norm_ppf(F.lit(1.0 - alpha / 2.0))
    pa = F.when(na > 0, xa / na).otherwise(0.0)
    pb = F.when(nb > 0, xb / nb).otherwise(0.0)
    se = F.sqrt(pa * (1 - pa) / na + pb * (1 - pb) / nb)
    ok = (na > 0) & (nb > 0)
    margin = F.when(ok, z * se).otherwise(0.0)
    return pa - pb - margin, pa - pb + margin


def relative_lift_ci(lo: Column, hi: Column, baseline: Column):
    """CI5: an absolute interval divided by the baseline; NULL when the
    baseline is ~0."""
    ok = F.abs(baseline) >= 1e-12
    return F.when(ok, lo / baseline), F.when(ok, hi / baseline)


def cohens_d(ma, va, na, mb, vb, nb) -> Column:
    """EF1: pooled-sd standardised difference; 0 when undefined."""
    pooled = F.sqrt(((na - 1) * va + (nb - 1) * vb) / F.greatest(F.lit(1), na + nb - 2))
    return F.when((na >= 2) & (nb >= 2) & (pooled != 0), (ma - mb) / pooled).otherwise(0.0)


def cohens_d_label(d: Column) -> Column:
    a = F.abs(d)
    return (F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium")
            .otherwise("large"))


def relative_lift(treatment: Column, control: Column) -> Column:
    """EF2: (t - c) / c, 0.0 when the control is ~0."""
    return F.when(F.abs(control) < 1e-12, F.lit(0.0)).otherwise((treatment - control) / control)


def lift_label(v: Column) -> Column:
    return F.when(v < 0, "negative").when(F.abs(v) < 0.01, "flat").otherwise("positive")


def cramers_v(chi2: Column, n: Column, r: Column, c: Column) -> Column:
    denom = F.least(r - 1, c - 1)
    return F.when((n > 0) & (denom > 0), F.sqrt(chi2 / (n * denom))).otherwise(0.0)


def cramers_v_label(v: Column) -> Column:
    return (F.when(v < 0.1, "weak").when(v < 0.3, "small-to-moderate").when(v < 0.5, "moderate")
            .otherwise("strong"))


def odds_ratio(sa, fa, sb, fb) -> Column:
    """EF4: Haldane-corrected odds ratio (+0.5 in every cell)."""
    return ((sa + 0.5) * (fb + 0.5)) / ((fa + 0.5) * (sb + 0.5))


def odds_ratio_label(v: Column) -> Column:
    return (F.when(v < 0.9, "lower odds in treatment").when(v > 1.1, "higher odds in treatment")
            .otherwise("roughly neutral odds"))


def decision(p: Column, alpha: float, reliable: Column) -> Column:
    """DE1."""
    return (F.when(~reliable | p.isNull() | F.isnan(p), "not_reliable")
            .when(p < alpha, "reject_null").otherwise("fail_to_reject_null"))
