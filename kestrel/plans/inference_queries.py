"""p-values, intervals, effect labels and decisions of the tests, compared
with SQL that computes the tails on its own: Simpson's rule over the density
(with ``lgamma``) for t, F(1, n) and the normal, the finite series for
chi-square of even degrees, and the expansion of the t quantile around the
normal one."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from kestrel.functions.columns import round_doubles as R
from kestrel.operators.stats import assumptions as AS
from kestrel.operators.stats import dispatch as DS
from kestrel.operators.stats import intervals as CI
from kestrel.operators.stats import ols as OLS
from kestrel.operators.stats import tests as HT
from kestrel.plans.registry import (_OLS_CTE, AB_CTE, Z975, _lineitem_fit, _mwu_sql, _welch_sql, register)
from kestrel.sources.tables import ab_events, table

_STEPS = 400


def _simpson(density: str, end: str) -> str:
    """The integral of ``density`` (of x) from 0 to ``end``."""
    weight = f"(CASE WHEN i IN (0, {_STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return (f"({end} / {3 * _STEPS} * list_sum(list_transform(range(0, {_STEPS + 1}), lambda i: {weight} * "
            f"{density.replace('x', f'({end} * i / {_STEPS})')})))")


def t_two_sided(t: str, df: str) -> str:
    front = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi())"
    return f"greatest(0, 1 - 2 * {front} * {_simpson(f'power(1 + x * x / {df}, -({df} + 1) / 2.0)', f'abs({t})')})"


def normal_two_sided(z: str) -> str:
    """``exp`` has an x of its own, so the density is a power of e."""
    return f"greatest(0, 1 - 2 / sqrt(2 * pi()) * {_simpson('power(2.718281828459045, -x * x / 2)', f'abs({z})')})"


def t_975(df: str) -> str:
    """The 97.5 % quantile (an error of about df ** -5)."""
    z = float(Z975)
    g = [z, (z ** 3 + z) / 4, (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96, (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384,
         (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160]
    return "(" + " + ".join(f"{c!r}::DOUBLE / power({df}, {k})" for k, c in enumerate(g)) + ")"


def _decide(p: str) -> str:
    return f"CASE WHEN {p} < 0.05 THEN 'reject_null' ELSE 'fail_to_reject_null' END"


def _welch_raw(by):
    """The registered Welch statistics, not rounded."""
    return re.sub(r"ROUND\((.*?), 6\)", r"\1", _welch_sql(by))


def _label(d):
    return f"CASE WHEN abs({d}) < 0.2 THEN 'negligible' WHEN abs({d}) < 0.5 THEN 'small' WHEN abs({d}) < 0.8 THEN 'medium' ELSE 'large' END"


@register("welch_inference", f"""
WITH w AS ({_welch_raw("event_type")}),
p AS (SELECT *, {t_two_sided("statistic", "df")} AS p, {t_975("df")} * abs(mean_difference / statistic) AS half FROM w)
SELECT event_type, round(p, 6) AS p_value, round(mean_difference - half, 6) AS ci_lower, round(mean_difference + half, 6) AS ci_upper,
       {_label("cohens_d")} AS effect_label, {_decide("p")} AS decision FROM p""")
def q_welch_inference(spark, sf):
    r = HT.welch_t_test(ab_events(spark, sf), "variant", "value", "treatment", "control", by=["event_type"])
    return R(r.select("event_type", "p_value", "ci_lower", "ci_upper", "effect_label", "decision"))


@register("paired_inference", f"""
WITH p AS (SELECT o_custkey, AVG(o_totalprice) FILTER (o_orderstatus = 'F') a, AVG(o_totalprice) FILTER (o_orderstatus = 'O') b FROM orders
           WHERE o_custkey IS NOT NULL AND o_orderstatus IN ('F', 'O') GROUP BY 1),
d AS (SELECT count(*) AS n, avg(a - b) AS m, stddev_samp(a - b) AS s FROM p WHERE a IS NOT NULL AND b IS NOT NULL),
t AS (SELECT *, m / (s / sqrt(n)) AS t, n - 1 AS df FROM d),
v AS (SELECT *, {t_two_sided("t", "df")} AS p, {t_975("df")} * s / sqrt(n) AS half FROM t)
SELECT round(p, 6) AS p_value, round(m - half, 4) AS paired_ci_lower, round(m + half, 4) AS paired_ci_upper, {_decide("p")} AS decision FROM v""")
def q_paired_inference(spark, sf):
    r = HT.paired_t_test(table(spark, sf, "orders"), "o_orderstatus", "o_totalprice", "o_custkey", "F", "O")
    return r.select(F.round("p_value", 6).alias("p_value"), F.round("paired_ci_lower", 4).alias("paired_ci_lower"),
                    F.round("paired_ci_upper", 4).alias("paired_ci_upper"), "decision")


@register("mean_ci_bounds", f"""
WITH s AS (SELECT o_orderpriority, count(o_totalprice) AS n, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders
           WHERE o_orderpriority IS NOT NULL GROUP BY 1),
h AS (SELECT *, {t_975("(n - 1)")} * s / sqrt(n) AS half FROM s)
SELECT o_orderpriority, n, round(m - half, 4) AS lower_bound, round(m + half, 4) AS upper_bound, 0.95::DOUBLE AS confidence_level FROM h""")
def q_mean_ci_bounds(spark, sf):
    r = CI.mean_confidence_interval(table(spark, sf, "orders"), "o_totalprice", by=["o_orderpriority"])
    return r.select("o_orderpriority", "n", F.round("lower_bound", 4).alias("lower_bound"), F.round("upper_bound", 4).alias("upper_bound"),
                    "confidence_level")


@register("proportion_inference", AB_CTE + f""",
g AS (SELECT count(*) FILTER (variant = 'treatment') AS na, count(*) FILTER (variant = 'control') AS nb,
        count(*) FILTER (variant = 'treatment' AND conversion = 1) AS xa, count(*) FILTER (variant = 'control' AND conversion = 1) AS xb FROM ab
      WHERE conversion IS NOT NULL AND variant IS NOT NULL),
p AS (SELECT *, xa / na AS pa, xb / nb AS pb, (xa + xb) / (na + nb) AS pp FROM g),
z AS (SELECT *, (pa - pb) / sqrt(greatest(1e-12, pp * (1 - pp) * (1.0 / na + 1.0 / nb))) AS z,
        {Z975} * sqrt(pa * (1 - pa) / na + pb * (1 - pb) / nb) AS half FROM p),
v AS (SELECT *, {normal_two_sided("z")} AS p FROM z)
SELECT round(p, 6) AS p_value, round(pa - pb - half, 6) AS ci_lower, round(pa - pb + half, 6) AS ci_upper,
       round((pa - pb - half) / pb, 6) AS lift_ci_lower, round((pa - pb + half) / pb, 6) AS lift_ci_upper,
       least(xa, na - xa, xb, nb - xb) >= 5 AS normal_approximation_ok, true AS reliable, {_decide("p")} AS decision FROM v""")
def q_proportion_inference(spark, sf):
    """CI2/CI4/CI5, ST23/ST24 and DE1 of the A/B readout."""
    ab = ab_events(spark, sf)
    z = HT.two_proportion_z_test(ab, "variant", "conversion", "treatment", "control", success_value=1).select("normal_approximation_ok")
    r = DS.ab_test(ab, "variant", "control", "treatment", "conversion")
    return R(r.crossJoin(z).select("p_value", "ci_lower", "ci_upper", "lift_ci_lower", "lift_ci_upper", "normal_approximation_ok", "reliable", "decision"))


@register("chi_square_inference", """
WITH o AS (SELECT o_orderstatus a, o_orderpriority b, count(*) n FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2),
e AS (SELECT x.a, y.b, x.n * y.n / t.n AS e FROM (SELECT a, sum(n) n FROM o GROUP BY a) x, (SELECT b, sum(n) n FROM o GROUP BY b) y,
      (SELECT sum(n) n FROM o) t),
s AS (SELECT sum(power(coalesce(o.n, 0) - e, 2) / e) AS x, (count(DISTINCT e.a) - 1) * (count(DISTINCT e.b) - 1) AS k FROM e LEFT JOIN o ON o.a = e.a AND o.b = e.b),
p AS (SELECT exp(-x / 2) * list_sum(list_transform(range(0, k // 2), lambda i: exp(i * ln(x / 2) - lgamma(i + 1.0)))) AS p FROM s WHERE k % 2 = 0)
SELECT round(p, 6) AS p_value, CASE WHEN p < 0.05 THEN 'reject_null' ELSE 'fail_to_reject_null' END AS decision FROM p""")
def q_chi_square_inference(spark, sf):
    r = HT.chi_square_independence(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")
    return R(r.select("p_value", "decision"))


@register("levene_inference", f"""
WITH e AS (SELECT event_type g, value v FROM events WHERE event_type IN ('click', 'view') AND value IS NOT NULL),
m AS (SELECT g, median(v) m FROM e GROUP BY g), z AS (SELECT g, abs(v - m) z FROM e JOIN m USING (g)),
a AS (SELECT g, count(*) n, avg(z) zb, var_pop(z) vv FROM z GROUP BY g),
s AS (SELECT sum(n) - 2 AS df, sqrt((sum(n) - 2) * (sum(n * zb * zb) - power(sum(n * zb), 2) / sum(n)) / sum(n * vv)) AS t FROM a),
p AS (SELECT {t_two_sided("t", "df")} AS p FROM s)
SELECT round(p, 6) AS p_value, p >= 0.05 AS passed FROM p""")
def q_levene_inference(spark, sf):
    """F with one numerator degree of freedom is the square of t."""
    return R(HT.levene_test(table(spark, sf, "events"), "event_type", "value", "click", "view").select("p_value", "passed"))


@register("mann_whitney_inference", f"""
WITH u AS ({_mwu_sql(None).replace("ROUND((GREATEST", "((GREATEST").replace(", 6) AS z", ") AS z")}),
p AS (SELECT CASE WHEN z <= 0 THEN 1 ELSE {normal_two_sided("z")} END AS p FROM u)
SELECT round(p, 6) AS p_value, {_decide("p")} AS decision FROM p""")
def q_mann_whitney_inference(spark, sf):
    return R(HT.mann_whitney_u(table(spark, sf, "events"), "event_type", "value", "click", "view").select("p_value", "decision"))


@register("ols_inference", _OLS_CTE + f""",
d AS (SELECT *, (1 - r2) * syy * (n - 1) / (n - 3) AS s2, (n - 1) * (s11 * s22 - s12 * s12) AS det FROM c),
r AS (SELECT 'const' AS term, b0 AS b, sqrt(s2 * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det)) AS se, 0.0 AS sb, n FROM d
  UNION ALL SELECT 'l_quantity', b1, sqrt(s2 * s22 / det), b1 * sqrt(s11 / syy), n FROM d
  UNION ALL SELECT 'l_discount', b2, sqrt(s2 * s11 / det), b2 * sqrt(s22 / syy), n FROM d),
v AS (SELECT *, {t_975("(n - 3)")} * se AS half, {t_two_sided("(b / se)", "(n - 3)")} AS p FROM r)
SELECT term, round(se, 4) AS std_error, round(b / se, 4) AS t_stat, CASE WHEN abs(b / se) > 12 THEN 0 ELSE round(p, 6) END AS p_value,
       round(b - half, 3) AS lower_bound, round(b + half, 3) AS upper_bound, round(sb, 6) AS standardized_beta FROM v""")
def q_ols_inference(spark, sf):
    """ST11, ST13 and CI6: errors, t, p, bounds and standardized betas."""
    r = OLS.ols_coefficients(_lineitem_fit(spark, sf))
    return r.select("term", F.round("std_error", 4).alias("std_error"), F.round("t_stat", 4).alias("t_stat"), F.round("p_value", 6).alias("p_value"),
                    F.round("lower_bound", 3).alias("lower_bound"), F.round("upper_bound", 3).alias("upper_bound"),
                    F.round("standardized_beta", 6).alias("standardized_beta"))


def _adjust_sql(method):
    raw = _welch_raw("user_id").replace("'treatment'", "'purchase'").replace("'control'", "'view'").replace("variant", "event_type")
    ranked = "row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m"
    adj = ("max(least(1, (m - i + 1) * p)) OVER (ORDER BY i)" if method == "holm" else "min(least(1, m / i * p)) OVER (ORDER BY i DESC)")
    # equal p-values share one value: the smallest rank's for Holm, the largest rank's for Benjamini-Hochberg
    first = "min" if method == "holm" else "max"
    return f"""
WITH w AS ({raw}),
p AS (SELECT user_id, statistic, {t_two_sided("statistic", "df")} AS p FROM w WHERE statistic IS NOT NULL AND n_a >= 2 AND n_b >= 2),
k AS (SELECT *, {ranked} FROM p),
t AS (SELECT p, {first}(i) AS i, any_value(m) AS m FROM k GROUP BY p),
a AS (SELECT p, {adj} AS adj FROM t)
SELECT k.user_id, round(k.p, 6) AS p_value, round(least(1, a.adj), 6) AS p_adjusted, '{method}' AS adjustment FROM k JOIN a USING (p)
"""


def _adjusted(spark, sf, method):
    r = HT.welch_t_test(ab_events(spark, sf), "event_type", "value", "purchase", "view", by=["user_id"]).where("statistic IS NOT NULL AND reliable")
    a = AS.adjust_pvalues(r.select("user_id", "p_value"), "p_value", method)
    return R(a.select("user_id", "p_value", "p_adjusted", "adjustment"))


@register("holm_by_user", _adjust_sql("holm"))
def q_holm_by_user(spark, sf):
    return _adjusted(spark, sf, "holm")


@register("benjamini_hochberg_by_user", _adjust_sql("bh"))
def q_benjamini_hochberg_by_user(spark, sf):
    return _adjusted(spark, sf, "bh")
