import pytest
from pyspark.sql import functions as F

from kestrel.functions import special as S
from kestrel.operators.stats import dispatch as DS
from kestrel.operators.stats import intervals as CI
from kestrel.operators.stats import tests as HT
from kestrel.operators.stats.normality import shapiro_wilk


def test_special_functions():
    assert S.t_pvalue(-10.0, 14.0) == pytest.approx(9.3414e-08, rel=1e-4)
    assert S.t_ppf(0.975, 4) == pytest.approx(2.776445, abs=1e-6)
    assert S.chi2_sf(0.666667, 2) == pytest.approx(0.716531, abs=1e-6)
    assert S.norm_ppf(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert S.f_sf(3.0, 2, 10) == pytest.approx(0.0953674, abs=1e-6)


def test_two_proportion_z(ab200):
    r = HT.two_proportion_z_test(ab200, "variant", "conversion", "treatment", "control").collect()[0]
    assert r["statistic"] == pytest.approx(2.036352, abs=1e-6)
    assert r["p_value"] == pytest.approx(0.041715, abs=1e-6)
    assert (r["ci_lower"], r["ci_upper"]) == pytest.approx((0.006181, 0.253819), abs=1e-6)
    assert (r["control_ci_lower"], r["control_ci_upper"]) == pytest.approx((0.150013, 0.310704), abs=1e-6)
    assert r["relative_lift"] == pytest.approx(0.590909, abs=1e-6)
    assert r["odds_ratio"] == pytest.approx(1.890925, abs=1e-6)
    assert r["decision"] == "reject_null"


def test_welch_tiny_p_uses_sf(ab200):
    r = HT.welch_t_test(ab200, "variant", "revenue", "treatment", "control").collect()[0]
    assert r["statistic"] == pytest.approx(24.479763, abs=1e-5)
    assert r["df"] == pytest.approx(198.0, abs=1e-6)
    assert (r["ci_lower"], r["ci_upper"]) == pytest.approx((6.436101, 7.563899), abs=1e-6)
    assert r["cohens_d"] == pytest.approx(3.461961, abs=1e-6)
    assert 0 < r["p_value"] < 1e-15


def test_welch_mean_comparison(spark):
    a = [42, 44, 46, 41, 45, 47, 43, 44]
    b = [51, 53, 54, 55, 52, 56, 57, 54]
    df = spark.createDataFrame([("A", v) for v in a] + [("B", v) for v in b], "segment string, order_value int")
    r = HT.welch_t_test(df, "segment", "order_value").collect()[0]
    assert r["statistic"] == pytest.approx(-10.0, abs=1e-9) and r["df"] == pytest.approx(14.0, abs=1e-9)
    assert r["p_value"] == pytest.approx(9.3414e-08, rel=1e-4)
    assert (r["ci_lower"], r["ci_upper"]) == pytest.approx((-12.144787, -7.855213), abs=1e-6)
    assert r["cohens_d"] == pytest.approx(-5.0)


def test_mann_whitney_ties(spark):
    a = [1, 1, 1, 1, 2, 2, 20, 25]
    b = [1, 1, 1, 1, 1, 1, 2, 3]
    df = spark.createDataFrame([("A", float(v)) for v in a] + [("B", float(v)) for v in b], "segment string, x double")
    r = HT.mann_whitney_u(df, "segment", "x").collect()[0]
    assert r["u_statistic"] == pytest.approx(41.0) and not r["exact"]
    assert r["z"] == pytest.approx(1.029767, abs=1e-6)
    assert r["p_value"] == pytest.approx(0.303119, abs=1e-6)


def test_mann_whitney_exact_small(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("A", 3.0), ("B", 4.0), ("B", 5.0), ("B", 6.0)], "g string, x double")
    r = HT.mann_whitney_u(df, "g", "x").collect()[0]
    assert r["exact"] and r["u_statistic"] == 0.0
    assert r["p_value"] == pytest.approx(0.1, abs=1e-12)  # 2 / C(6,3)


def test_chi_square_small_table(spark):
    rows = [("US", "mobile"), ("US", "desktop"), ("US", "mobile"), ("IN", "mobile"), ("IN", "desktop"),
            ("IN", "mobile"), ("IN", "desktop"), ("DE", "mobile"), ("DE", "desktop"), ("DE", "desktop")]
    df = spark.createDataFrame(rows, "country string, device string")
    r = HT.chi_square_independence(df, "country", "device").collect()[0]
    assert r["statistic"] == pytest.approx(0.666667, abs=1e-6) and r["dof"] == 2
    assert r["p_value"] == pytest.approx(0.716531, abs=1e-6)
    assert r["cramers_v"] == pytest.approx(0.258199, abs=1e-6)
    assert r["min_expected"] == pytest.approx(1.5) and r["decision"] == "not_reliable"


def test_chi_square_yates(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 25 + [("b", "y")] * 15
    r = HT.chi_square_independence(spark.createDataFrame(rows, "l string, r string"), "l", "r").collect()[0]
    o = [[10, 20], [25, 15]]
    n = 70
    rt, ct = [30, 40], [35, 35]
    chi = sum((abs(o[i][j] - rt[i] * ct[j] / n) - 0.5) ** 2 / (rt[i] * ct[j] / n) for i in range(2) for j in range(2))
    assert r["statistic"] == pytest.approx(chi, abs=1e-9) and r["yates_correction"]


def test_mean_ci(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5]], "x double")
    r = CI.mean_confidence_interval(df, "x").collect()[0]
    assert (r["lower_bound"], r["upper_bound"]) == pytest.approx((1.036757, 4.963243), abs=1e-6)


def test_paired_t(spark):
    rows = []
    for i in range(10):
        rows += [(i, "before", 10.0 + i), (i, "after", 10.5 + i + (i % 3) * 0.1)]
    df = spark.createDataFrame(rows, "pid int, phase string, x double")
    r = HT.paired_t_test(df, "phase", "x", "pid", "after", "before").collect()[0]
    import statistics as st
    d = [0.5 + (i % 3) * 0.1 for i in range(10)]
    t = st.mean(d) / (st.stdev(d) / 10 ** 0.5)
    assert r["n_pairs"] == 10 and r["statistic"] == pytest.approx(t)


def test_shapiro_wilk_known_value():
    w, p = shapiro_wilk([1, 2, 3, 4, 5])
    assert w == pytest.approx(0.986762, abs=1e-5) and p == pytest.approx(0.967174, abs=1e-4)


def test_method_selection(spark, ab200):
    assert DS.select_method(ab200, "variant", "conversion").collect()[0]["method"] == "two_proportion_z_test"
    assert DS.select_method(ab200, "variant", "revenue").collect()[0]["method"] == "welch_t_test"
    a = [1, 1, 1, 1, 2, 2, 20, 25]
    b = [1, 1, 1, 1, 1, 1, 2, 3]
    df = spark.createDataFrame([("A", float(v)) for v in a] + [("B", float(v)) for v in b], "segment string, x double")
    # the small-sample rule is an argument: without it the size does not choose the test
    assert DS.select_method(df, "segment", "x", rank_below=20).collect()[0]["method"] == "mann_whitney_u"
    assert DS.select_method(df, "segment", "x").collect()[0]["method"] == "welch_t_test"


def test_normality_rule_is_the_same_at_every_size(spark):
    import math
    import numpy as np
    from kestrel.operators.stats.normality import normality, shapiro_normality
    flat = spark.range(10001).select(F.when(F.col("id") < 5000, "n5000").otherwise("n5001").alias("g"),
                                     (F.col("id") % 5000).cast("double").alias("x"))
    r = {x["g"]: x for x in normality(flat, "x", by=["g"]).collect()}
    assert {x["method"] for x in r.values()} == {"jarque_bera"} and {x["passed"] for x in r.values()} == {False}
    v = np.arange(5000.0)
    z = (v - v.mean()) / v.std()
    jb = 5000 / 6 * (np.mean(z ** 3) ** 2 + (np.mean(z ** 4) - 3) ** 2 / 4)
    assert r["n5000"]["statistic"] == pytest.approx(jb) and r["n5000"]["p_value"] == pytest.approx(math.exp(-jb / 2))
    sw = {x["g"]: x for x in shapiro_normality(flat, "x", by=["g"]).collect()}
    assert sw["n5000"]["method"] == "shapiro_wilk" and sw["n5000"]["passed"] is False
    assert sw["n5001"]["method"] == "too_many" and sw["n5001"]["passed"] is None
    few = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 3.0), ("b", 3.0), ("c", None)], "g string, x double")
    got = {x["g"]: (x["method"], x["passed"]) for x in normality(few, "x", by=["g"]).collect()}
    assert got == {"a": ("insufficient", None), "b": ("jarque_bera", None)}


def test_ab_test_readout(ab200):
    r = DS.ab_test(ab200, "variant", "control", "treatment", "conversion").collect()[0]
    assert r["method"] == "two_proportion_z_test"
    assert r["relative_lift"] == pytest.approx(0.590909, abs=1e-6) and r["imbalance_ratio"] == 1.0
    r2 = DS.ab_test(ab200, "variant", "control", "treatment", "revenue", metric_type="continuous").collect()[0]
    assert r2["method"] == "welch_t_test" and r2["absolute_difference"] == pytest.approx(7.0)


def test_ab_by_segment_one_job(ab200):
    from pyspark.sql import functions as F
    df = ab200.withColumn("half", (F.substring("user_id", 2, 3).cast("int") % 2).cast("string"))
    r = HT.welch_t_test(df, "variant", "revenue", "treatment", "control", by=["half"]).collect()
    assert len(r) == 2 and all(x["reliable"] for x in r)


def test_levene_and_tukey(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]] + [("b", float(v)) for v in [2, 4, 6, 8, 10]],
                               "g string, x double")
    lv = HT.levene_test(df, "g", "x").collect()[0]
    # median-centred Levene by hand
    za = [abs(v - 3) for v in [1, 2, 3, 4, 100]]
    zb = [abs(v - 6) for v in [2, 4, 6, 8, 10]]
    import statistics as st
    zbar = st.mean(za + zb)
    num = 5 * (st.mean(za) - zbar) ** 2 + 5 * (st.mean(zb) - zbar) ** 2
    den = sum((z - st.mean(za)) ** 2 for z in za) + sum((z - st.mean(zb)) ** 2 for z in zb)
    assert lv["statistic"] == pytest.approx(8 * num / den)
    tk = {r["g"]: r for r in HT.tukey_outliers(df, "x", by=["g"]).collect()}
    assert tk["a"]["n_outliers"] == 1 and tk["b"]["n_outliers"] == 0


def test_adjust_pvalues_matches_brute_force(spark):
    import random
    rnd = random.Random(7)
    ps = [round(rnd.random() ** 2, 4) for _ in range(200)] + [0.01, 0.01, 0.5]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "id int, p_value double")
    from kestrel.operators.stats.assumptions import adjust_pvalues
    m = len(ps)
    order = sorted(range(m), key=lambda i: ps[i])
    holm, run = [0.0] * m, 0.0
    for rank, i in enumerate(order):
        first = sum(1 for q in ps if q < ps[i])
        run = max(run, (m - first) * ps[i])
        holm[i] = min(1.0, run)
    bh, run = [0.0] * m, float("inf")
    for i in reversed(order):
        last = sum(1 for q in ps if q <= ps[i])
        run = min(run, m / last * ps[i])
        bh[i] = min(1.0, run)
    got_h = {r["id"]: r["p_adjusted"] for r in adjust_pvalues(df, "p_value", "holm").collect()}
    got_b = {r["id"]: r["p_adjusted"] for r in adjust_pvalues(df, "p_value", "bh").collect()}
    assert [got_h[i] for i in range(m)] == pytest.approx(holm)
    assert [got_b[i] for i in range(m)] == pytest.approx(bh)


def test_assumption_checks_and_summary(ab200):
    from kestrel.operators.stats.assumptions import failure_summary, two_group_checks
    chk = two_group_checks(ab200, "variant", "revenue", "treatment", "control")
    names = {r["check"] for r in chk.collect()}
    assert {"missingness_impact", "sample_size", "group_balance", "normality", "equal_variance",
            "outlier_sensitivity", "multiple_comparisons"} <= names
    s = failure_summary(chk).collect()
    assert len(s) <= 1 and (not s or len(s[0]["limitations"]) <= 8)
