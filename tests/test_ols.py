import pytest

from kestrel.operators.stats import ols as OLS

REG_DEMO = [(1025, 207, 0.02, 1398.65), (1050, 214, 0.02, 1425.30), (1075, 221, 0.05, 1423.95),
            (1100, 228, 0.02, 1478.60), (1125, 220, 0.02, 1489.50), (1150, 227, 0.05, 1488.15),
            (1175, 234, 0.02, 1542.80), (1200, 241, 0.02, 1569.45), (1225, 248, 0.05, 1568.10),
            (1250, 240, 0.02, 1622.75), (1275, 247, 0.02, 1649.40), (1300, 254, 0.05, 1648.05),
            (1325, 261, 0.02, 1702.70), (1350, 268, 0.02, 1729.35), (1375, 260, 0.05, 1728.00),
            (1400, 267, 0.02, 1782.65), (1425, 274, 0.02, 1809.30), (1450, 281, 0.05, 1807.95),
            (1475, 288, 0.02, 1862.60), (1500, 280, 0.02, 1873.50)]


@pytest.fixture(scope="module")
def reg_demo(spark):
    return spark.createDataFrame(REG_DEMO, "marketing_spend int, sessions int, discount_pct double, revenue double")


def test_coefficients_and_fit(reg_demo):
    fit = OLS.ols_fit(reg_demo, "revenue", ["marketing_spend", "sessions", "discount_pct"])
    c = {r["term"]: r for r in OLS.ols_coefficients(fit).collect()}
    assert c["const"]["coefficient"] == pytest.approx(336.765351, abs=1e-5)
    assert c["marketing_spend"]["coefficient"] == pytest.approx(0.942684, abs=1e-6)
    assert c["sessions"]["coefficient"] == pytest.approx(0.525, abs=1e-6)
    assert c["discount_pct"]["coefficient"] == pytest.approx(-933.333, abs=1e-3)
    assert [c[t]["std_error"] for t in ("const", "marketing_spend", "sessions", "discount_pct")] == pytest.approx(
        [15.431032, 0.042291, 0.259985, 80.233235], abs=1e-5)
    assert c["sessions"]["p_value"] == pytest.approx(0.060529, abs=1e-5)
    m = OLS.ols_fit_metrics(fit).collect()[0]
    assert m["r_squared"] == pytest.approx(0.999124, abs=1e-6)
    assert m["adj_r_squared"] == pytest.approx(0.998960, abs=1e-6)
    assert m["f_statistic"] == pytest.approx(6082.882, abs=1e-2)
    v = {r["term"]: r["vif"] for r in OLS.ols_vif(fit).collect()}
    assert [v["marketing_spend"], v["sessions"], v["discount_pct"]] == pytest.approx([1415.079, 1447.038, 5.437], abs=1e-3)


def test_exact_linear_and_rank_deficient(spark):
    rows = []
    for i in range(1, 81):
        spend = 1000.0 + 25 * i
        sessions = 200.0 + 4 * i + (i % 5) * 3
        disc = 0.05 if i % 3 == 0 else 0.02
        rows.append((spend, sessions, disc, 500 + 0.45 * spend + 2.2 * sessions - 900 * disc, spend))
    df = spark.createDataFrame(rows, "marketing_spend double, sessions double, discount_pct double, revenue double, "
                                     "marketing_spend_copy double")
    fit = OLS.ols_fit(df, "revenue", ["marketing_spend", "sessions", "discount_pct"])
    c = {r["term"]: r["coefficient"] for r in OLS.ols_coefficients(fit).collect()}
    assert [c["const"], c["marketing_spend"], c["sessions"], c["discount_pct"]] == pytest.approx(
        [500, 0.45, 2.2, -900], abs=1e-6)
    bad = OLS.ols_fit(df, "revenue", ["marketing_spend", "marketing_spend_copy", "sessions"])
    assert not bad.reliable
    assert OLS.ols_fit_metrics(bad).collect()[0]["status"] == "not_reliable"
    assert OLS.ols_coefficients(bad).count() == 0


def test_one_hot_first_level_dropped(spark):
    rows = [(float(i), ["a", "b", "c"][i % 3], 2.0 * i + [0, 5, -3][i % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "x double, cat string, y double")
    fit = OLS.ols_fit(df, "y", ["x", "cat"])
    c = {r["term"]: r["coefficient"] for r in OLS.ols_coefficients(fit).collect()}
    assert set(c) == {"const", "x", "cat_b", "cat_c"}
    assert c["cat_b"] == pytest.approx(5.0) and c["cat_c"] == pytest.approx(-3.0)


def test_tsqr_matches_mllib_normal_solver(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from conftest import SF_SMALL
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    fit = OLS.ols_fit(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    ours = {r["term"]: r for r in OLS.ols_coefficients(fit).collect()}
    va = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features")
    m = LinearRegression(featuresCol="features", labelCol="l_extendedprice", solver="normal", regParam=0.0,
                         standardization=False).fit(va.transform(li))
    assert ours["const"]["coefficient"] == pytest.approx(m.intercept, rel=1e-8)
    for i, t in enumerate(["l_quantity", "l_discount", "l_tax"]):
        assert ours[t]["coefficient"] == pytest.approx(m.coefficients[i], rel=1e-8)
        assert ours[t]["std_error"] == pytest.approx(m.summary.coefficientStandardErrors[i], rel=1e-6)
    assert OLS.ols_fit_metrics(fit).collect()[0]["r_squared"] == pytest.approx(m.summary.r2, rel=1e-9)
