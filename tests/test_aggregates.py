import pytest
from pyspark.sql import functions as F

from kestrel.operators import aggregate as A
from kestrel.operators import ranking as RK


def test_groupby_sum_and_total(sales30):
    rows = {r["country"]: r["value"] for r in A.groupby_agg(sales30, "country", "revenue").collect()}
    assert rows == pytest.approx({"USA": 2041.5, "Germany": 1912.0, "Canada": 1870.0, "India": 1590.5, "UK": 1541.0})
    assert sum(rows.values()) == pytest.approx(8955.0)


def test_limit_zero_means_all_and_order(sales30):
    r = A.groupby_agg(sales30, "country", "revenue", limit=0).collect()
    assert [x["country"] for x in r] == ["USA", "Germany", "Canada", "India", "UK"]
    assert len(A.groupby_agg(sales30, "country", "revenue", limit=2).collect()) == 2


def test_focus_rank_and_gap(sales30):
    r = RK.focus_rank(sales30, "country", "revenue", "India").collect()[0]
    assert r["rank"] == 4 and r["n_segments"] == 5
    assert r["gap_to_top"] == pytest.approx(451.0)


def test_segment_share_of_kept_rows(sales30):
    r = A.segment_analysis(sales30, "country", "revenue", limit=2).collect()
    assert sum(x["share_pct"] for x in r) == pytest.approx(1.0)
    assert r[0]["share_of_total"] == pytest.approx(2041.5 / 8955.0)


def test_distribution_quantiles(sales30):
    r = A.distribution(sales30, "revenue").collect()[0]
    assert r["count"] == 30
    assert [r["q0_05"], r["q0_25"], r["q0_5"], r["q0_75"], r["q0_95"]] == pytest.approx(
        [99.45, 162.0, 270.0, 416.25, 547.5])


def test_distribution_approx_close(sales30):
    r = A.distribution(sales30, "revenue", approx=True).collect()[0]
    assert r["q0_5"] == pytest.approx(270.0, rel=0.2)


def test_correlation_and_short_skip(spark, sales30):
    r = A.correlation(sales30, "quantity", "revenue").collect()[0]
    assert r["r"] == pytest.approx(0.930401, abs=1e-6) and r["status"] == "computed"
    short = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "x double, y double")
    assert A.correlation(short, "x", "y").collect()[0]["status"] == "skipped"


def test_string_metric_is_coerced(spark):
    df = spark.createDataFrame([("a", "abc"), ("a", "100"), ("b", "200"), ("b", "1d")], "g string, revenue string")
    r = {x["g"]: x["value"] for x in A.groupby_agg(df, "g", "revenue").collect()}
    assert r == {"a": 100.0, "b": 200.0}


def test_null_keys_dropped_and_all_null_sum_zero(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", None), ("b", 2.0)], "k string, v double")
    r = {x["k"]: x["value"] for x in A.groupby_agg(df, "k", "v").collect()}
    assert r == {"a": 0.0, "b": 2.0}


def test_filter_agg_numeric_and_text(sales30):
    assert A.filter_agg(sales30, "country", "USA", "revenue").collect()[0]["value"] == pytest.approx(2041.5)
    assert A.filter_agg(sales30, "quantity", "1", "quantity", "count").collect()[0]["value"] == 8


def test_metric_expression_mean_of_rows(sales30):
    from kestrel.operators.kpi import metric_definition
    r = metric_definition(sales30, "unit", expression="revenue / quantity").collect()[0]
    assert r["value"] == pytest.approx(121.933333, abs=1e-6)


def test_kpi_template(sales30):
    from kestrel.operators.kpi import kpi_template_apply
    r = kpi_template_apply(sales30, "ecommerce").collect()[0]
    assert r["total_revenue"] == pytest.approx(8955.0)
    assert r["order_count"] == 30 and r["avg_order_value"] == pytest.approx(8955.0 / 30)
    with pytest.raises(ValueError):
        kpi_template_apply(sales30, "unknown")


def test_timeseries_gap_fill_and_labels(spark):
    df = spark.createDataFrame([("2024-01-05", 1.0), ("2024-03-02", 2.0)], "d string, v double")
    r = [(x["period"].strftime("%Y-%m-%d"), x["value"]) for x in
         __import__("kestrel.operators.timeseries", fromlist=["x"]).timeseries_agg(df, "d", "v", "M").orderBy("period").collect()]
    assert r == [("2024-01-31", 1.0), ("2024-02-29", 0.0), ("2024-03-31", 2.0)]


def test_cohort_long(spark):
    from kestrel.operators.cohort import cohort_long
    df = spark.createDataFrame([("a", "2024-01-03"), ("a", "2024-02-03"), ("b", "2024-01-09"), ("c", "2024-02-01")],
                               "e string, d string")
    r = {(x["cohort_period"], x["period_number"]): (x["active_entities"], x["retention_rate"])
         for x in cohort_long(df, "e", "d").collect()}
    assert r[("2024-01", 0)] == (2, 1.0) and r[("2024-01", 1)] == (1, 0.5) and r[("2024-02", 0)] == (1, 1.0)


def test_empty_input(spark):
    df = spark.createDataFrame([], "a string, b double")
    assert A.groupby_agg(df, "a", "b").count() == 0
    assert A.distribution(df, "b").count() == 0


def test_suite_all_task_types(spark, sales30, ab200):
    from kestrel.plans.suite import run_suite
    sales30.createOrReplaceTempView("sales30")
    tasks = [
        {"id": "a", "type": "filter_agg", "params": {"where": {"country": "USA"}, "metric": "revenue"}},
        {"id": "b", "type": "sql_query", "params": {"query": "SELECT country, SUM(revenue) FROM sales30 GROUP BY 1",
                                                     "output": "mapping"}},
        {"id": "c", "type": "ols_regression", "params": {"target": "revenue", "predictors": ["quantity", "unit_price"]}},
        {"id": "d", "type": "kpi_template_apply", "params": {"domain": "ecommerce"}},
        {"id": "e", "type": "cohort_analysis", "params": {"entity_col": "customer_id", "date_col": "order_date"}},
        {"id": "f", "type": "metric_definition", "params": {"name": "x", "expression": "revenue / quantity"}},
        {"id": "g", "type": "distribution", "params": {"column": "revenue"}},
        {"id": "h", "type": "nope", "params": {}},
    ]
    r = run_suite(sales30, tasks).collect()
    by = {}
    for x in r:
        by.setdefault(x["task_id"], []).append(x)
    assert by["a"][0]["value"] == pytest.approx(2041.5)
    assert {x["key"] for x in by["b"]} == {"India", "Germany", "USA", "Canada", "UK"}
    assert by["h"][0]["status"] == "failed" and all(x["status"] == "computed" for t in "abcdefg" for x in by[t])
    ab = run_suite(ab200, [{"id": "z", "type": "ab_test", "params": {"group_col": "variant", "control": "control",
                                                                      "treatment": "treatment",
                                                                      "metric": "conversion"}},
                           {"id": "y", "type": "statistical_test", "params": {"group_col": "variant",
                                                                               "metric": "revenue"}}]).collect()
    z = {x["metric"]: x["value"] for x in ab if x["task_id"] == "z"}
    assert z["relative_lift"] == pytest.approx(0.590909, abs=1e-6)
    assert any(x["task_id"] == "y" for x in ab)


def test_suite_isolation_names_and_skips(spark, sales30):
    from kestrel.plans.suite import run_suite
    sales30.createOrReplaceTempView("sales30")
    r = run_suite(sales30, [
        {"id": "ok", "type": "groupby_agg", "params": {"dimension": "country", "measure": "revenue", "op": "sum"}},
        {"id": "div", "type": "sql_query", "params": {"sql": "SELECT quantity / 0 AS x FROM sales30"}},
        {"id": "none", "type": "distribution", "params": {"col": "country"}},
        {"id": "flt", "type": "filter_agg", "params": {"country": "USA", "metric": "revenue"}},
        {"id": "kpi", "type": "kpi_template_apply", "params": {"template": "ecommerce", "by": "country"}},
        {"id": "ols", "type": "ols_regression", "params": {"y": "revenue", "x": "quantity, unit_price"}},
        {"id": "top", "type": "topk", "params": {"group": "country", "value": "revenue", "limit": 2}},
        {"id": "miss", "type": "groupby_agg", "params": {"metric": "revenue"}},
    ]).collect()
    by = {}
    for x in r:
        by.setdefault(x["task_id"], []).append(x)
    status = {t: {x["status"] for x in rows} for t, rows in by.items()}
    assert status == {"ok": {"computed"}, "div": {"failed"}, "none": {"skipped"}, "flt": {"computed"},
                      "kpi": {"computed"}, "ols": {"computed"}, "top": {"computed"}, "miss": {"failed"}}
    assert len(by["ok"]) == 5 and len(by["top"]) == 2 and "ZERO" in by["div"][0]["reason"]
    assert by["flt"][0]["value"] == pytest.approx(2041.5)
    assert {x["key"] for x in by["kpi"]} >= {"", "USA", "India"}
