import pytest

from kestrel.operators import profile as PR
from kestrel.operators import quality as QY


@pytest.fixture(scope="module")
def quality31(spark):
    rows = []
    for i in range(30):
        rows.append((1000.0 if i == 29 else 1.0, "IN", -5 if i == 29 else 30, None if i < 10 else float(i)))
    rows.append(rows[0])
    return spark.createDataFrame(rows, "metric double, country string, age int, mostly_missing double")


def test_quality_report_all_warning_kinds(quality31):
    r = QY.quality_report(quality31, z_thresh=4.0).collect()
    warn = {(x["check"], x["column"]) for x in r if x["warn"]}
    assert ("missingness", "mostly_missing") in warn
    assert ("duplicate_rate", None) in warn
    assert ("zscore_outliers", "metric") in warn
    assert ("range", "age") in warn


def test_duplicate_rate_and_dedup(spark, sales30):
    dup = sales30.unionByName(sales30.limit(1))
    r = QY.duplicate_rate(dup).collect()[0]
    assert r["duplicate_rate"] == pytest.approx(1 / 31)
    assert QY.deduplicate(dup).count() == 30


def test_column_profile(spark, sales30):
    from pyspark.sql import functions as F
    df = sales30.withColumn("product_category", F.when(F.col("order_id") <= "O0009", None)
                            .otherwise(F.col("product_category")))
    p = {r["column"]: r for r in PR.column_profile(df).collect()}
    assert p["product_category"]["n_missing"] == 9
    assert p["revenue"]["count"] == 30 and p["revenue"]["median"] == pytest.approx(270.0)
    assert len(p["country"]["example_values"]) == 5 and len(set(p["country"]["example_values"])) == 5
    assert p["country"]["n_unique"] == 5


def test_datetime_detection(sales30):
    r = {x["column"]: x["is_datetime"] for x in PR.datetime_columns(sales30).collect()}
    assert r["order_date"] and not r["country"] and not r["order_id"]


def test_missingness_empty_table(spark):
    df = spark.createDataFrame([], "a string, b double")
    assert all(r["missing_frac"] == 0.0 for r in QY.missingness(df).collect())


def test_profile_empty_table(spark):
    df = spark.createDataFrame([], "a string, b double")
    r = PR.column_profile(df).collect()
    assert [x["column"] for x in r] == ["a", "b"] and all(x["n_missing"] == 0 for x in r)
