import datetime as dt

import pytest
from pyspark.sql import functions as F

from kestrel.functions import periods as P
from kestrel.operators.timeseries import timeseries_agg


@pytest.mark.parametrize("freq,label,plabel", [
    ("M", "2024-02-29 00:00:00", "2024-02"),
    ("Q", "2024-03-31 00:00:00", "2024Q1"),
    ("Y", "2024-12-31 00:00:00", "2024"),
    ("W", "2024-02-18 00:00:00", "2024-02-12/2024-02-18"),
    ("D", "2024-02-14 00:00:00", "2024-02-14"),
    ("H", "2024-02-14 10:00:00", "2024-02-14 10:00"),
])
def test_labels(spark, freq, label, plabel):
    df = spark.createDataFrame([(dt.datetime(2024, 2, 14, 10, 37),)], "ts timestamp_ntz")
    st = P.period_start(F.col("ts"), freq)
    r = df.select(P.period_end_label(st, freq).alias("e"), P.period_label(st, freq).alias("l")).collect()[0]
    assert r["e"].strftime("%Y-%m-%d %H:%M:%S") == label and r["l"] == plabel


def test_period_diff(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 11, 20), dt.datetime(2024, 2, 3))], "a timestamp_ntz, b timestamp_ntz")
    out = {f: df.select(P.period_diff(P.period_start(F.col("b"), f), P.period_start(F.col("a"), f), f)).collect()[0][0]
           for f in ("M", "Q", "Y", "W", "D")}
    assert out == {"M": 3, "Q": 1, "Y": 1, "W": 10, "D": 75}


def test_mean_drops_empty_periods(spark):
    df = spark.createDataFrame([("2024-01-05", 1.0), ("2024-03-02", 3.0)], "d string, v double")
    r = [x["value"] for x in timeseries_agg(df, "d", "v", "M", "mean").orderBy("period").collect()]
    assert r == [1.0, 3.0]
    c = [x["value"] for x in timeseries_agg(df, "d", "v", "M", "count").orderBy("period").collect()]
    assert c == [1.0, 0.0, 1.0]
