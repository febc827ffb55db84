"""Counts whose products pass 64 bits, tables that grow, streams over folders."""
from pyspark.sql import functions as F

from kestrel.operators.charts import heatmap_cells
from kestrel.operators.stats.tests import mann_whitney_u
from kestrel.sources.tables import table


def test_mann_whitney_with_a_value_tied_millions_of_times(spark):
    df = spark.range(5_000_000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), F.lit(1.0).alias("x"))
    r = mann_whitney_u(df, "g", "x", "a", "b").first()
    assert r["u_statistic"] == 2_500_000 ** 2 / 2


def test_table_sees_files_added_later(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/t.parquet")
    assert table(spark, str(tmp_path), "t").count() == 10
    spark.range(10).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    assert table(spark, str(tmp_path), "t").count() == 20


def test_heatmap_keeps_every_label(spark):
    df = spark.range(900).select((F.col("id") % 30).alias("x"), (F.col("id") % 25).alias("y"), F.lit(1.0).alias("m"))
    assert heatmap_cells(df, "x", "y", "m").count() == 750
