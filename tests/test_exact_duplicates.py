"""Duplicates by digests: exact whatever collides."""
import random

import pytest
from pyspark.sql import functions as F

from kestrel.operators import quality as Q

R = random.Random(9)
ROWS = [(R.choice([0.0, -0.0, float("nan"), None, 1.5]), R.choice([None, "", "a", "b"]), R.choice([None, 1, 2])) for _ in range(300)] + [(7.0, "only", 1)]


def one_bucket(df, keys):
    return [F.lit(1).cast("long"), F.lit(2).cast("long")]


def few_buckets(df, keys):
    return [F.pmod(F.xxhash64(keys[0]), F.lit(3)), F.lit(2).cast("long")]


@pytest.mark.parametrize("digest", [Q._digest, one_bucket, few_buckets])
@pytest.mark.parametrize("subset", [None, ["s"], ["x", "n"]])
def test_exact(spark, digest, subset):
    df = spark.createDataFrame(ROWS, "x double, s string, n int").withColumn("_h1", F.lit(None).cast("string"))
    want = df.select(*(subset or df.columns)).distinct().count()
    r = Q.duplicate_rate(df, subset, digest).first()
    assert (r["n_rows"], r["n_distinct"]) == (len(ROWS), want)
    left = Q.deduplicate(df, subset, digest)
    assert left.columns == df.columns and left.count() == want == left.select(*(subset or df.columns)).distinct().count()


def test_shifted_nulls_and_nested(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", None)], "x string, y string")
    assert Q.duplicate_rate(df).first()["n_distinct"] == 2 and Q.deduplicate(df).count() == 2
    nested = spark.createDataFrame([([1],), ([1],), ([2],)], "a array<int>")
    assert Q.duplicate_rate(nested).first()["n_distinct"] == 2 and Q.deduplicate(nested).count() == 2
    r = Q.duplicate_rate(df.where("false")).first()
    assert (r["n_rows"], r["n_distinct"], r["duplicate_rate"]) == (0, 0, 0.0) and Q.deduplicate(df.where("false")).count() == 0
