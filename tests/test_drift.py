"""Distribution distances against brute force."""
import datetime as dt
import math
import random

from pyspark.sql import functions as F

from kestrel.operators import drift as DR

R = random.Random(3)
ROWS = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), R.choice([0.0, -0.0, R.gauss(0, 1), R.gauss(0 if h < 480 or k == "a" else 0.4, 1)]), R.randint(0, 400) + (200 if h > 480 else 0))
        for k in "ab" for h in range(0, 960) for _ in range(3)]
ROWS += [("a", None, 1.0, 1), (None, dt.datetime(2024, 1, 2), 1.0, 1), ("a", dt.datetime(2024, 1, 2), None, None), ("a", dt.datetime(2024, 1, 2), float("nan"), 1),
         ("lone", dt.datetime(2024, 1, 2), 1.0, 1)]
CUT = dt.datetime(2024, 1, 21)


def brute_ks(k):
    a, b = ([r[2] for r in ROWS if r[0] == k and r[1] and r[2] is not None and r[2] == r[2] and (r[1] >= CUT) == side] for side in (False, True))
    f = lambda s, x: sum(v <= x for v in s) / len(s)
    return max(abs(f(a, x) - f(b, x)) for x in {*a, *b}), len(a), len(b)


def test_exact_and_sketched(spark):
    df = spark.createDataFrame(ROWS, "k string, ts timestamp, v double, u int")
    got = {r["k"]: r for r in DR.ks_exact(df, "v", F.col("ts") >= F.lit(CUT), ["k"]).collect()}
    assert set(got) == {"a", "b"}
    for k in "ab":
        ks, n, m = brute_ks(k)
        assert abs(got[k]["ks"] - ks) < 1e-12 and (got[k]["n_ref"], got[k]["n_cur"]) == (n, m)
        x = ks * math.sqrt(n * m / (n + m))
        p = 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 200))
        assert abs(got[k]["p_value"] - min(1, max(0, p))) < 1e-9
    days = DR.daily_sketches(df, "ts", "v", "u", ["k"])
    rep = {r["k"]: r for r in DR.drift_report(days, ("2024-01-01", "2024-01-20"), ("2024-01-21", "2024-12-31"), ["k"]).collect()}
    assert set(rep) == {"a", "b"}
    for k in "ab":
        assert abs(rep[k]["ks"] - brute_ks(k)[0]) <= 0.01
        seen = [{r[3] for r in ROWS if r[0] == k and r[1] and (r[1] >= CUT) == s and r[3] is not None} for s in (False, True)]
        assert abs(rep[k]["new_ids"] - len(seen[1] - seen[0]) / len(seen[1])) < 0.03
    assert rep["b"]["psi"] > rep["a"]["psi"]
    # any window from the same days, and one without groups
    one = DR.drift_report(DR.daily_sketches(df, "ts", "v", "u"), ("2024-01-01", "2024-01-05"), ("2024-01-06", "2024-01-10")).collect()
    assert len(one) == 1 and 0 <= one[0]["ks"] < 0.2


def test_small_and_large_distances(spark):
    """p-values where either series of the limit law converges slowly."""
    for shift, want in ((0, 1.0), (1000, 0.0)):
        df = spark.range(400).selectExpr("id % 2 = 1 AS cur", f"cast(id div 2 + if(id % 2 = 1, {shift}, 0) AS double) AS v")
        r = DR.ks_exact(df, "v", F.col("cur")).first()
        assert abs(r["p_value"] - want) < 1e-12
    assert DR.ks_exact(df.where("false"), "v", F.col("cur")).count() == 0
