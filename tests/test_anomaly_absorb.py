"""Isolation forest and regressions with an absorbed predictor."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import anomaly as AN
from kestrel.operators.stats import ols as OL

R = random.Random(12)


def test_planted_outliers(spark):
    rows = [(i, R.gauss(0, 1), R.gauss(5, 2), "x") for i in range(4000)] + [(10000 + i, R.choice([-9.0, 9.0]), R.choice([-15.0, 25.0]), "x") for i in range(40)]
    rows += [(20000, None, 5.0, "x"), (20001, float("nan"), None, "x"), (20002, 0.0, 5.0, "x"), (20002, 0.0, 5.0, "x")]
    df = spark.createDataFrame(rows, "id long, a double, b double, score string")
    got = AN.isolation_forest(df, ["a", "b"], ["id"]).collect()
    assert len(got) == len(rows) and all(0 < r["score"] < 1 for r in got)
    score = {r["id"]: r["score"] for r in got}
    planted = [score[10000 + i] for i in range(40)]
    assert np.mean([s >= 0.6 for s in planted]) >= 0.95 and np.mean([score[i] >= 0.6 for i in range(4000)]) < 0.05
    assert max(score[20000], score[20001], score[20002]) < 0.6
    # the same rows in another order and layout get the same scores
    again = {r["id"]: r["score"] for r in AN.isolation_forest(df.repartition(5).orderBy(F.rand(3)), ["a", "b"], ["id"]).collect()}
    assert again == score
    assert AN.isolation_forest(df.where("false"), ["a", "b"], ["id"]).count() == 0
    one = AN.isolation_forest(df.limit(1), ["a", "b"], ["id"]).collect()
    assert len(one) == 1


def test_paths_against_walk():
    """Vectorised scores equal a walk of each row down each tree."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    forest = [AN._tree(x[rng.choice(300, 64, replace=False)], rng, 6) for _ in range(10)]
    want = []
    for row in x:
        total = 0.0
        for f, cut, left, right, depth in forest:
            at = 0
            while f[at] >= 0:
                at = left[at] if row[f[at]] <= cut[at] else right[at]
            total += depth[at]
        want.append(2 ** (-total / 10 / float(AN._path_length(64))))
    assert np.allclose(AN._scores(forest, x, 64), want)


def dense(rows):
    """Least squares with a dummy per level."""
    rows = [r for r in rows if None not in r]
    levels = sorted({r[3] for r in rows})
    x = np.array([[r[1], r[2], *[float(r[3] == v) for v in levels]] for r in rows])
    y = np.array([r[0] for r in rows])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rss = ((y - x @ beta) ** 2).sum()
    cov = rss / (len(y) - x.shape[1]) * np.linalg.inv(x.T @ x)
    return dict(zip(levels, beta[2:])), beta[:2], np.sqrt(np.diag(cov))[:2], rss


def test_equal_to_dummies(spark):
    rows = [(0.0, R.gauss(0, 1), R.gauss(3, 2), R.randint(0, 30)) for _ in range(600)]
    rows = [(2 * a - 0.5 * b + g * 0.3 + R.gauss(0, 1), a, b, g) for _, a, b, g in rows] + [(1.0, 2.0, 3.0, 999), (None, 1.0, 1.0, 1), (1.0, None, 1.0, 1), (1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "y double, a double, b double, g int")
    fit = OL.ols_absorbed(df, "y", ["a", "b"], "g")
    effects, slopes, errors, rss = dense(rows)
    got = {r["term"]: r for r in OL.absorbed_coefficients(fit).collect()}
    for term, b, se in zip(("a", "b"), slopes, errors):
        assert got[term]["coefficient"] == pytest.approx(b, rel=1e-9) and got[term]["std_error"] == pytest.approx(se, rel=1e-9)
        assert got[term]["lower_bound"] < b < got[term]["upper_bound"]
    assert fit.rss == pytest.approx(rss, rel=1e-9) and fit.levels == len(effects)
    assert all(r["effect"] == pytest.approx(effects[int(r["level"])], rel=1e-8, abs=1e-9) for r in OL.absorbed_effects(fit).collect())


def test_many_levels_and_not_estimable(spark):
    """A hundred thousand levels; a predictor that is constant within them."""
    big = spark.range(300000).selectExpr("cast(id % 100000 AS string) AS g", "cast(id * 7919 % 1009 AS double) AS a").withColumn(
        "y", F.col("a") * 3 + F.pmod(F.xxhash64("g"), F.lit(50)))
    fit = OL.ols_absorbed(big, "y", ["a"], "g")
    assert fit.levels == 100000 and fit.beta[0] == pytest.approx(3.0, rel=1e-9)
    flat = big.withColumn("c", F.length("g").cast("double"))
    fit = OL.ols_absorbed(flat, "y", ["a", "c"], "g")
    assert fit.beta is None and fit.rank == 1 and OL.absorbed_coefficients(fit).count() == 0
    assert OL.ols_absorbed(big.where("false"), "y", ["a"], "g").beta is None


def test_rows_are_read_once(spark, monkeypatch):
    """A level in many chunks and tasks, values far from zero: the fit of
    all dummies, from one pass over the rows."""
    monkeypatch.setattr(OL, "CENTRED_ROWS", 40)
    rows = [(1e6 * (i % 7) + 3 * (i % 11) + i % 5, float(i % 11) + 1e5 * (i % 7), float(i * i % 13), i % 7) for i in range(700)]
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, "y double, a double, b double, g int").repartition(5)
    fit = OL.ols_absorbed(df.mapInArrow(seen, df.schema), "y", ["a", "b"], "g")
    effects, slopes, errors, rss = dense([(r[0] - 1e6 * r[3], r[1] - 1e5 * r[3], r[2], r[3]) for r in rows])
    assert read.value == len(rows) and fit.n == 700 and fit.levels == 7
    assert fit.beta == pytest.approx(slopes, rel=1e-7) and fit.rss == pytest.approx(rss, rel=1e-7)
    y = np.array([r[0] for r in rows])
    assert fit.tss == pytest.approx(((y - y.mean()) ** 2).sum(), rel=1e-9)
