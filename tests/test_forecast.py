"""Holt-Winters against a sequential run over each series."""
import math
import random

import numpy as np
import pytest

from kestrel.operators import forecast as FC

R = random.Random(4)


def series(n, gaps):
    out = [50 + 0.2 * t + 8 * math.sin(t * 2 * math.pi / 7) + R.gauss(0, 1) for t in range(n)]
    return [None if gaps and t % 11 == 3 else float("nan") if gaps and t % 37 == 5 else y for t, y in enumerate(out)]


def brute(ys, m, al, be, ga, horizon):
    seen = lambda v: v is not None and v == v
    mean = lambda v: sum(x for x in v if seen(x)) / max(sum(map(seen, v)), 1) if any(map(seen, v)) else None
    half = m or 1
    level = mean(ys[:half]) or 0.0
    two = mean(ys[half:2 * half])
    trend = (two - mean(ys[:half])) / half if two is not None and mean(ys[:half]) is not None else 0.0
    s = [ys[i] - level if i < len(ys) and seen(ys[i]) else 0.0 for i in range(m)]
    fit, errors = [], []
    for t, y in enumerate(ys):
        guess = level + trend + (s[t % m] if m else 0)
        fit.append(guess)
        old, was = level, s[t % m] if m else 0
        if seen(y):
            errors.append(y - guess)
            level = al * (y - was) + (1 - al) * (level + trend)
            trend = be * (level - old) + (1 - be) * trend
            if m:
                s[t % m] = ga * (y - level) + (1 - ga) * was
        else:
            level += trend
    ahead = [level + h * trend + (s[(len(ys) + h - 1) % m] if m else 0) for h in range(1, horizon + 1)]
    return fit, ahead, math.sqrt(sum(e * e for e in errors) / max(len(errors), 1))


@pytest.mark.parametrize("season,gaps,parts", [(7, True, 5), (0, False, 3), (7, False, 1)])
def test_against_sequential(spark, monkeypatch, season, gaps, parts):
    """Series longer than partitions, shorter than a season, of one point."""
    monkeypatch.setattr(FC, "CHUNK", 16)
    data = {"long": series(1500, gaps), "mid": series(40, gaps), "short": series(5, gaps), "one": [3.0]}
    rows = [(k, t, y) for k, ys in data.items() for t, y in enumerate(ys)] + [(None, 1, 1.0), ("mid", None, 1.0)]
    R.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t int, y double").repartition(3)
    fit = FC.holt_winters_fit(df, ["k"], "t", "y", season, 0.4, 0.2, 0.3, partitions=parts)
    got = {}
    for r in FC.fitted(fit, ["k"], "t", "y").collect():
        got.setdefault(r["k"], {})[r["t"]] = r
    ahead = {(r["k"], r["step"]): r for r in FC.forecast(fit, ["k"], 10, season, 0.4, 0.2, 0.3).collect()}
    assert len(ahead) == 40
    for k, ys in data.items():
        want, far, sigma = brute(ys, season, 0.4, 0.2, 0.3 if season else 0.0, 10)
        assert np.allclose([got[k][t]["expected"] for t in range(len(ys))], want, atol=1e-8)
        assert all((got[k][t]["y"] is None) == (y is None or y != y) for t, y in enumerate(ys))
        for h, f in enumerate(far, 1):
            r = ahead[(k, h)]
            assert abs(r["forecast"] - f) < 1e-7 and r["last_ts"] == len(ys) - 1 and abs(r["sigma"] - sigma) < 1e-8
            assert r["lower"] <= r["forecast"] <= r["upper"]


def test_no_key_and_empty(spark):
    ys = series(60, False)
    df = spark.createDataFrame(list(enumerate(ys)), "t int, y double")
    fit = FC.holt_winters_fit(df, [], "t", "y", 7, partitions=3)
    got = [r["forecast"] for r in FC.forecast(fit, [], 5, 7).orderBy("step").collect()]
    assert np.allclose(got, brute(ys, 7, 0.3, 0.1, 0.1, 5)[1])
    assert FC.fitted(FC.holt_winters_fit(df.where("false"), [], "t", "y", 7), [], "t", "y").count() == 0


def test_intervals_cover(spark):
    """About 95 of 100 one-step errors lie inside the interval's half width."""
    df = spark.createDataFrame(list(enumerate(series(3000, False))), "t int, y double")
    fit = FC.holt_winters_fit(df, [], "t", "y", 7, 0.1, 0.01, 0.1)
    width = FC.forecast(fit, [], 1, 7, 0.1, 0.01, 0.1).first()
    half = (width["upper"] - width["lower"]) / 2
    errors = [abs(r["error"]) for r in FC.fitted(fit, [], "t", "y").where("t > 50").collect()]
    assert 0.93 < np.mean(np.array(errors) <= half) < 0.97
