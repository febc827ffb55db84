"""Hard negatives against brute force, and the threshold kernel."""
import math

import numpy as np
import pytest

from kestrel.llm import negatives as N


def brute(rows, every=50, k=5, m=3):
    ok = [(i, c, [math.floor(256 * x) for x in v]) for i, c, v in rows
          if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, q in {(i, c, tuple(v)) for i, c, v in ok if i is not None and i % every == 0}:       # repeated anchors are one
        scored = [(-sum(x * y for x, y in zip(q, v)), i is None, i or 0, i, c) for i, c, v in ok if i != a]
        scored.sort(key=lambda s: s[:3])
        for p in [s for s in scored if s[4] == label][:k]:
            inside = [s for s in scored if s[4] != label and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:m]
            out += [(a, p[3], r + 1, s[3], -p[0], -s[0]) for r, s in enumerate(inside)]
    return out


@pytest.mark.parametrize("seed,d", [(0, 8), (1, 40), (2, 3)])
def test_mining(spark, monkeypatch, seed, d):
    """Nulls, non-finite and short vectors, ties, repeated rows, copies of an
    anchor, a label of one row and one without enough; small blocks and
    slices."""
    monkeypatch.setattr(N, "ROWS", 37)
    monkeypatch.setattr(N, "ANCHORS", 3)
    monkeypatch.setattr(N, "SLICE", 2)
    r = np.random.default_rng(seed)
    centre = r.normal(size=(4, d))
    rows = [(i, int(i % 4), (centre[i % 5 % 4] + r.normal(size=d)).tolist()) for i in range(400)]
    rows += [(1000 + i, i % 3, rows[0][2]) for i in range(6)] + [(1050, 77, rows[1][2]), (1051, 78, rows[1][2]), (1100, 79, rows[2][2]), (1101, 79, rows[2][2])]
    rows += [(2000, None, rows[3][2]), (2050, 1, None), (2051, 1, [None] * d), (2052, 1, [float("nan")] * d), (2053, 1, [float("inf")] * d),
             (2054, 1, rows[4][2][:1]), (2055, 2, []), (None, 1, rows[5][2]), (None, 2, rows[5][2]), (7, 3, rows[7][2]), (50, 2, rows[50][2])]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, label int, embedding array<double>, id int, t int")
    got = [tuple(x) for x in N.hard_negatives(df).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_empty_and_no_anchor(spark):
    df = spark.createDataFrame([(1, 1, [1.0]), (3, 2, [1.0])], "vec_id long, label int, embedding array<float>")
    assert N.hard_negatives(df).count() == 0 and N.hard_negatives(df.where("false")).count() == 0
    assert N.hard_negatives(df, anchors="vec_id = 1").count() == 0


def test_kernel():
    r = np.random.default_rng(4)
    for trial in range(80):
        d = int(r.integers(1, 70))
        x, q = r.integers(-90, 90, (int(r.integers(1, 300)), d)), r.integers(-90, 90, (int(r.integers(1, 40)), d))
        if trial % 3 == 0:                  # short rows leave the index, copies stay
            x[r.random(len(x)) < .3] //= 20
            q = np.concatenate([q, x[:3]])
        if trial % 4 == 0:
            x, q = x * 10**5, q * 10**4
        s = q @ x.T
        t = np.quantile(s, r.choice([0, .5, .9, .99, .999]), axis=1).astype(np.int64)
        if trial % 5 == 0:
            t[:] = N.NOTHING
        ok = r.random(s.shape) < .7
        i, k, got = N.scores_above(q, x, t, np.argsort(-(x * x).mean(0)), ok)
        w = np.nonzero((s >= t[:, None]) & ok)
        assert sorted(zip(i.tolist(), k.tolist(), got.tolist())) == sorted(zip(*[v.tolist() for v in w], s[w].tolist()))


def test_index_leaves_out_dimensions(monkeypatch):
    """Rows whose norm cannot reach a threshold are in no product at all."""
    x = np.concatenate([np.full((50, 64), 2), np.full((5, 64), 90)])
    seen = []
    real = np.zeros
    monkeypatch.setattr(N.np, "zeros", lambda *a, **k: seen.append(a[0]) or real(*a, **k))
    i, k, s = N.scores_above(np.full((2, 64), 90), x, np.full(2, 64 * 90 * 90), np.arange(64))
    assert sorted(set(k.tolist())) == [50, 51, 52, 53, 54] and (2, 5) in seen


def test_too_large():
    with pytest.raises(OverflowError):
        N.scores_above(np.full((1, 2), 1 << 40), np.full((1, 2), 1 << 40), np.zeros(1, np.int64), np.arange(2))
