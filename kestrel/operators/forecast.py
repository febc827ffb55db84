"""Forecasting: additive Holt-Winters as a scan of affine maps.

One step of the recursion is an affine map of the state (level, trend,
seasonals), so the map of a stretch of points is the product of its steps.
Series are range-partitioned on (key, time) and cut into chunks; all chunks
of a task run side by side from a zero state, their maps are composed, and
once each chunk's true first state is known all run again side by side. A
series with a third of all points is spread over partitions like any other.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.operators.ranks import _n_parts
from kestrel.session import cut_lineage

#: Points of a chunk: steps that are taken one after another in a task.
CHUNK = 1024


class _Smoother:
    """One set of parameters. State: level, trend, then the seasonals in the
    order in which they come up."""

    def __init__(self, season: int, alpha: float, beta: float, gamma: float):
        self.m, self.d = season, 2 + season
        self.gain = np.array([alpha, alpha * beta, gamma * (1 - alpha)])
        a = np.zeros((self.d, self.d))
        a[0, :2] = a[1, 1] = 1
        for i in range(season):
            a[2 + i, 2 + (i + 1) % season] = 1
        see = np.zeros(self.d)                         # the prediction of the next point
        see[:2] = 1
        push = np.zeros(self.d)                        # what its error does to the state
        push[:2] = self.gain[:2]
        if season:
            see[2] = 1
            push[1 + season] = self.gain[2]
        self.blind, self.matrix = a, a - np.outer(push, see)

    def run(self, state, points, full):
        """Runs lanes of points (lanes x steps, NaN where none) from states
        (lanes x d); ``full``: points of each lane. Returns predictions and
        end states."""
        state = state.copy()
        seen = np.full(points.shape, np.nan)
        al, be, ga = self.gain
        for t in range(points.shape[1]):
            live = full > t
            guess = state[:, 0] + state[:, 1] + (state[:, 2] if self.m else 0)
            error = np.where(np.isnan(points[:, t]), 0, points[:, t] - guess)
            new = state.copy()
            new[:, 0] = state[:, 0] + state[:, 1] + al * error
            new[:, 1] = state[:, 1] + be * error
            if self.m:
                new[:, 2:-1] = state[:, 3:]
                new[:, -1] = state[:, 2] + ga * error
            seen[:, t] = np.where(live, guess, np.nan)
            state = np.where(live[:, None], new, state)
        return seen, state

    def power(self, points):
        """The matrix of a stretch of points (NaN: nothing was seen)."""
        gaps = np.flatnonzero(np.isnan(points))
        out, at = np.eye(self.d), 0
        for g in [*gaps.tolist(), len(points)]:
            out = np.linalg.matrix_power(self.matrix, g - at) @ out
            if g < len(points):
                out = self.blind @ out
            at = g + 1
        return out


def _lanes(chunks):
    full = np.array([len(c) for c in chunks])
    out = np.full((len(chunks), int(full.max(initial=0))), np.nan)
    for i, c in enumerate(chunks):
        out[i, :len(c)] = c
    return out, full


def _chunks(keys, smoother):
    """Sorted rows (key columns, _t, _y) as chunks of one series, each with
    the map from its partition's first point of the series up to its own
    first point: ``mat`` and ``vec``; ``mat_end`` and ``vec_end`` with it."""
    d = smoother.d

    def emit(run):
        if not run:
            return
        points, full = _lanes([y for _, _, y, _ in run])
        _, ends = smoother.run(np.zeros((len(run), d)), points, full)
        rows, mat, vec, powers = [], np.eye(d), np.zeros(d), {}
        for i, (key, times, y, number) in enumerate(run):
            if number == 0:
                mat, vec = np.eye(d), np.zeros(d)
            elif i == 0:
                mat, vec = emit.mat, emit.vec
            gaps = np.isnan(y).any()
            step = smoother.power(y) if gaps else powers.setdefault(len(y), smoother.power(y))
            mat_end, vec_end = step @ mat, step @ vec + ends[i]
            rows.append((key, times, y, number, mat, vec, mat_end, vec_end))
            mat, vec = mat_end, vec_end
        emit.mat, emit.vec = mat, vec
        cols = [pa.array([r[0][k] for r in rows], type=emit.types[k]) for k in range(len(keys))]
        lists = [pa.array([list(r[j].ravel()) for r in rows], pa.list_(pa.float64())) for j in (2, 4, 5, 6, 7)]
        yield pa.record_batch([*cols, pa.array([r[3] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(emit.types[-1])), *lists],
                              names=[*keys, "_n", "_ts", "_ys", "_mat", "_vec", "_mat_end", "_vec_end"])

    def run(batches):
        emit.types, emit.mat, emit.vec = None, np.eye(d), np.zeros(d)
        key, times, ys, number, ready = None, [], [], 0, []
        for batch in batches:
            if emit.types is None:
                emit.types = [batch.schema.field(i).type for i in range(len(keys) + 1)]
            names = list(zip(*[batch.column(i).to_pylist() for i in range(len(keys))])) if keys else [()] * batch.num_rows
            t = batch.column(len(keys)).to_pylist()
            y = batch.column(len(keys) + 1).to_numpy(zero_copy_only=False).astype(float)
            cut = [i for i in range(1, len(names)) if names[i] != names[i - 1]]
            for s, e in zip([0, *cut], [*cut, len(names)]):
                if s == e:
                    continue
                if names[s] != key:
                    if key is not None and times:
                        ready.append((key, times, np.array(ys), number))
                    key, times, ys, number = names[s], [], [], 0
                while s < e:
                    room = min(CHUNK - len(times), e - s)
                    times += t[s:s + room]
                    ys += y[s:s + room].tolist()
                    s += room
                    if len(times) == CHUNK:
                        ready.append((key, times, np.array(ys), number))
                        times, ys, number = [], [], number + 1
            if len(ready) >= 256:
                yield from emit(ready)
                ready = []
        if times:
            ready.append((key, times, np.array(ys), number))
        yield from emit(ready)
    return run


def _type(df, c):
    return df.schema[c].dataType.simpleString()


def holt_winters_fit(df: DataFrame, by: list[str], ts_col: str, value_col: str, season: int, alpha: float = 0.3,
                     beta: float = 0.1, gamma: float = 0.1, partitions: int | None = None) -> DataFrame:
    """Chunks of fitted series: by..., _ts and _ys (arrays of times and
    values), _fit (what was expected at each), _state (after the chunk),
    _sse, _obs, _last (the series' last chunk). ``fitted`` and ``forecast``
    read it.

    Rows of a series are taken in the order of ``ts_col``, one per time
    (``timeseries`` fills gaps); a null or NaN value is a point that was not
    seen: the state moves on without it. The state before the first point:
    level = mean of the first season, trend = difference to the mean of the
    second season per step, seasonals = first season minus level (0 where
    there is none). ``season`` 0 or 1 means no seasonals. Rows without key or
    time are left out."""
    by, m = list(by), season if season > 1 else 0
    sm = _Smoother(m, alpha, beta, gamma if m else 0.0)
    y = F.col(value_col).cast("double")
    rows = df.select(*by, F.col(ts_col).alias("_t"), F.when(~F.isnan(y), y).alias("_y")).where("_t IS NOT NULL")
    for b in by:
        rows = rows.where(F.col(b).isNotNull())
    kinds = ", ".join([f"`{b}` {_type(rows, b)}" for b in by])
    head = f"{kinds}, " if by else ""
    lists = "_ys array<double>, _mat array<double>, _vec array<double>, _mat_end array<double>, _vec_end array<double>"
    cut = (rows.repartitionByRange(partitions or _n_parts(df), *by, "_t").sortWithinPartitions(*by, "_t")
           .mapInArrow(_chunks(by, sm), f"{head}_n long, _ts array<{_type(rows, '_t')}>, {lists}")
           .withColumn("_pid", F.spark_partition_id()))
    cut = cut_lineage(cut)

    # first states: the first two seasons of each series (limited per task before the shuffle)
    span = max(2 * m, 2)
    w = Window.partitionBy(*by).orderBy("_t") if by else Window.orderBy("_t")
    head_rows = rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= span)
    half = span // 2
    first = head_rows.groupBy(*by).agg(
        F.avg(F.when(F.col("_i") <= half, F.col("_y"))).alias("_l"), F.avg(F.when(F.col("_i") > half, F.col("_y"))).alias("_l2"),
        *[F.max(F.when(F.col("_i") == i + 1, F.col("_y"))).alias(f"_s{i}") for i in range(m)])
    level = F.coalesce("_l", F.lit(0.0))
    first = first.select(*by, F.array(level, F.coalesce((F.col("_l2") - F.col("_l")) / half, F.lit(0.0)),
                                      *[F.coalesce(F.col(f"_s{i}") - level, F.lit(0.0)) for i in range(m)]).alias("_first"))

    # what comes in from earlier partitions: only each partition's first series can have begun before
    ends = cut.groupBy(*by, "_pid").agg(F.max_by(F.struct("_mat_end", "_vec_end"), "_n").alias("_map"))
    across = ends.groupBy(*by).agg(F.count("*").alias("_k"), F.sort_array(F.collect_list(F.struct("_pid", "_map"))).alias("_maps"))
    across = across.where("_k > 1").join(first, by) if by else across.where("_k > 1").crossJoin(first)
    d = sm.d

    def spread(batches):
        for batch in batches:
            for row in batch.to_pylist():
                state = np.array(row["_first"])
                pids, states = [], []
                for part in row["_maps"]:
                    pids.append(part["_pid"])
                    states.append(state.tolist())
                    state = np.array(part["_map"]["_mat_end"]).reshape(d, d) @ state + np.array(part["_map"]["_vec_end"])
                yield pa.record_batch([*[pa.array([row[b]] * len(pids), type=batch.schema.field(b).type) for b in by],
                                       pa.array(pids, pa.int32()), pa.array(states, pa.list_(pa.float64()))], names=[*by, "_at", "_begin"])

    begun = across.select(*by, "_first", "_maps").mapInArrow(spread, f"{head}_at int, _begin array<double>")
    if by:
        begun = begun.select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], "_at", "_begin")
        on = [F.col(b) == F.col(f"_b{i}") for i, b in enumerate(by)] + [F.col("_pid") == F.col("_at")]
        whole = cut.join(first, by)
    else:
        on, whole = [F.col("_pid") == F.col("_at")], cut.crossJoin(F.broadcast(first))
    whole = whole.join(F.broadcast(begun), on, "left")                  # one row per partition at most
    whole = whole.withColumn("_begin", F.coalesce("_begin", "_first"))
    last = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    tops = cut.groupBy(*by).agg(F.max(F.struct("_pid", "_n")).alias("_top"))
    whole = whole.join(tops, by) if by else whole.crossJoin(F.broadcast(tops))
    del last
    whole = whole.select(*by, "_ts", "_ys", "_mat", "_vec", "_begin", (F.struct("_pid", "_n") == F.col("_top")).alias("_last"))

    def fit(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            get = lambda c: np.array(batch.column(c).to_pylist(), float).reshape(n, -1)
            start = np.einsum("nij,nj->ni", get("_mat").reshape(n, d, d), get("_begin")) + get("_vec")
            points, full = _lanes([np.array(v, float) for v in batch.column("_ys").to_pylist()])
            seen, end = sm.run(start, points, full)
            error = np.where(np.isnan(points), 0, points - seen)
            yield pa.record_batch([*[batch.column(b) for b in by], batch.column("_ts"), batch.column("_ys"),
                                   pa.array([seen[i, :full[i]].tolist() for i in range(n)], pa.list_(pa.float64())),
                                   pa.array(end.tolist(), pa.list_(pa.float64())), pa.array((error ** 2).sum(1)),
                                   pa.array((~np.isnan(points)).sum(1)), batch.column("_last")],
                                  names=[*by, "_ts", "_ys", "_fit", "_state", "_sse", "_obs", "_last"])

    return cut_lineage(whole.mapInArrow(fit, f"{head}_ts array<{_type(rows, '_t')}>, _ys array<double>, _fit array<double>, "
                                             "_state array<double>, _sse double, _obs long, _last boolean"))


def fitted(fit: DataFrame, by: list[str], ts_col: str, value_col: str) -> DataFrame:
    """(by..., ts, value, expected, error) of every point; a value that was
    not seen is null and has no error."""
    rows = fit.select(*by, F.explode(F.arrays_zip("_ts", "_ys", "_fit")).alias("x"))
    v = F.when(~F.isnan("x._ys"), F.col("x._ys"))
    return rows.select(*by, F.col("x._ts").alias(ts_col), v.alias(value_col), F.col("x._fit").alias("expected"), (v - F.col("x._fit")).alias("error"))


def forecast(fit: DataFrame, by: list[str], horizon: int, season: int, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.1,
             confidence: float = 0.95) -> DataFrame:
    """(by..., last_ts, step, forecast, lower, upper, sigma) for the steps 1
    to ``horizon`` behind each series' last point. sigma is the root mean
    square error of one step; the variance of step h is
    sigma^2 (1 + sum over j < h of (alpha (1 + j beta) + gamma (1 - alpha) [j a multiple of the season])^2)."""
    m = season if season > 1 else 0
    total = fit.groupBy(*by).agg(F.sum("_sse").alias("sse"), F.sum("_obs").alias("obs"))
    end = fit.where("_last").select(*by, F.element_at("_ts", -1).alias("last_ts"), "_state")
    end = end.join(total, by) if by else end.crossJoin(total)
    sums, spread = 0.0, []
    for h in range(1, horizon + 1):
        spread.append((1 + sums) ** 0.5)
        sums += (alpha * (1 + h * beta) + (gamma * (1 - alpha) if m and h % m == 0 else 0.0)) ** 2
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    steps = F.explode(F.array(*[F.struct(F.lit(h).alias("step"), F.lit(s).alias("wide")) for h, s in enumerate(spread, 1)])).alias("x")
    out = end.select(*by, "last_ts", "_state", F.sqrt(F.col("sse") / F.col("obs")).alias("sigma"), steps)
    at = F.col("_state")[0] + F.col("x.step") * F.col("_state")[1]
    if m:
        at = at + F.element_at("_state", (F.lit(3) + (F.col("x.step") - 1) % m).cast("int"))
    half = z * F.col("sigma") * F.col("x.wide")
    return out.select(*by, "last_ts", F.col("x.step").alias("step"), at.alias("forecast"), (at - half).alias("lower"), (at + half).alias("upper"), "sigma")
