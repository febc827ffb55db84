"""Anomaly detection: an isolation forest, fitted on bounded samples and
applied to every row in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.columns import numeric_col, require_columns

#: Rows of a tree's sample and number of trees: the forest is fitted on at
#: most TREES * SAMPLE rows, whatever the size of the table.
SAMPLE, TREES = 256, 100


def _path_length(n):
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def _tree(x, rng, limit):
    """Arrays (feature, cut, left, right, depth) of one tree; a leaf has
    feature -1 and its depth plus the mean path of the rows left in it."""
    nodes, todo = [], [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, 0.0])
        if parent >= 0:
            nodes[parent][2 + side] = at
        lo, hi = x[rows].min(0), x[rows].max(0)
        wide = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) < 2 or not len(wide):
            nodes[at][4] = depth + float(_path_length(len(rows)))
            continue
        f = int(rng.choice(wide))
        cut = lo[f] + (hi[f] - lo[f]) * rng.random()
        low = x[rows, f] <= cut
        nodes[at][:2] = [f, cut]
        todo += [(rows[low], depth + 1, at, 0), (rows[~low], depth + 1, at, 1)]
    a = np.array(nodes)
    return a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]


def _scores(trees, x, size):
    """2 ** (-mean path / expected path) of each row: near 1 is isolated."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, cut, left, right, depth in trees:
        at = np.zeros(len(x), int)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            low = x[rows, np.where(inner, f, 0)] <= cut[at]
            at = np.where(inner, np.where(low, left[at], right[at]), at)
        total += depth[at]
    return 2.0 ** (-(total / len(trees)) / max(float(_path_length(size)), 1e-12))


def isolation_forest(df: DataFrame, columns: list[str], id_cols: list[str], trees: int = TREES, sample: int = SAMPLE,
                     threshold: float = 0.6, seed: int = 7) -> DataFrame:
    """Every row's id columns with score (0 to 1; above about 0.6 a row is
    easier to isolate than most) and anomaly (score >= threshold).

    The trees are grown on the driver from the ``trees * sample`` rows with
    the smallest hash of id and values (a bounded sample that does not
    depend on the order of rows; a smaller table is used whole), standardised
    columns are not needed. The forest goes to the tasks as arrays and scores
    all rows where they are read: nothing is shuffled. A missing or NaN value
    counts as the column's median in the sample; with no value at all the
    column takes no part. An empty table gives an empty result; equal rows
    get equal scores."""
    require_columns(df, *columns, *id_cols)
    cells = [numeric_col(df, c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    order = F.xxhash64(F.lit(seed), *[F.col(c) for c in id_cols], *[numeric_col(df, c).cast("double") for c in columns])
    rows = df.select(*cells, order.alias("h")).orderBy("h", *[f"x{i}" for i in range(len(columns))]).limit(trees * sample).drop("h").toPandas()
    x = rows.to_numpy(dtype=float)
    x[~np.isfinite(x)] = np.nan
    with np.errstate(all="ignore"):
        fill = np.array([np.nanmedian(c) if np.isfinite(c).any() else 0.0 for c in x.T]) if len(x) else np.zeros(len(columns))
    x = np.where(np.isnan(x), fill, x)
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    forest = [_tree(x[rng.choice(len(x), size, replace=False)], rng, limit) for _ in range(trees)] if len(x) else []
    held = df.sparkSession.sparkContext.broadcast((forest, fill, size))        # at most trees * 2 * sample nodes

    def run(batches):
        grown, middle, n = held.value
        for b in batches:
            v = np.column_stack([b.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))])
            v = np.where(np.isfinite(v), v, middle)
            yield pa.record_batch([*[b.column(f"id{i}") for i in range(len(id_cols))], pa.array(_scores(grown, v, n) if grown else np.zeros(len(v)))],
                                  names=[*[f"id{i}" for i in range(len(id_cols))], "score"])
    src = df.select(*[F.col(c).alias(f"id{i}") for i, c in enumerate(id_cols)], *cells)
    shape = ", ".join([*[f"id{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(id_cols)], "score double"])
    out = src.mapInArrow(run, shape)
    return out.select(*[F.col(f"id{i}").alias(c) for i, c in enumerate(id_cols)], "score", (F.col("score") >= threshold).alias("anomaly"))
