"""ST10-ST18: ordinary least squares with diagnostics.

The fit is a tall-skinny QR (TSQR): every partition reduces its rows of
the augmented design [X | y] to a (k+1) x (k+1) triangular R with NumPy in
``mapInPandas``; a second level QRs the stacked R's of coalesced groups,
so the driver receives a bounded number of tiny matrices, never rows.
R gives the coefficients, their covariance, the residual sum of squares
and the rank (from the singular values of R, which are those of X - no
squared condition number as with a Gram matrix). Residual diagnostics are
further Spark aggregations with the coefficients as literals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.columns import numeric_col, require_columns
from kestrel.functions.special import chi2_sf, f_sf, t_ppf, t_pvalue
from kestrel.session import cut_lineage

MAX_LEVELS = 200
TREE_WIDTH = 32


def _design(df: DataFrame, target: str, predictors: list[str], max_levels: int = MAX_LEVELS, keep=()):
    """Complete cases and design columns: strings one-hot with the first
    sorted level dropped, booleans and numbers as they are; ``keep`` names
    columns that go along."""
    require_columns(df, target, *predictors)
    fields = {f.name: f.dataType for f in df.schema.fields}
    cols, names = [], []
    base = df.select(numeric_col(df, target).cast("double").alias("_y"),
                     *[(F.col(p).cast("string") if isinstance(fields[p], T.StringType)
                        else numeric_col(df, p).cast("double")).alias(f"_p{i}") for i, p in enumerate(predictors)], *keep)
    for i in range(len(predictors) + 1):
        c = "_y" if i == 0 else f"_p{i - 1}"
        base = base.where(F.col(c).isNotNull())
    for i, p in enumerate(predictors):
        if isinstance(fields[p], T.StringType):
            levels = [r[0] for r in base.select(f"_p{i}").distinct().orderBy(f"_p{i}").limit(max_levels + 1).collect()]
            if len(levels) > max_levels:
                raise ValueError(f"predictor {p} has more than {max_levels} levels: give it to ols_absorbed")
            for lv in levels[1:]:
                cols.append(F.when(F.col(f"_p{i}") == lv, 1.0).otherwise(0.0))
                names.append(f"{p}_{lv}")
        else:
            cols.append(F.col(f"_p{i}"))
            names.append(p)
    x = base.select(F.lit(1.0).alias("_x0"), *[c.alias(f"_x{j + 1}") for j, c in enumerate(cols)], "_y", *keep)
    return x, ["const", *names]


def _r_of(block: np.ndarray, width: int) -> np.ndarray:
    if block.shape[0] == 0:
        return np.zeros((0, width))
    r = np.linalg.qr(block, mode="r")
    return r


def _tsqr(x: DataFrame, width: int) -> np.ndarray:
    cols = x.columns
    schema = ", ".join(f"c{j} double" for j in range(width))

    def local(it):
        acc = np.zeros((0, width))
        for pdf in it:
            blk = np.vstack([acc, pdf[cols].to_numpy(dtype="float64")])
            acc = _r_of(blk, width)
        if acc.shape[0]:
            yield pd.DataFrame(acc, columns=[f"c{j}" for j in range(width)])

    level1 = x.mapInPandas(local, schema)
    level2 = level1.repartition(TREE_WIDTH)      # an exchange of small triangles: the scan keeps its own tasks
    level2 = level2.mapInPandas(
        lambda it: local(pdf.rename(columns=dict(zip([f"c{j}" for j in range(width)], cols))) for pdf in it), schema)
    rs = np.array([list(r) for r in level2.collect()], dtype="float64").reshape(-1, width)
    return _r_of(rs, width)


@dataclass
class OLSFit:
    terms: list[str]
    n: int
    rank: int
    beta: np.ndarray | None
    cov: np.ndarray | None
    rss: float
    tss: float
    gram: np.ndarray
    y_mean: float
    x_std: np.ndarray
    y_std: float
    alpha: float
    design: DataFrame

    @property
    def k(self):
        return len(self.terms)

    @property
    def reliable(self):
        return self.beta is not None


def ols_fit(df: DataFrame, target: str, predictors: list[str], alpha: float = 0.05) -> OLSFit:
    x, terms = _design(df, target, predictors)
    k = len(terms)
    mom = x.agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("ym"), F.stddev_pop("_y").alias("ys"),
                *[F.stddev_pop(f"_x{j}").alias(f"s{j}") for j in range(k)]).collect()[0]
    n = int(mom["n"])
    r = _tsqr(x, k + 1)
    if r.shape[0] < k + 1:
        r = np.vstack([r, np.zeros((k + 1 - r.shape[0], k + 1))])
    rxx, rxy, ryy = r[:k, :k], r[:k, k], float(r[k, k]) if r.shape[0] > k else 0.0
    sv = np.linalg.svd(rxx, compute_uv=False) if n else np.zeros(k)
    tol = (sv.max() if sv.size else 0.0) * max(n, k) * np.finfo(float).eps
    rank = int((sv > tol).sum())
    gram = rxx.T @ rxx
    x_std = np.array([mom[f"s{j}"] or 0.0 for j in range(k)])
    y_std = float(mom["ys"] or 0.0)
    tss = (y_std ** 2) * n
    if rank < k or n <= k:
        return OLSFit(terms, n, rank, None, None, math.nan, tss, gram, mom["ym"], x_std, y_std, alpha, x)
    beta = np.linalg.solve(rxx, rxy)
    rss = ryy ** 2
    rinv = np.linalg.inv(rxx)
    sigma2 = rss / (n - k)
    cov = sigma2 * (rinv @ rinv.T)
    return OLSFit(terms, n, rank, beta, cov, rss, tss, gram, mom["ym"], x_std, y_std, alpha, x)


def _spark(fit: OLSFit):
    return fit.design.sparkSession


def ols_coefficients(fit: OLSFit) -> DataFrame:
    """ST11 + CI6 + ST13: term, coefficient, std_error, t_stat, p_value,
    lower/upper bound, standardized_beta (beta * sd_x / sd_y, zero sd -> 1).
    Empty when the design is rank deficient."""
    schema = ("term string, coefficient double, std_error double, t_stat double, p_value double, "
              "lower_bound double, upper_bound double, standardized_beta double")
    if not fit.reliable:
        return _spark(fit).createDataFrame([], schema)
    dof = fit.n - fit.k
    crit = t_ppf(1 - fit.alpha / 2, dof)
    ys = fit.y_std if fit.y_std else 1.0
    rows = []
    for j, term in enumerate(fit.terms):
        b, se = float(fit.beta[j]), math.sqrt(max(fit.cov[j, j], 0.0))
        t = b / se if se > 0 else math.nan
        p = t_pvalue(t, dof) if se > 0 else math.nan
        xs = float(fit.x_std[j]) if fit.x_std[j] else 1.0
        std_b = 0.0 if term == "const" else float(b * xs / ys)
        rows.append((term, b, se, t, p, b - crit * se, b + crit * se, std_b))
    return _spark(fit).createDataFrame(rows, schema)


def ols_fit_metrics(fit: OLSFit) -> DataFrame:
    """ST12 + EF5: n, k, rank, R², adjusted R², F, its p-value, decision
    (any slope p < alpha), status."""
    schema = ("n long, k long, rank long, r_squared double, adj_r_squared double, f_statistic double, "
              "f_p_value double, rss double, status string, decision string")
    if not fit.reliable:
        return _spark(fit).createDataFrame(
            [(fit.n, fit.k, fit.rank, None, None, None, None, None, "not_reliable", "not_reliable")], schema)
    n, k = fit.n, fit.k
    r2 = 1 - fit.rss / fit.tss if fit.tss > 0 else math.nan
    adj = 1 - (1 - r2) * (n - 1) / (n - k) if n > k else math.nan
    f = ((fit.tss - fit.rss) / (k - 1)) / (fit.rss / (n - k)) if k > 1 and fit.rss > 0 else math.nan
    fp = f_sf(f, k - 1, n - k) if not math.isnan(f) else math.nan
    pv = [t_pvalue(float(fit.beta[j]) / math.sqrt(fit.cov[j, j]), n - k) if fit.cov[j, j] > 0 else math.nan
          for j in range(1, k)]
    dec = "reject_null" if any(p < fit.alpha for p in pv if not math.isnan(p)) else "fail_to_reject_null"
    return _spark(fit).createDataFrame([(n, k, fit.rank, r2, adj, f, fp, fit.rss, "ok", dec)], schema)


def _fitted(fit: OLSFit) -> Column:
    expr = F.lit(0.0)
    for j in range(fit.k):
        expr = expr + F.lit(float(fit.beta[j])) * F.col(f"_x{j}")
    return expr


def ols_diagnostics(fit: OLSFit) -> DataFrame:
    """ST14-ST16: Jarque-Bera (population skewness / excess kurtosis of the
    residuals), studentized Breusch-Pagan (n·R² of e² on the design, a
    second TSQR), and the count of |e| > 3·sd(e)."""
    schema = ("n long, residual_skew double, residual_kurtosis double, jarque_bera double, jb_p_value double, "
              "breusch_pagan double, bp_p_value double, residual_outliers long")
    if not fit.reliable:
        return _spark(fit).createDataFrame([], schema)
    e = fit.design.withColumn("_e", F.col("_y") - _fitted(fit))
    m = e.agg(F.skewness("_e").alias("s"), F.kurtosis("_e").alias("k"), F.stddev_pop("_e").alias("sd"),
              F.avg(F.col("_e") * F.col("_e")).alias("e2m"), F.stddev_pop(F.col("_e") * F.col("_e")).alias("e2s"))
    cnt = e.crossJoin(F.broadcast(m)).agg(F.count_if(F.abs("_e") > 3 * F.col("sd")).alias("o"),
                                           F.max("s").alias("s"), F.max("k").alias("k"),
                                           F.max("e2s").alias("e2s")).collect()[0]
    n = fit.n
    s, kk = float(cnt["s"] or 0.0), float(cnt["k"] or 0.0)
    jb = n / 6.0 * (s * s + kk * kk / 4.0)
    aux = e.select(*[f"_x{j}" for j in range(fit.k)], (F.col("_e") * F.col("_e")).alias("_y"))
    r = _tsqr(aux, fit.k + 1)
    rss_aux = float(r[fit.k, fit.k]) ** 2 if r.shape[0] > fit.k else 0.0
    tss_aux = (float(cnt["e2s"] or 0.0) ** 2) * n
    r2_aux = 1 - rss_aux / tss_aux if tss_aux > 0 else 0.0
    bp = n * r2_aux
    return _spark(fit).createDataFrame(
        [(n, s, kk, jb, chi2_sf(jb, 2), bp, chi2_sf(bp, fit.k - 1) if fit.k > 1 else math.nan, int(cnt["o"]))],
        schema)


def ols_vif(fit: OLSFit) -> DataFrame:
    """ST17: VIF per predictor (only with >= 2 predictors). ``vif`` is the
    reference's uncentred form on the design without the constant;
    ``vif_centered`` the textbook one. warn when >= 10."""
    schema = "term string, vif double, vif_centered double, warn boolean"
    k = fit.k
    if k < 3:
        return _spark(fit).createDataFrame([], schema)
    g = fit.gram
    n = g[0, 0]
    gp = g[1:, 1:]
    s = g[0, 1:]
    try:
        unc = np.diag(gp) * np.diag(np.linalg.inv(gp))
    except np.linalg.LinAlgError:
        unc = np.full(k - 1, np.inf)
    gc = gp - np.outer(s, s) / n
    d = np.sqrt(np.diag(gc))
    try:
        corr = gc / np.outer(d, d)
        cen = np.diag(np.linalg.inv(corr))
    except (np.linalg.LinAlgError, FloatingPointError):
        cen = np.full(k - 1, np.inf)
    rows = [(fit.terms[j + 1], float(unc[j]), float(cen[j]), bool(unc[j] >= 10)) for j in range(k - 1)]
    return _spark(fit).createDataFrame(rows, schema)


def ols_predict(fit: OLSFit, df: DataFrame, target: str, predictors: list[str]) -> DataFrame:
    """ST18: every complete row with its fitted value and residual."""
    x, _ = _design(df, target, predictors)
    if not fit.reliable:
        return x.select(F.col("_y").alias(target), F.lit(None).cast("double").alias("fitted"),
                        F.lit(None).cast("double").alias("residual"))
    f = _fitted(fit)
    return x.select(F.col("_y").alias(target), f.alias("fitted"), (F.col("_y") - f).alias("residual"))


def ols_regression(df: DataFrame, target: str, predictors: list[str], alpha: float = 0.05) -> dict:
    """Task form: every table of the regression result."""
    fit = ols_fit(df, target, predictors, alpha)
    return {"coefficients": ols_coefficients(fit), "fit": ols_fit_metrics(fit),
            "diagnostics": ols_diagnostics(fit), "vif": ols_vif(fit)}


def ols_by_segment(df: DataFrame, target: str, predictors: list[str], by: list[str]) -> DataFrame:
    """OLS slopes for every segment in one job: per-segment means, then
    mean-centred cross-product sums (one groupBy), solved per segment in
    ``applyInPandas`` over one row per segment. Numeric predictors only."""
    require_columns(df, target, *predictors, *by)
    cols = [target, *predictors]
    base = df.select(*by, *[numeric_col(df, c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    for i in range(len(cols)):
        base = base.where(F.col(f"_v{i}").isNotNull())
    for b in by:
        base = base.where(F.col(b).isNotNull())
    means = base.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"),
                                  *[F.avg(f"_v{i}").alias(f"_m{i}") for i in range(len(cols))])
    c = base.join(means, by)
    d = [F.col(f"_v{i}") - F.col(f"_m{i}") for i in range(len(cols))]
    sums = c.groupBy(*by, "_n", *[f"_m{i}" for i in range(len(cols))]).agg(*[
        F.sum(d[i] * d[j]).alias(f"_s{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))])
    p = len(predictors)
    by_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema.fields if f.name in by)
    out_schema = by_schema + ", n long, term string, coefficient double, r_squared double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in pdf.iterrows():
            s = np.zeros((p + 1, p + 1))
            for i in range(p + 1):
                for j in range(i, p + 1):
                    s[i, j] = s[j, i] = r[f"_s{i}_{j}"]
            sxx, sxy, syy = s[1:, 1:], s[1:, 0], s[0, 0]
            key = {b: r[b] for b in by}
            try:
                beta = np.linalg.solve(sxx, sxy)
            except np.linalg.LinAlgError:
                rows.append({**key, "n": int(r["_n"]), "term": "const", "coefficient": np.nan, "r_squared": np.nan})
                continue
            b0 = r["_m0"] - sum(beta[i] * r[f"_m{i + 1}"] for i in range(p))
            r2 = float(beta @ sxy / syy) if syy > 0 else np.nan
            rows.append({**key, "n": int(r["_n"]), "term": "const", "coefficient": float(b0), "r_squared": r2})
            for i in range(p):
                rows.append({**key, "n": int(r["_n"]), "term": predictors[i], "coefficient": float(beta[i]),
                             "r_squared": r2})
        return pd.DataFrame(rows, columns=[*by, "n", "term", "coefficient", "r_squared"])

    return sums.groupBy(*by).applyInPandas(solve, out_schema)


#: Rows of a task that are centred at a time.
CENTRED_ROWS = 1 << 18


def _centred(values: list[str]):
    """Per chunk of a task's rows: (level, n, means) of its levels, and the
    triangle of the rows less their level's mean in the chunk, one per task
    (rows without n)."""
    width = len(values)

    def run(batches):
        names = ["_level", "_n", *[f"_m{c}" for c in values]]
        acc, held, size = np.zeros((0, width)), [], 0

        def reduce():
            t = pa.Table.from_batches(held).combine_chunks()
            codes = t["_level"].combine_chunks().dictionary_encode()
            at, levels = codes.indices.to_numpy().astype(np.int64), codes.dictionary
            x = np.column_stack([t[c].to_numpy() for c in values])
            n = np.bincount(at, minlength=len(levels))
            # sums about each level's first value, so that large values lose no digits
            first = np.empty(len(levels), np.int64)
            first[at[::-1]] = np.arange(len(at))[::-1]
            base = x[first]
            rest = x - base[at]
            mean = np.column_stack([np.bincount(at, rest[:, j], len(levels)) for j in range(width)]) / n[:, None]
            r = _r_of(np.vstack([acc, rest - mean[at]]), width)
            return r, pa.record_batch([levels.cast(pa.string()), pa.array(n), *[pa.array(c) for c in (base + mean).T]], names=names)

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= CENTRED_ROWS:
                acc, part = reduce()
                held, size = [], 0
                yield part
        if held:
            acc, part = reduce()
            yield part
        if acc.shape[0]:
            yield pa.record_batch([pa.nulls(len(acc), pa.string()), pa.nulls(len(acc), pa.int64()), *[pa.array(c) for c in acc.T]], names=names)
    return run


@dataclass
class AbsorbedFit:
    terms: list[str]
    n: int
    levels: int
    rank: int
    beta: np.ndarray | None
    cov: np.ndarray | None
    rss: float
    tss: float
    alpha: float
    means: DataFrame


def ols_absorbed(df: DataFrame, target: str, predictors: list[str], absorb: str, alpha: float = 0.05) -> AbsorbedFit:
    """ST10 with one predictor of any number of levels: its dummies are not
    built but partialled out, by subtracting each level's means from the
    target and the other predictors (Frisch-Waugh-Lovell) before the TSQR;
    the slopes, their errors and the residuals are those of the fit with all
    dummies. ``absorbed_effects`` solves for the levels.

    The rows are read once: each task centres its rows by chunk and level
    and keeps their triangle and the levels' means in the chunk. What a
    level's chunk means differ from its mean, times the root of their rows,
    completes the triangle, an identity. Complete cases only; a level of one
    row adds a degree of freedom and nothing else. Slopes that do not vary
    within levels are not estimable: not reliable."""
    require_columns(df, absorb)
    rows, terms = _design(df.withColumn("_level", F.col(absorb).cast("string")).where(F.col("_level").isNotNull()), target, predictors, keep=["_level"])
    terms, k = terms[1:], len(terms) - 1
    values = [*[f"_x{j + 1}" for j in range(k)], "_y"]
    local = [f"_m{c}" for c in values]
    chunks = cut_lineage(rows.select("_level", *values).mapInArrow(_centred(values), ", ".join(["_level string, _n long", *[f"{m} double" for m in local]])))
    parts, triangles = chunks.where("_n IS NOT NULL"), chunks.where("_n IS NULL")
    means = cut_lineage(parts.groupBy("_level").agg(F.sum("_n").alias("_n"), *[(F.sum(F.col(m) * F.col("_n")) / F.sum("_n")).alias(m) for m in local]))
    whole = means.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("levels"), *[(F.sum(F.col(m) * F.col("_n")) / F.sum("_n")).alias(m) for m in local]).first()
    n, levels = int(whole["n"] or 0), int(whole["levels"])
    between = means.agg(*[F.sum(F.col("_n") * (F.col(m) - F.lit(whole[m])) ** 2).alias(m) for m in local]).first()
    several = parts.join(means.select(F.col("_level"), F.col("_n").alias("_all"), *[F.col(m).alias(f"{m}_all") for m in local]), "_level").where("_n < _all")
    moved = several.select(*[(F.sqrt("_n") * (F.col(m) - F.col(f"{m}_all"))).alias(m) for m in local])
    r = _tsqr(triangles.select(*local).unionByName(moved), k + 1)
    r = np.vstack([r, np.zeros((max(0, k + 1 - r.shape[0]), k + 1))])
    rxx, rxy = r[:k, :k], r[:k, k]
    total = [float((r[:, j] ** 2).sum()) + float(between[m] or 0.0) for j, m in enumerate(local)]       # within levels and between
    sv = np.linalg.svd(rxx, compute_uv=False) if k else np.zeros(0)
    scale = max([math.sqrt(v / max(n, 1)) for v in total[:-1]], default=0.0)
    tol = scale * math.sqrt(max(n, 1)) * max(n, k) * np.finfo(float).eps
    rank, tss = int((sv > tol).sum()), total[-1]
    dof = n - levels - k
    if rank < k or dof <= 0:
        return AbsorbedFit(terms, n, levels, rank, None, None, math.nan, tss, alpha, means)
    rinv = np.linalg.inv(rxx) if k else np.zeros((0, 0))
    rss = float(r[k, k]) ** 2
    return AbsorbedFit(terms, n, levels, rank, rinv @ rxy, rss / dof * (rinv @ rinv.T), rss, tss, alpha, means)


def absorbed_coefficients(fit: AbsorbedFit) -> DataFrame:
    """term, coefficient, std_error, t_stat, p_value, lower_bound,
    upper_bound of the slopes (empty if the fit is not reliable)."""
    schema = "term string, coefficient double, std_error double, t_stat double, p_value double, lower_bound double, upper_bound double"
    spark = fit.means.sparkSession
    if fit.beta is None:
        return spark.createDataFrame([], schema)
    dof = fit.n - fit.levels - len(fit.terms)
    crit, out = t_ppf(1 - fit.alpha / 2, dof), []
    for j, term in enumerate(fit.terms):
        b, se = float(fit.beta[j]), math.sqrt(max(fit.cov[j, j], 0.0))
        t = b / se if se > 0 else math.nan
        out.append((term, b, se, t, t_pvalue(t, dof) if se > 0 else math.nan, b - crit * se, b + crit * se))
    return spark.createDataFrame(out, schema)


def absorbed_effects(fit: AbsorbedFit) -> DataFrame:
    """(level, n, effect): each level's intercept, its mean target less the
    slopes times its mean predictors; one row per level, computed where the
    means lie."""
    if fit.beta is None:
        return fit.means.select(F.col("_level").alias("level"), F.col("_n").alias("n"), F.lit(None).cast("double").alias("effect"))
    e = F.col("_m_y")
    for j, b in enumerate(fit.beta):
        e = e - F.lit(float(b)) * F.col(f"_m_x{j + 1}")
    return fit.means.select(F.col("_level").alias("level"), F.col("_n").alias("n"), e.alias("effect"))
