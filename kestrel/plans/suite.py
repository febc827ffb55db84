"""TR1 task-suite runner and TR2 driver suite.

A task list (``{"id", "type", "params"}``) becomes ONE long result table
``(task_id, type, key, metric, value, status, reason)``: every task's
DataFrame is unpivoted (text and date columns form the key, numeric
columns become metric/value rows) and the results are unioned. A task that
cannot be planned or fails while it runs yields a ``failed`` row, one without
usable rows a ``skipped`` row, and the others go on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.columns import agg_column, numeric_col, require_columns, timestamp_col
from kestrel.functions.periods import norm_freq, period_start
from kestrel.operators import aggregate as A
from kestrel.operators import cohort as C
from kestrel.operators import kpi as K
from kestrel.operators import ranking as RK
from kestrel.operators import timeseries as TS
from kestrel.session import cut_lineage

# The parameter names accepted per task type, the first one
# given counts.
_GROUP = ("group_by", "groupby", "group", "dimension", "by", "column", "col")
_METRIC = ("metric", "value", "measure", "target", "y", "metric_col")
_AGG = ("agg", "aggregation", "op")
_LIMIT = ("limit", "top_k", "topk", "k")
_DATE = ("date_col", "date", "time_col", "timestamp_col", "x")
_FREQ = ("freq", "granularity", "period")
_ALPHA = ("alpha", "significance_level")
PARAMETERS = {
    "groupby_agg": {"group_by": _GROUP, "metric": (*_METRIC, "sum_col"), "agg": _AGG, "limit": _LIMIT},
    "groupby2_agg": {"group_by_1": ("group_by_1", "group1", "group_by", "groupby_1", "dim1", "dimension1"),
                     "group_by_2": ("group_by_2", "group2", "groupby_2", "dim2", "dimension2"),
                     "metric": _METRIC, "agg": _AGG, "limit": _LIMIT},
    "topk": {"by": ("by", *_GROUP), "metric": _METRIC, "agg": _AGG, "k": ("k", "top_k", "topk", "limit")},
    "segment_analysis": {"segment_by": ("segment_by", *_GROUP), "metric": ("metric", "metric_col", "value", "measure"),
                         "agg": _AGG, "limit": _LIMIT},
    "distribution": {"column": ("column", "metric", "col", "feature", "x")},
    "group_distribution": {"group_by": _GROUP, "metric": _METRIC, "agg": _AGG},
    "correlation": {"x": ("x", "col1", "a", "feature_x", "feature1"),
                    "y": ("y", "col2", "b", "feature_y", "feature2")},
    "recency_by_group": {"group_by": _GROUP, "date_col": _DATE},
    "timeseries_agg": {"date_col": _DATE, "metric": _METRIC, "freq": _FREQ, "agg": _AGG},
    "filter_agg": {"filter_col": ("filter_col", "where_col", "column", "field", "by", "dim", "dimension", "group_by",
                                  "groupby", "group"),
                   "filter_val": ("filter_val", "where_val", "value", "equals", "match", "val", "target_value"),
                   "metric": ("metric", "measure", "target", "metric_col", "value_col", "y", "value_metric"),
                   "agg": _AGG},
    "sql_query": {"query": ("query", "sql", "statement"), "limit": ("limit", "max_rows", "top_k", "k"),
                  "output": ("output", "format", "mode")},
    "sql_join_profile": {"fact_table": ("fact_table", "from_table", "base_table"),
                         "dimension_table": ("dimension_table", "to_table", "join_table")},
    "kpi_template_apply": {"domain": ("domain", "template", "kpi_domain"),
                           "segment_by": ("segment_by", "group_by", "dimension", "by")},
    "metric_definition": {"name": ("name", "metric_name", "id"),
                          "metric_col": ("metric_col", "metric", "value_col", "column"),
                          "expression": ("expression", "expr", "formula"),
                          "group_by": ("group_by", "segment_by", "dimension", "by"), "agg": _AGG},
    "cohort_analysis": {"entity_col": ("entity_col", "entity", "id_col", "customer_col"), "date_col": _DATE,
                        "freq": _FREQ},
    "statistical_test": {"group_col": ("group_col", "group_by", "group", "segment_by", "by", "dimension"),
                         "metric": ("metric", "value", "measure", "target", "column"),
                         "group_a": ("group_a", "label_a", "segment_a", "control", "treatment"),
                         "group_b": ("group_b", "label_b", "segment_b"),
                         "pair_id_col": ("pair_id_col", "pair_col", "entity_col", "id_col"), "alpha": _ALPHA},
    "ab_test": {"group_col": ("group_col", "variant_col", "group_by", "group"),
                "control": ("control", "group_b", "label_b"), "treatment": ("treatment", "group_a", "label_a"),
                "metric": ("metric", "value", "measure", "target", "column"),
                "metric_type": ("metric_type", "outcome_type"), "alpha": _ALPHA},
    "ols_regression": {"target": ("target", "metric", "dependent_var", "y"),
                       "predictors": ("predictors", "features", "x"), "alpha": _ALPHA},
    "focus_rank": {"group_by": _GROUP, "metric": _METRIC, "agg": _AGG},
}


def named(ttype: str, params: dict, columns=()) -> dict:
    """A task's parameters under their first names. The condition of a
    filter may also be {"where": {column: value}}, {"filter": {column:
    value}} or a parameter named like a column; predictors may be one text
    with commas."""
    accepted = PARAMETERS.get(ttype, {})
    if ttype == "filter_agg":
        known = {a for names in accepted.values() for a in names}
        conditions = [d for d in (params.get("where"), params.get("filter")) if isinstance(d, dict) and len(d) == 1]
        conditions += [{c: params[c]} for c in columns if c in params and c not in known]
        for column, value in (item for d in conditions[:1] for item in d.items()):
            params = {"filter_col": column, "filter_val": value} | params
    found = {name: next((params[a] for a in names if params.get(a) not in (None, "")), None)
             for name, names in accepted.items()}
    out = params | {name: value for name, value in found.items() if value is not None}
    if isinstance(out.get("predictors"), str):
        out["predictors"] = [x.strip() for x in out["predictors"].split(",") if x.strip()]
    return out


def _limit(p: dict) -> int | None:
    """The limit a task asks for; without one every row is kept."""
    return int(p["limit"]) if p.get("limit") else None


def _run_one(df: DataFrame, ttype: str, p: dict, context: dict | None = None) -> list[DataFrame]:
    """The result tables of a task with ``named`` parameters."""
    if ttype == "kpi_template_apply":
        by = p.get("segment_by")
        if not by or isinstance(by, (list, tuple)):
            return [K.kpi_template_apply(df, p["domain"], by)]
        return [K.kpi_template_apply(df, p["domain"]), K.kpi_segment_sample(df, p["domain"], by)]
    return [_run_table(df, ttype, p, context or {})]


def _run_table(df: DataFrame, ttype: str, p: dict, context: dict) -> DataFrame:
    if ttype == "statistical_test":
        from kestrel.operators.stats.dispatch import statistical_test
        return statistical_test(df, p["group_col"], p["metric"], p.get("group_a"), p.get("group_b"),
                                bool(p.get("compare_to_rest", False)), bool(p.get("paired", False)),
                                p.get("pair_id_col"), p.get("success_value", 1), float(p.get("alpha", 0.05)),
                                p.get("alternative", "two-sided"), rank_below=p.get("rank_below"))
    if ttype == "ab_test":
        from kestrel.operators.stats.dispatch import ab_test
        return ab_test(df, p["group_col"], p["control"], p["treatment"], p["metric"], p.get("metric_type"),
                       p.get("success_value", 1), float(p.get("alpha", 0.05)))
    if ttype == "ols_regression":
        from kestrel.operators.stats import ols
        fit = ols.ols_fit(df, p["target"], list(p["predictors"]), float(p.get("alpha", 0.05)))
        m = ols.ols_fit_metrics(fit).select(F.lit("fit").alias("term"), "n", "r_squared", "adj_r_squared",
                                            "f_statistic", "f_p_value")
        c = ols.ols_coefficients(fit)
        return c.unionByName(m, allowMissingColumns=True)
    if ttype == "sql_query":
        from kestrel.sources.files import sql_query
        return sql_query(df.sparkSession, p["query"], _limit(p), p.get("output", "rows"))
    if ttype == "sql_join_profile":
        from kestrel.operators.star import join_profile
        return join_profile(context["tables"], context.get("relationships", []), p["fact_table"],
                            p.get("dimension_table"))
    agg = p.get("agg", "sum")
    if ttype == "groupby_agg":
        return A.groupby_agg(df, p["group_by"], p["metric"], agg, _limit(p))
    if ttype == "groupby2_agg":
        return A.groupby2_agg(df, p["group_by_1"], p["group_by_2"], p["metric"], agg, _limit(p))
    if ttype == "topk":
        return A.topk(df, p["by"], p["metric"], agg, int(p.get("k", 10)))
    if ttype == "filter_agg":
        return A.filter_agg(df, p["filter_col"], p["filter_val"], p["metric"], agg)
    if ttype == "segment_analysis":
        return A.segment_analysis(df, p["segment_by"], p["metric"], agg, _limit(p))
    if ttype == "distribution":
        return A.distribution(df, p["column"], p.get("quantiles", A.DEFAULT_QUANTILES))
    if ttype == "group_distribution":
        return A.group_distribution(df, p["group_by"], p["metric"], agg, p.get("quantiles", A.GROUP_QUANTILES))
    if ttype == "correlation":
        return A.correlation(df, p["x"], p["y"])
    if ttype == "recency_by_group":
        return A.recency_by_group(df, p["group_by"], p["date_col"])
    if ttype == "timeseries_agg":
        return TS.timeseries_agg(df, p["date_col"], p["metric"], str(p.get("freq", "M")), agg)
    if ttype == "cohort_analysis":
        return C.cohort_long(df, p["entity_col"], p["date_col"], str(p.get("freq", "M")))
    if ttype == "metric_definition":
        return K.metric_definition(df, p.get("name", "metric"), p.get("metric_col"), agg,
                                   p.get("group_by"), p.get("expression"))
    if ttype == "focus_rank":
        return RK.focus_rank(df, p["group_by"], p["metric"], p["focus"], agg)
    raise ValueError(f"unknown task type {ttype!r}")


def _long(res: DataFrame, tid: str, ttype: str) -> DataFrame:
    keys, nums = [], []
    for f in res.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            nums.append(f.name)
        elif not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            keys.append(F.coalesce(F.col(f.name).cast("string"), F.lit("")))
    key = F.concat_ws("|", *keys) if keys else F.lit("")
    stacked = F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
                                 for n in nums])) if nums else None
    out = res.select(key.alias("key"), *([stacked] if stacked is not None else
                                         [F.lit("").alias("metric"), F.lit(None).cast("double").alias("value")]))
    return out.select(F.lit(tid).alias("task_id"), F.lit(ttype).alias("type"), "key", "metric", "value",
                      F.lit("computed").alias("status"), F.lit(None).cast("string").alias("reason"))


FUSABLE = ("groupby_agg", "groupby2_agg", "topk", "segment_analysis", "group_distribution",
           "recency_by_group", "correlation", "timeseries_agg")


class _Fused:
    """Collects the grouping keys and aggregates of fusable tasks, then
    computes them all with one ``groupingSets`` aggregation."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.derived = {}      # derived key name -> Column
        self.keys = []         # all key column names, in order
        self.sets = []         # distinct key tuples
        self.aggs = []         # aggregate Columns (aliased)
        self.posts = []        # (tid, ttype, key tuple, fn(sub) -> DataFrame)

    def _key(self, name: str, col=None) -> str:
        if col is not None and name not in self.derived:
            self.derived[name] = col
        if name not in self.keys:
            self.keys.append(name)
        return name

    def _set(self, keys: tuple):
        if keys not in self.sets:
            self.sets.append(keys)
        return keys

    def add(self, tid: str, ttype: str, p: dict):
        df, n = self.df, len(self.aggs)
        alias = f"_a{n}"
        if ttype in ("groupby_agg", "groupby2_agg", "topk", "segment_analysis", "group_distribution"):
            if ttype == "groupby2_agg":
                ks = (p["group_by_1"], p["group_by_2"])
            else:
                ks = (p[{"topk": "by", "segment_analysis": "segment_by"}.get(ttype, "group_by")],)
            metric, agg = p["metric"], p.get("agg", "sum")
            require_columns(df, *ks, metric)
            x = numeric_col(df, metric) if agg not in ("count", "nunique") else F.col(metric)
            self.aggs.append(agg_column(agg, x).cast("double").alias(alias))
            key = self._set(tuple(self._key(k) for k in ks))
            self.posts.append((tid, ttype, key, lambda sub, p=p, ks=ks, metric=metric, agg=agg, ttype=ttype:
                               _post_grouped(sub.withColumnRenamed(alias, "value"), ttype, list(ks), p, metric, agg)))
        elif ttype == "recency_by_group":
            k, d = p["group_by"], p["date_col"]
            require_columns(df, k, d)
            self.aggs.append(F.max(timestamp_col(df, d)).alias(alias))
            key = self._set((self._key(k),))
            self.posts.append((tid, ttype, key, lambda sub, k=k: A.recency_from_grouped(
                sub.select(F.col(k).alias("_k"), F.col(alias).alias("last_date"))
                   .where(F.col("_k").isNotNull() & F.col("last_date").isNotNull()), k)))
        elif ttype == "correlation":
            pairs = [(p["x"], p["y"])]
            require_columns(df, p["x"], p["y"])
            self.aggs += A.correlation_pair_aggs(df, pairs, prefix=f"{alias}_")
            key = self._set(())
            self.posts.append((tid, ttype, key, lambda sub, pairs=pairs, pre=f"{alias}_":
                               A.correlation_from_row(sub, pairs, pre)))
        elif ttype == "timeseries_agg":
            d, metric = p["date_col"], p["metric"]
            f, agg = norm_freq(str(p.get("freq", "M"))), p.get("agg", "sum")
            require_columns(df, d, metric)
            pname = self._key(f"_per_{d}_{f}", period_start(timestamp_col(df, d), f))
            x = numeric_col(df, metric)
            self.aggs += [agg_column(agg, x).cast("double").alias(alias), F.count(x).alias(f"{alias}_n")]
            key = self._set((pname,))
            self.posts.append((tid, ttype, key, lambda sub, pname=pname, f=f, agg=agg: TS.timeseries_from_grouped(
                sub.where(F.col(pname).isNotNull() & (F.col(f"{alias}_n") > 0))
                   .select(F.col(pname).alias("_p"), F.col(alias).alias("value")), f, agg)))
        else:
            raise ValueError(f"task type {ttype!r} is not fusable")

    def results(self) -> list:
        if not self.posts:
            return []
        base = self.df
        for name, col in self.derived.items():
            base = base.withColumn(name, col)
        keys = self.keys
        grouped = base.groupingSets([[F.col(k) for k in ks] for ks in self.sets], *[F.col(k) for k in keys]) \
            .agg(*self.aggs, F.grouping_id().alias("_gid"))
        # The grouped result (one row per group of every set) is written
        # once; every task's post-processing reads it, not the source.
        grouped = cut_lineage(grouped)
        out = []
        for tid, ttype, ks, post in self.posts:
            gid = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in ks)
            sub = grouped.where(F.col("_gid") == gid)
            out.append((tid, ttype, post(sub)))
        return out


def _post_grouped(sub: DataFrame, ttype: str, ks: list[str], p: dict, metric: str, agg: str) -> DataFrame:
    g = sub.select(*ks, "value")
    for k in ks:
        g = g.where(F.col(k).isNotNull())
    if ttype in ("groupby_agg", "groupby2_agg"):
        return A._ordered(g, ks, _limit(p))
    if ttype == "topk":
        return g.orderBy(F.col("value").desc_nulls_last(), F.col(ks[0]).asc()).limit(max(int(p.get("k", 10)), 0))
    if ttype == "segment_analysis":
        return A.segment_from_grouped(g, ks[0], _limit(p))
    return A.group_distribution_from_grouped(g, ks[0], metric, agg, p.get("quantiles", A.GROUP_QUANTILES))


def run_suite(df: DataFrame, tasks: list[dict], fuse: bool = True, tables: dict | None = None,
              relationships=()) -> DataFrame:
    """TR1: run a task list as one long result table.

    With ``fuse`` the grouped tasks (group-bys, top-k, segment shares,
    spreads of group totals, recency, correlations, time series) share ONE
    scan: a GROUPING SETS aggregation computes every task's aggregate for
    its key set, partial-aggregated before the single shuffle; duplicate
    tasks are dropped, as the reference does.

    Every task's result is written to the checkpoint folder as it is
    computed, so a task that fails while it runs (a division by zero in a
    query, a text that is no number) is one ``failed`` row as well; if the
    shared scan fails, its tasks are run one by one."""
    spark = df.sparkSession
    context = {"tables": tables or {}, "relationships": relationships}
    parts, failures, seen, shared, planned = [], [], set(), [], []
    fused = _Fused(df)

    def alone(tid, ttype, p):
        try:
            parts.extend([cut_lineage(_long(r, tid, ttype)) for r in _run_one(df, ttype, p, context)])
        except Exception as e:  # noqa: BLE001 - recorded per task, the suite goes on
            failures.append((tid, ttype, "", "", None, "failed", f"{type(e).__name__}: {e}"))

    for i, t in enumerate(tasks, start=1):
        tid = str(t.get("id") or f"T{i}")
        ttype = str(t.get("type", ""))
        params = named(ttype, dict(t.get("params") or {}), df.columns)
        sig = (ttype, repr(sorted(params.items())))
        if sig in seen:
            continue
        seen.add(sig)
        planned.append((tid, ttype))
        if not (fuse and ttype in FUSABLE):
            alone(tid, ttype, params)
            continue
        try:
            fused.add(tid, ttype, params)
            shared.append((tid, ttype, params))
        except Exception as e:  # noqa: BLE001 - recorded per task, the suite goes on
            failures.append((tid, ttype, "", "", None, "failed", f"{type(e).__name__}: {e}"))
    try:
        rows = [_long(res, tid, ttype) for tid, ttype, res in fused.results()]
        if rows:
            parts.append(cut_lineage(reduce(DataFrame.unionByName, rows)))
    except Exception:  # noqa: BLE001 - each task then tells its own reason
        for task in shared:
            alone(*task)
    schema = ("task_id string, type string, key string, metric string, value double, status string, "
              "reason string")
    failed = spark.createDataFrame(failures, schema)
    if not parts:
        return failed
    out = reduce(DataFrame.unionByName, parts)
    # a task without one value (no usable rows) is skipped; both sides are small written tables
    valued = out.where(F.col("value").isNotNull() | (F.col("metric") == "")).select("task_id").distinct()
    lost = {f[0] for f in failures}
    empty = spark.createDataFrame([(tid, ttype, "", "", None, "skipped", "no usable rows") for tid, ttype in planned
                                   if tid not in lost], schema).join(valued, "task_id", "left_anti")
    return out.join(valued, "task_id", "left_semi").unionByName(empty).unionByName(failed)


def driver_suite_tasks(metric: str, dim: str, dim2: str, drivers: list[str], date_col: str) -> list[dict]:
    """TR2: the follow-up analyses for a metric - volume and mean by the
    main dimension, the two-way mix, each driver's correlation, the monthly
    trend, segment shares, the spread of group totals and group recency."""
    tasks = [
        {"id": "D1", "type": "groupby_agg", "params": {"group_by": dim, "metric": metric, "agg": "count", "limit": 0}},
        {"id": "D2", "type": "groupby_agg", "params": {"group_by": dim, "metric": metric, "agg": "mean", "limit": 0}},
        {"id": "D3", "type": "groupby2_agg",
         "params": {"group_by_1": dim, "group_by_2": dim2, "metric": metric, "agg": "mean", "limit": 0}},
        {"id": "D4", "type": "groupby2_agg",
         "params": {"group_by_1": dim, "group_by_2": dim2, "metric": metric, "agg": "count", "limit": 0}},
    ]
    for j, d in enumerate(drivers, start=5):
        tasks.append({"id": f"D{j}", "type": "correlation", "params": {"x": d, "y": metric}})
    n = 5 + len(drivers)
    tasks += [
        {"id": f"D{n}", "type": "timeseries_agg", "params": {"date_col": date_col, "metric": metric, "freq": "M"}},
        {"id": f"D{n + 1}", "type": "segment_analysis",
         "params": {"segment_by": dim, "metric": metric, "agg": "mean", "limit": 0}},
        {"id": f"D{n + 2}", "type": "group_distribution", "params": {"group_by": dim, "metric": metric}},
        {"id": f"D{n + 3}", "type": "recency_by_group", "params": {"group_by": dim, "date_col": date_col}},
    ]
    return tasks


def driver_suite(df: DataFrame, metric: str, dim: str, dim2: str, drivers: list[str], date_col: str) -> DataFrame:
    return run_suite(df, driver_suite_tasks(metric, dim, dim2, drivers, date_col))
