"""ST2 method selection, ST3 dispatcher, ST9 A/B readout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.columns import numeric_col, require_columns
from kestrel.operators.stats import effects as E
from kestrel.operators.stats import tests as HT
from kestrel.operators.stats.normality import shapiro_normality

# Metric names that mark a binary outcome.
BINARY_TOKENS = ("converted", "conversion", "is_conversion", "converted_flag", "clicked", "purchased",
                 "is_purchase")

COMMON = ["method", "group_a", "group_b", "n_a", "n_b", "statistic", "p_value", "ci_lower", "ci_upper",
          "effect_size", "effect_name", "reliable", "decision"]


def select_method(df: DataFrame, group_col: str, metric: str, group_a=None, group_b=None,
                  compare_to_rest: bool = False, paired: bool = False, success_value=1,
                  alpha: float = 0.05, rank_below: int | None = None) -> DataFrame:
    """ST2 as one aggregation. One row (method, reason). Independent numeric
    groups get the Welch test at every size. ``rank_below`` asks for the
    reference's small-sample rule (its bound is 20): Mann-Whitney where a
    group has fewer values and one fails Shapiro-Wilk."""
    require_columns(df, group_col, metric)
    spark = df.sparkSession
    if paired:
        return spark.createDataFrame([("paired_t_test", "pairing requested")], "method string, reason string")
    ok = HT._binary_ok(df, metric, success_value)
    dt = df.schema[metric].dataType
    num = numeric_col(df, metric) if isinstance(dt, (T.NumericType, T.StringType, T.BooleanType)) else F.lit(None)
    row = df.agg(F.count(F.col(metric)).alias("nn"), F.count_if(F.col(metric).isNotNull() & ~ok).alias("nonbin"),
                 F.count(num).alias("numeric")).collect()[0]
    if row["nn"] > 0 and (row["nonbin"] == 0 or metric.lower() in BINARY_TOKENS):
        return spark.createDataFrame([("two_proportion_z_test", "binary metric")], "method string, reason string")
    if row["numeric"] >= max(3, int(row["nn"] * 0.6)):
        if rank_below is not None:
            a, b = HT.resolve_labels(df, group_col, group_a, group_b, compare_to_rest)
            norm = shapiro_normality(HT._tagged(df, group_col, a, b, []), metric, by=["_g"], alpha=alpha).collect()
            few = len(norm) < 2 or min(r["n"] for r in norm) < rank_below
            if few and any(r["passed"] is False for r in norm):
                return spark.createDataFrame([("mann_whitney_u", "small sample with weak normality")],
                                             "method string, reason string")
        return spark.createDataFrame([("welch_t_test", "independent numeric groups")], "method string, reason string")
    return spark.createDataFrame([("chi_square_independence", "categorical metric")], "method string, reason string")


def _common(r: DataFrame, method: str) -> DataFrame:
    eff = {"welch_t_test": ("cohens_d", "cohens_d"), "mann_whitney_u": ("cohens_d", "cohens_d"),
           "paired_t_test": ("cohens_d", "cohens_d"), "two_proportion_z_test": ("relative_lift", "relative_lift"),
           "chi_square_independence": ("cramers_v", "cramers_v")}[method]
    cols = {c: (F.col(c) if c in r.columns else F.lit(None)) for c in COMMON}
    cols["effect_size"] = F.col(eff[0])
    cols["effect_name"] = F.lit(eff[1])
    if method == "paired_t_test":
        cols["n_a"] = F.col("n_pairs")
        cols["n_b"] = F.col("n_pairs")
    if method == "chi_square_independence":
        cols["n_a"] = F.col("n")
        cols["n_b"] = F.lit(None)
    if method == "mann_whitney_u":
        cols["statistic"] = F.col("u_statistic")
    types = {"method": "string", "group_a": "string", "group_b": "string", "n_a": "long", "n_b": "long",
             "reliable": "boolean", "decision": "string", "effect_name": "string"}
    return r.select(*[cols[c].cast(types.get(c, "double")).alias(c) for c in COMMON])


def statistical_test(df: DataFrame, group_col: str, metric: str, group_a=None, group_b=None,
                     compare_to_rest: bool = False, paired: bool = False, pair_id_col: str | None = None,
                     success_value=1, alpha: float = 0.05, alternative: str = "two-sided",
                     method: str | None = None, rank_below: int | None = None) -> DataFrame:
    """ST3: run the selected (or given) test; common result columns."""
    m = method or select_method(df, group_col, metric, group_a, group_b, compare_to_rest, paired,
                                success_value, alpha, rank_below).collect()[0]["method"]
    if m == "paired_t_test":
        if not pair_id_col:
            raise ValueError("paired test needs pair_id_col")
        r = HT.paired_t_test(df, group_col, metric, pair_id_col, group_a, group_b, alpha, alternative)
    elif m == "two_proportion_z_test":
        r = HT.two_proportion_z_test(df, group_col, metric, group_a, group_b, compare_to_rest, success_value, alpha)
    elif m == "mann_whitney_u":
        r = HT.mann_whitney_u(df, group_col, metric, group_a, group_b, compare_to_rest, alpha, alternative)
    elif m == "welch_t_test":
        r = HT.welch_t_test(df, group_col, metric, group_a, group_b, compare_to_rest, alpha, alternative)
    else:
        r = HT.chi_square_independence(df, group_col, metric, alpha)
    return _common(r, m)


def ab_test(df: DataFrame, group_col: str, control, treatment, metric: str, metric_type: str | None = None,
            success_value=1, alpha: float = 0.05) -> DataFrame:
    """ST9: treatment (a) vs control (b) with the selected test, plus
    means, absolute difference, lift, percent change, imbalance ratio and
    power/balance warnings. ``metric_type`` ('binary' / 'continuous')
    overrides the automatic choice."""
    forced = {"binary": "two_proportion_z_test", "continuous": "welch_t_test"}.get((metric_type or "").lower())
    res = statistical_test(df, group_col, metric, treatment, control, success_value=success_value, alpha=alpha,
                           method=forced)
    base = HT._tagged(df, group_col, str(treatment), str(control), []).where(F.col(metric).isNotNull())
    x = numeric_col(df, metric).cast("double")
    s = base.agg(F.count_if(F.col("_g") == "a").alias("n_treatment"), F.count_if(F.col("_g") == "b").alias("n_control"),
                 F.avg(F.when(F.col("_g") == "a", x)).alias("treatment_mean"),
                 F.avg(F.when(F.col("_g") == "b", x)).alias("control_mean"))
    tm, cm = F.col("treatment_mean"), F.col("control_mean")
    lift = E.relative_lift(tm, cm)
    mn = F.least("n_treatment", "n_control")
    binary = F.col("method") == "two_proportion_z_test"
    llo, lhi = E.relative_lift_ci(F.col("ci_lower"), F.col("ci_upper"), cm)
    out = res.crossJoin(s).select(
        *COMMON, "treatment_mean", "control_mean", (tm - cm).alias("absolute_difference"), lift.alias("relative_lift"),
        llo.alias("lift_ci_lower"), lhi.alias("lift_ci_upper"), (lift * 100.0).alias("percent_change"),
        F.when(mn > 0, F.greatest("n_treatment", "n_control") / mn).alias("imbalance_ratio"),
        F.when(binary, mn < 100).otherwise(mn < 30).alias("underpowered"))
    return out.withColumn("imbalanced", F.coalesce(F.col("imbalance_ratio") > 3.0, F.lit(False)))
