"""Q1-Q5 data-quality checks and CL1 deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.columns import require_columns
from kestrel.session import cut_lineage

# Default warning thresholds of the quality report.
MISSINGNESS_WARN = 0.2
DUPLICATE_WARN = 0.01
OUTLIER_Z = 4.0
OUTLIER_FRAC_WARN = 0.01
MIN_OUTLIER_VALUES = 20

_SCHEMA = "check string, column string, value double, threshold double, warn boolean, detail string"


def _is_missing(df, c):
    dt = df.schema[c].dataType
    m = F.col(c).isNull()
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        m = m | F.isnan(c)
    return m


def missingness(df: DataFrame, threshold: float = MISSINGNESS_WARN) -> DataFrame:
    """Q1: share of missing values per column (0.0 on an empty table), all
    columns in one aggregation. Rows (column, missing_frac, warn)."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(_is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"),
                 F.coalesce(F.try_divide(F.col(f"m{i}"), F.col("_n")), F.lit(0.0)).cast("double")
                 .alias("missing_frac")) for i, c in enumerate(cols)]))) \
        .withColumn("warn", F.col("missing_frac") >= threshold)


def _digest(df: DataFrame, keys: list[str]) -> list:
    """Two 64-bit hashes of a row's values: equal for rows that a group-by
    holds equal (NULL = NULL, NaN = NaN, -0.0 = 0.0)."""
    cells = []
    for c in keys:
        v = df[c]
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            v = F.when(v == 0, F.lit(0.0)).otherwise(v)
        cells += [v.isNull(), v]                     # a hash skips nulls, so their places go in
    return [F.xxhash64(*cells), F.xxhash64(F.lit(1), *cells)]


def _flat(df: DataFrame, keys: list[str]) -> bool:
    return not any(isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) for c in keys)


def _marked(df: DataFrame, keys: list[str], digest) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their digests, digests counted, digests met twice)."""
    p = "_h"
    while any(c.lower().startswith(p) for c in df.columns):
        p = "_" + p
    one, two = digest(df, keys)
    rows = df.select("*", one.alias(f"{p}1"), two.alias(f"{p}2"))
    count = rows.groupBy(f"{p}1", f"{p}2").agg(F.count(F.lit(1)).alias("n"))
    again = cut_lineage(count.where("n > 1").select(F.col(f"{p}1").alias(f"{p}3"), F.col(f"{p}2").alias(f"{p}4")))
    return rows, count, again


def _same(rows: DataFrame, again: DataFrame):
    (a, b), (c, d) = rows.columns[-2:], again.columns
    return (F.col(a) == F.col(c)) & (F.col(b) == F.col(d))


def duplicate_rate(df: DataFrame, subset: list[str] | None = None, digest=_digest) -> DataFrame:
    """Q2: share of rows equal (NULL = NULL) to an earlier row, on all
    columns or on a key subset. One row (n_rows, n_distinct, duplicate_rate).

    Rows are counted by a 128-bit digest, so a unique row shuffles 24 bytes
    whatever its width; only rows whose digest is met again are compared in
    full, which makes the count exact whatever collides. Nested columns have
    no digest and are grouped in full."""
    keys = subset or df.columns
    require_columns(df, *keys)
    n_distinct = F.count(F.lit(1)).alias("n_distinct")
    if _flat(df, keys):
        rows, count, again = _marked(df, keys, digest)
        once = count.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"), F.count_if(F.col("n") == 1).alias("n_once"))
        more = rows.join(again, _same(rows, again), "left_semi").select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)])
        more = more.groupBy(*more.columns).agg(F.lit(1)).agg(F.count(F.lit(1)).alias("n_more"))
        total = once.crossJoin(more).select("n_rows", (F.col("n_once") + F.col("n_more")).alias("n_distinct"))     # one row each
    else:
        per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
        total = per.agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("n_rows"), n_distinct)
    return total.select(
        "n_rows", "n_distinct",
        F.when(F.col("n_rows") > 0, 1 - F.col("n_distinct") / F.col("n_rows")).otherwise(F.lit(0.0))
        .alias("duplicate_rate"))


def numeric_measure_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def zscore_outliers(df: DataFrame, z_thresh: float = OUTLIER_Z, columns: list[str] | None = None,
                    min_values: int = MIN_OUTLIER_VALUES) -> DataFrame:
    """Q3: per numeric column with >= ``min_values`` values and a non-zero
    population std: count of |z| >= z_thresh.

    Two passes: moments of all columns in one aggregation (one row), then
    one conditional count per column against that row (broadcast of one
    row). Rows (column, n_values, mean, std, n_outliers, outlier_frac_of_nonnull).
    """
    cols = columns or numeric_measure_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, n_values bigint, mean double, std double, n_outliers bigint, "
                "outlier_frac_of_nonnull double")
    x = {c: F.col(c).cast("double") for c in cols}
    mom = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.count(x[c]).alias(f"n{i}"), F.avg(x[c]).alias(f"mu{i}"), F.stddev_pop(x[c]).alias(f"sd{i}"))])
    j = df.select(*cols).crossJoin(F.broadcast(mom))
    cnt = j.agg(*[F.max(f"{p}{i}").alias(f"{p}{i}") for i in range(len(cols)) for p in ("n", "mu", "sd")],
                *[F.count_if(F.abs((x[c] - F.col(f"mu{i}")) / F.col(f"sd{i}")) >= z_thresh).alias(f"o{i}")
                  for i, c in enumerate(cols)])
    long = cnt.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_values"), F.col(f"mu{i}").alias("mean"),
                 F.col(f"sd{i}").alias("std"), F.col(f"o{i}").alias("n_outliers")) for i, c in enumerate(cols)])))
    long = long.where((F.col("n_values") >= min_values) & F.col("std").isNotNull() & (F.col("std") != 0))
    return long.withColumn("outlier_frac_of_nonnull",
                           F.col("n_outliers") / F.greatest(F.col("n_values"), F.lit(1)))


def range_rules(df: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """Q4: declarative range rules (column, min, max). The default rule is
    the reference's: any numeric column whose lower-case name contains
    'age' must not be negative. Rows (column, min, max, n_violations, warn)."""
    if rules is None:
        rules = [(f.name, 0.0, None) for f in df.schema.fields
                 if "age" in f.name.lower() and isinstance(f.dataType, T.NumericType)]
    if not rules:
        return df.sparkSession.createDataFrame(
            [], "column string, min double, max double, n_violations bigint, warn boolean")
    conds = []
    for c, lo, hi in rules:
        v = F.lit(False)
        if lo is not None:
            v = v | (F.col(c) < F.lit(lo))
        if hi is not None:
            v = v | (F.col(c) > F.lit(hi))
        conds.append(F.count_if(v))
    row = df.agg(*[e.alias(f"v{i}") for i, e in enumerate(conds)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(lo).cast("double").alias("min"),
                 F.lit(hi).cast("double").alias("max"), F.col(f"v{i}").alias("n_violations"))
        for i, (c, lo, hi) in enumerate(rules)]))).withColumn("warn", F.col("n_violations") > 0)


def quality_report(df: DataFrame, missingness_warn: float = MISSINGNESS_WARN,
                   duplicate_warn: float = DUPLICATE_WARN, z_thresh: float = OUTLIER_Z,
                   outlier_frac_warn: float = OUTLIER_FRAC_WARN, rules: list[tuple] | None = None) -> DataFrame:
    """Q5: Q1-Q4 as long rows (check, column, value, threshold, warn, detail).

    Three scans: one aggregation row with every column's missing count,
    every numeric column's count/mean/population std and every range rule's
    violations (collected: it is one row, and its means and stds are the
    z-score constants); one pass counting |z| >= t with those constants as
    literals; one group-by over all columns for duplicates."""
    spark = df.sparkSession
    cols = df.columns
    num = numeric_measure_columns(df)
    if rules is None:
        rules = [(f.name, 0.0, None) for f in df.schema.fields
                 if "age" in f.name.lower() and isinstance(f.dataType, T.NumericType)]
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count_if(_is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)]
    for i, c in enumerate(num):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mu{i}"), F.stddev_pop(x).alias(f"sd{i}")]
    for j, (c, lo, hi) in enumerate(rules):
        v = F.lit(False)
        if lo is not None:
            v = v | (F.col(c) < F.lit(lo))
        if hi is not None:
            v = v | (F.col(c) > F.lit(hi))
        aggs.append(F.count_if(v).alias(f"v{j}"))
    row = df.agg(*aggs).collect()[0]
    n = row["_n"]
    out = [("missingness", c, (row[f"m{i}"] / n) if n else 0.0, float(missingness_warn),
            bool(((row[f"m{i}"] / n) if n else 0.0) >= missingness_warn), None) for i, c in enumerate(cols)]
    for j, (c, lo, hi) in enumerate(rules):
        lo_s = "" if lo is None else str(float(lo))
        hi_s = "" if hi is None else str(float(hi))
        out.append(("range", c, float(row[f"v{j}"]), 0.0, bool(row[f"v{j}"] > 0), f"range [{lo_s}, {hi_s}]"))
    fixed = spark.createDataFrame(out, _SCHEMA)
    keep = [(i, c) for i, c in enumerate(num)
            if row[f"n{i}"] >= MIN_OUTLIER_VALUES and row[f"sd{i}"] not in (None, 0.0)]
    parts = [fixed]
    if keep:
        cnt = df.agg(*[F.count_if(F.abs((F.col(c).cast("double") - F.lit(row[f"mu{i}"])) / F.lit(row[f"sd{i}"]))
                                  >= z_thresh).alias(f"o{i}") for i, c in keep])
        z = cnt.select(F.inline(F.array(*[
            F.struct(F.lit("zscore_outliers").alias("check"), F.lit(c).alias("column"),
                     (F.col(f"o{i}") / F.lit(max(row[f"n{i}"], 1))).cast("double").alias("value"),
                     F.lit(float(outlier_frac_warn)).alias("threshold"),
                     ((F.col(f"o{i}") / F.lit(max(row[f"n{i}"], 1))) >= outlier_frac_warn).alias("warn"),
                     F.concat(F.col(f"o{i}").cast("string"), F.lit(f" points with |z| >= {z_thresh:g}")).alias("detail"))
            for i, c in keep])))
        parts.append(z)
    d = duplicate_rate(df).select(
        F.lit("duplicate_rate").alias("check"), F.lit(None).cast("string").alias("column"),
        F.col("duplicate_rate").cast("double").alias("value"), F.lit(float(duplicate_warn)).alias("threshold"),
        (F.col("duplicate_rate") >= duplicate_warn).alias("warn"), F.lit(None).cast("string").alias("detail"))
    parts.append(d)
    res = parts[0]
    for p_ in parts[1:]:
        res = res.unionByName(p_)
    return res


def deduplicate(df: DataFrame, subset: list[str] | None = None, digest=_digest) -> DataFrame:
    """CL1: exact duplicate rows removed (of a key's rows any one stays).
    Rows whose digest (see ``duplicate_rate``) is met once pass; only the
    others are compared in full."""
    keys = subset or df.columns
    if not _flat(df, keys):
        return df.dropDuplicates(subset) if subset else df.dropDuplicates()
    rows, _, again = _marked(df, keys, digest)
    same = _same(rows, again)
    marks = rows.columns[-2:]
    single = rows.join(again, same, "left_anti").drop(*marks)
    return single.unionByName(rows.join(again, same, "left_semi").drop(*marks).dropDuplicates(keys))


def dedup_report(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """CL1 log: rows before and after deduplication (one row)."""
    r = duplicate_rate(df, subset)
    return r.select(F.col("n_rows").alias("rows_before"), F.col("n_distinct").alias("rows_after"),
                    (F.col("n_rows") - F.col("n_distinct")).alias("rows_removed"))
