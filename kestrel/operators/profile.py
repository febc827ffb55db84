"""PR1-PR3: dataset summary, column profile, datetime-column detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.columns import DATE_FORMATS, is_numeric_type, require_columns
from kestrel.operators.aggregate import _unpivot_as_string


def dataset_summary(df: DataFrame) -> DataFrame:
    """PR1: one row (n_rows, n_cols, columns, dtypes)."""
    names = df.columns
    types = [f.dataType.simpleString() for f in df.schema.fields]
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(names)).alias("n_cols"),
        F.array(*[F.lit(n) for n in names]).alias("columns"),
        F.array(*[F.lit(t) for t in types]).alias("dtypes"))


def column_profile(df: DataFrame, columns: list[str] | None = None, n_examples: int = 5,
                   approx: bool = False) -> DataFrame:
    """PR2: one row per column, from ONE scan of the source.

    The table is unpivoted to (column, value-as-text) - NULLs included, -0.0 as 0.0 - and
    counted per pair (partial aggregation, one shuffle); that table is
    written to the checkpoint folder and everything else reads it:
    missing counts (NULL, and NaN for floating columns), distinct non-NULL
    values, the most frequent distinct values as examples (``row_number()
    <= n`` planned as a map-side WindowGroupLimit), and for numeric columns
    count/mean/std/min/max and exact quartiles from the (value, count)
    pairs (text -> double round-trips exactly). ``approx=True`` takes
    approximate quartiles and distinct counts from the source instead.
    """
    from kestrel.operators.ranks import prefix_sums, quantile_lookup, weighted_moments
    from kestrel.session import cut_lineage
    cols = columns or df.columns
    require_columns(df, *cols)
    fields = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in cols if is_numeric_type(fields[c])]
    floating = [c for c in cols if isinstance(fields[c], (T.DoubleType, T.FloatType))]
    null_d = F.lit(None).cast("double")
    dtypes = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(fields[c].simpleString()))])

    pairs = cut_lineage(_unpivot_as_string(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("freq")))
    missing = F.col("value").isNull() | (F.col("column").isin(*floating) & (F.col("value") == "NaN")) \
        if floating else F.col("value").isNull()
    counts = pairs.groupBy("column").agg(
        F.sum("freq").alias("_n"), F.coalesce(F.sum(F.when(missing, F.col("freq"))), F.lit(0)).alias("n_missing"),
        F.count_if(~missing).alias("n_unique"))
    present = pairs.where(~missing)
    w = Window.partitionBy("column").orderBy(F.col("freq").desc(), F.col("value").asc())
    ex = (present.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_examples)
          .groupBy("column").agg(F.sort_array(F.collect_list(F.struct("_r", "value"))).alias("_ex"))
          .select("column", F.transform("_ex", lambda s: s["value"]).alias("example_values")))
    names = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(cols)], "column string, _pos int")
    out = names.join(F.broadcast(counts), "column", "left").join(ex, "column", "left")
    if numeric and not approx:
        num = present.where(F.col("column").isin(*numeric)).select(
            "column", F.col("value").cast("double").alias("_v"), F.col("freq").alias("_cnt"))
        pre = prefix_sums(num, ["column"], "_v", ["_cnt"])
        mom = weighted_moments(pre, ["column"]).select("column", F.col("count").alias("count"), "mean", "std",
                                                        "min", "max")
        q = quantile_lookup(pre, ["column"], [0.25, 0.5, 0.75]).toDF("column", "p25", "median", "p75")
        out = out.join(mom, "column", "left").join(q, "column", "left")
    elif numeric:
        long_num = df.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_v")) for c in numeric])))
        long_num = long_num.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        st = long_num.groupBy("column").agg(
            F.count("_v").alias("count"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"),
            F.min("_v").alias("min"), F.max("_v").alias("max"),
            F.percentile_approx("_v", [0.25, 0.5, 0.75], 10000).alias("_q"))
        out = out.join(st.select("column", "count", "mean", "std", "min", "max", F.col("_q")[0].alias("p25"),
                                 F.col("_q")[1].alias("median"), F.col("_q")[2].alias("p75")), "column", "left")
    else:
        out = out.select("*", F.lit(None).cast("long").alias("count"),
                         *[null_d.alias(c) for c in ("mean", "std", "min", "p25", "median", "p75", "max")])
    n = F.col("_n")
    return out.orderBy("_pos").select("column", dtypes[F.col("column")].alias("dtype"),
                      F.coalesce("n_missing", F.lit(0)).cast("long").alias("n_missing"),
                      F.when(n > 0, F.col("n_missing") / n).otherwise(F.lit(0.0)).alias("missing_frac"),
                      F.coalesce("n_unique", F.lit(0).cast("long")).alias("n_unique"),
                      F.coalesce("example_values", F.array().cast("array<string>")).alias("example_values"),
                      F.col("count").cast("long").alias("count"), "mean", "std", "min", "p25", "median", "p75",
                      "max")


def datetime_columns(df: DataFrame, min_rate: float = 0.8, min_values: int = 10,
                     formats=DATE_FORMATS) -> DataFrame:
    """PR3: string columns whose non-NULL values parse as dates at a rate
    of at least ``min_rate`` (over the whole column, one aggregation).
    Rows (column, n_values, parse_rate, is_datetime)."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings:
        return df.sparkSession.createDataFrame(
            [], "column string, n_values bigint, parse_rate double, is_datetime boolean")
    aggs = []
    for i, c in enumerate(strings):
        s = F.trim(F.col(c))
        parsed = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats])
        aggs += [F.count(F.col(c)).alias(f"n{i}"), F.count_if(parsed.isNotNull()).alias(f"p{i}")]
    row = df.agg(*aggs)
    long = row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_values"),
                 F.try_divide(F.col(f"p{i}"), F.col(f"n{i}")).cast("double").alias("parse_rate"))
        for i, c in enumerate(strings)])))
    return long.select("column", "n_values", "parse_rate",
                       ((F.col("n_values") >= min_values) &
                        (F.coalesce("parse_rate", F.lit(0.0)) >= min_rate)).alias("is_datetime"))
