"""Exact prefix sums and quantiles over sorted values, without a global window.

A global ``Window.orderBy`` moves every row into one task. Instead the
(per-value) counts are range-partitioned on ``(by..., value)``, written to
the checkpoint folder (so the partition ids are stable and survive lost
executors), and each partition computes its local running sums; the
per-partition totals (one row per partition and group) give the offsets.
Per-task memory is bounded by one range partition, whatever the skew of
the ``by`` keys, because a hot group is spread over many range partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.session import cut_lineage


def _n_parts(df: DataFrame) -> int:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(n, 1)


def prefix_sums(df: DataFrame, by: list[str], order: str, cols: list[str],
                partitions: int | None = None) -> DataFrame:
    """Add ``<c>_before`` = sum of ``c`` over rows of the same ``by`` group
    whose ``order`` value is strictly smaller (``order`` unique per group)."""
    parts = partitions or _n_parts(df)
    r = df.repartitionByRange(parts, *[F.col(b) for b in by], F.col(order)) \
          .withColumn("_pid", F.spark_partition_id())
    r = cut_lineage(r)
    keys = ["_pid", *by]
    w_local = Window.partitionBy(*keys).orderBy(order) \
        .rowsBetween(Window.unboundedPreceding, -1)
    local = r.select("*", *[F.coalesce(F.sum(c).over(w_local), F.lit(0)).alias(f"_loc_{c}")
                            for c in cols])
    tot = r.groupBy(*keys).agg(*[F.sum(c).alias(f"_tot_{c}") for c in cols])
    # One row per (partition, group): bounded by partitions + groups.
    w_off = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))) \
        .orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*keys, *[F.coalesce(F.sum(f"_tot_{c}").over(w_off), F.lit(0)).alias(f"_off_{c}")
                              for c in cols])
    out = local.join(off, keys)
    keep = [c for c in df.columns]
    return out.select(*keep, *[(F.col(f"_loc_{c}") + F.col(f"_off_{c}")).alias(f"{c}_before")
                               for c in cols])


def counted_prefix(df: DataFrame, value: str, by: list[str] | None = None,
                   weights: dict | None = None) -> DataFrame:
    """One pass over ``df``: count rows per (by, value) - or sum the given
    weight columns - and add the strictly-lower prefix sums. The result is
    checkpointed, so every later statistic reads the (smaller) distinct-value
    table instead of the source again. Columns: by..., _v, count columns,
    ``<count>_before``."""
    by = list(by or [])
    base = df.select(*by, F.col(value).cast("double").alias("_v"),
                     *[w.alias(name) for name, w in (weights or {}).items()]).where(F.col("_v").isNotNull())
    for b in by:
        base = base.where(F.col(b).isNotNull())
    if weights:
        aggs = [F.sum(name).cast("long").alias(name) for name in weights]
    else:
        aggs = [F.count(F.lit(1)).alias("_cnt")]
    counts = base.groupBy(*by, "_v").agg(*aggs)
    names = list(weights) if weights else ["_cnt"]
    return prefix_sums(counts, by, "_v", names)


def quantile_lookup(pre: DataFrame, by: list[str], qs: list[float], cnt: str = "_cnt",
                    prefix: str = "q") -> DataFrame:
    """Linear-interpolation quantiles (pandas / DuckDB quantile_cont) from a
    ``counted_prefix`` table: each distinct value is tested against the
    group's 2·len(qs) target ranks; only hits survive."""
    by = list(by or [])
    before = f"{cnt}_before"
    sizes = (pre.groupBy(*by) if by else pre.groupBy()).agg(F.sum(cnt).alias("_n")).where(F.col("_n") > 0)
    targets = F.array(*[
        F.struct(F.lit(i).alias("qi"),
                 F.floor((F.col("_n") - 1) * F.lit(q)).cast("long").alias("lo"),
                 F.ceil((F.col("_n") - 1) * F.lit(q)).cast("long").alias("hi"),
                 ((F.col("_n") - 1) * F.lit(q) - F.floor((F.col("_n") - 1) * F.lit(q))).alias("frac"))
        for i, q in enumerate(qs)])
    sizes = sizes.select(*by, targets.alias("_tgt"))
    joined = pre.where(F.col(cnt) > 0).join(sizes, by) if by else \
        pre.where(F.col(cnt) > 0).crossJoin(F.broadcast(sizes))
    hit = joined.select(*by, "_v", F.explode(F.filter(
        F.transform("_tgt", lambda t: F.struct(
            t["qi"].alias("qi"), t["frac"].alias("frac"),
            ((t["lo"] >= F.col(before)) & (t["lo"] < F.col(before) + F.col(cnt))).alias("is_lo"),
            ((t["hi"] >= F.col(before)) & (t["hi"] < F.col(before) + F.col(cnt))).alias("is_hi"))),
        lambda s: s["is_lo"] | s["is_hi"])).alias("h"))
    per_q = hit.groupBy(*by, F.col("h.qi").alias("qi")).agg(
        F.max(F.when(F.col("h.is_lo"), F.col("_v"))).alias("vlo"),
        F.max(F.when(F.col("h.is_hi"), F.col("_v"))).alias("vhi"),
        F.max("h.frac").alias("frac"))
    val = (F.col("vlo") + F.col("frac") * (F.col("vhi") - F.col("vlo"))).cast("double")
    return per_q.groupBy(*by).agg(*[
        F.max(F.when(F.col("qi") == i, val)).alias(quantile_name(prefix, q)) for i, q in enumerate(qs)])


def weighted_moments(pre: DataFrame, by: list[str], cnt: str = "_cnt", suffix: str = "") -> DataFrame:
    """count, mean, sample std, min, max from a (value, count) table:
    mean first, then centred squares (no cancellation)."""
    by = list(by or [])
    live = pre.where(F.col(cnt) > 0)
    g = live.groupBy(*by) if by else live.groupBy()
    m = g.agg(F.sum(cnt).alias(f"count{suffix}"),
              (F.sum(F.col("_v") * F.col(cnt)) / F.sum(cnt)).alias(f"mean{suffix}"),
              F.min("_v").alias(f"min{suffix}"), F.max("_v").alias(f"max{suffix}"))
    j = live.join(m, by) if by else live.crossJoin(F.broadcast(m))
    ss = (j.groupBy(*by) if by else j.groupBy()).agg(
        F.sum(F.col(cnt) * F.pow(F.col("_v") - F.col(f"mean{suffix}"), 2)).alias("_ss"))
    out = m.join(ss, by) if by else m.crossJoin(ss)
    n = F.col(f"count{suffix}")
    return out.select(*by, f"count{suffix}", f"mean{suffix}",
                      F.when(n > 1, F.sqrt(F.col("_ss") / (n - 1))).alias(f"std{suffix}"),
                      F.when(n > 1, F.col("_ss") / (n - 1)).alias(f"var{suffix}"),
                      f"min{suffix}", f"max{suffix}")


def exact_quantiles(df: DataFrame, value: str, qs: list[float], by: list[str] | None = None,
                    prefix: str = "q") -> DataFrame:
    """Exact quantiles of ``value`` per ``by`` group, one row per group with
    columns ``<prefix><q>`` (dots replaced by underscores)."""
    by = list(by or [])
    return quantile_lookup(counted_prefix(df, value, by), by, [float(q) for q in qs], prefix=prefix)


def value_summary(df: DataFrame, value: str, qs: list[float], by: list[str] | None = None,
                  prefix: str = "q") -> DataFrame:
    """Moments and exact quantiles from ONE pass over the source."""
    by = list(by or [])
    pre = counted_prefix(df, value, by)
    mom = weighted_moments(pre, by)
    qt = quantile_lookup(pre, by, [float(q) for q in qs], prefix=prefix)
    return mom.join(qt, by, "left") if by else mom.crossJoin(qt)


def quantile_name(prefix: str, q: float) -> str:
    return f"{prefix}{q:g}".replace(".", "_")


def ordered_lag(df: DataFrame, by: list[str], order: list[str], value: str, partitions: int | None = None,
                name: str | None = None) -> DataFrame:
    """``lag(value) over (partition by by order by order)`` without putting a
    whole ``by`` group in one task: range partitions on (by, order), a local
    lag inside each, and the first row of each (partition, group) takes the
    last value of the same group in the nearest earlier partition (a small
    table of one row per partition and group)."""
    name = name or f"prev_{value}"
    parts = partitions or _n_parts(df)
    r = df.repartitionByRange(parts, *[F.col(c) for c in [*by, *order]]) \
          .withColumn("_pid", F.spark_partition_id())
    r = cut_lineage(r)
    keys = ["_pid", *by]
    w = Window.partitionBy(*keys).orderBy(*order)
    local = r.withColumn("_lag", F.lag(value).over(w)).withColumn("_rn", F.row_number().over(w))
    last = r.groupBy(*keys).agg(F.max_by(F.col(value), F.struct(*order)).alias("_last"))
    w2 = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_pid")
    carry = last.select(*keys, F.lag("_last").over(w2).alias("_carry"))
    out = local.join(carry, keys)
    fixed = F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_lag"))
    return out.select(*df.columns, fixed.alias(name))


def running_extreme(df: DataFrame, order: str, value: str, kind: str = "max", partitions: int | None = None,
                    name: str | None = None) -> DataFrame:
    """Running max (or min) of ``value`` in ``order`` (unique) order over the
    whole table, without a single-task window: local running extremes per
    range partition plus the extreme of all earlier partitions (one row per
    partition)."""
    name = name or f"running_{kind}"
    parts = partitions or _n_parts(df)
    agg = F.max if kind == "max" else F.min
    pick = F.greatest if kind == "max" else F.least
    r = cut_lineage(df.repartitionByRange(parts, F.col(order)).withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy("_pid").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = r.withColumn("_loc", agg(value).over(w))
    tot = r.groupBy("_pid").agg(agg(value).alias("_t"))
    w2 = Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = tot.select("_pid", agg("_t").over(w2).alias("_c"))
    out = local.join(F.broadcast(carry), "_pid")
    return out.select(*df.columns, F.coalesce(pick(F.col("_loc"), F.col("_c")), F.col("_loc")).alias(name))
