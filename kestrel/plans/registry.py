"""Registered queries over the test tables and their DuckDB twins.

Every query reads whole tables (or views Spark derives from them). Double
results are rounded to 6 decimals on both sides so the two engines hash
identically; money is summed as exact decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kestrel.functions.columns import round_doubles as R
from kestrel.operators import aggregate as A
from kestrel.operators import ranking as RK
from kestrel.sources.tables import AB_EVENTS_SQL, SALES_SQL, ab_events, sales, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SALES_CTE = f"WITH sales AS ({SALES_SQL})"
AB_CTE = f"WITH ab AS ({AB_EVENTS_SQL})"


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- aggregates

@register("groupby_agg", SALES_CTE + """
SELECT country, ROUND(CAST(SUM(revenue) AS DOUBLE), 6) AS value FROM sales
WHERE country IS NOT NULL GROUP BY country""")
def q_groupby_agg(spark, sf):
    return R(A.groupby_agg(sales(spark, sf, columns=["country", "revenue"]), "country", "revenue", "sum"))


@register("groupby2_agg", SALES_CTE + """
SELECT region, segment, ROUND(AVG(quantity), 6) AS value FROM sales
WHERE region IS NOT NULL AND segment IS NOT NULL GROUP BY 1, 2""")
def q_groupby2_agg(spark, sf):
    return R(A.groupby2_agg(sales(spark, sf, columns=["region", "segment", "quantity"]), "region", "segment", "quantity", "mean"))


@register("topk", SALES_CTE + """
SELECT customer_id, ROUND(CAST(SUM(revenue) AS DOUBLE), 6) AS value FROM sales
WHERE customer_id IS NOT NULL GROUP BY 1 ORDER BY value DESC, customer_id LIMIT 10""")
def q_topk(spark, sf):
    return R(A.topk(sales(spark, sf, columns=["customer_id", "revenue"]), "customer_id", "revenue", "sum", k=10))


@register("segment_share", SALES_CTE + """,
g AS (SELECT product_category k, CAST(SUM(revenue) AS DOUBLE) v FROM sales
      WHERE product_category IS NOT NULL GROUP BY 1)
SELECT k AS segment, ROUND(v, 6) AS value, ROUND(v / SUM(v) OVER (), 6) AS share_pct,
       ROUND(v / (SELECT SUM(v) FROM g), 6) AS share_of_total FROM g""")
def q_segment_share(spark, sf):
    return R(A.segment_analysis(sales(spark, sf, columns=["product_category", "revenue"]), "product_category", "revenue", "sum"))


@register("filter_agg", SALES_CTE + """
SELECT 'segment' AS filter_col, 'BUILDING' AS filter_val,
       ROUND(CAST(COALESCE(SUM(revenue), 0) AS DOUBLE), 6) AS value
FROM sales WHERE segment = 'BUILDING'""")
def q_filter_agg(spark, sf):
    return R(A.filter_agg(sales(spark, sf, columns=["segment", "revenue"]), "segment", "BUILDING", "revenue", "sum"))


@register("focus_rank", SALES_CTE + """,
g AS (SELECT country k, CAST(SUM(revenue) AS DOUBLE) v FROM sales WHERE country IS NOT NULL GROUP BY 1),
f AS (SELECT k, v FROM g WHERE k = 'NATION_7')
SELECT f.k AS focus, ROUND(f.v, 6) AS focus_value,
       1 + COUNT(*) FILTER (WHERE g.v > f.v OR (g.v = f.v AND g.k < f.k)) AS rank,
       COUNT(*) AS n_segments, ROUND(MAX(g.v), 6) AS top_value, ROUND(MAX(g.v) - f.v, 6) AS gap_to_top
FROM g CROSS JOIN f GROUP BY f.k, f.v""")
def q_focus_rank(spark, sf):
    return R(RK.focus_rank(sales(spark, sf, columns=["country", "revenue"]), "country", "revenue", "NATION_7"))


@register("leader_margin", SALES_CTE + """,
g AS (SELECT segment k, CAST(SUM(revenue) AS DOUBLE) v FROM sales WHERE segment IS NOT NULL GROUP BY 1),
t AS (SELECT * FROM g ORDER BY v DESC, k LIMIT 2), b AS (SELECT * FROM g ORDER BY v ASC, k DESC LIMIT 2)
SELECT (SELECT arg_max(k, v) FROM t) AS leader, (SELECT ROUND(MAX(v), 6) FROM t) AS leader_value,
       (SELECT ROUND(MAX(v) - MIN(v), 6) FROM t) AS leader_margin,
       (SELECT arg_min(k, v) FROM b) AS laggard, (SELECT ROUND(MIN(v), 6) FROM b) AS laggard_value,
       (SELECT ROUND(MAX(v) - MIN(v), 6) FROM b) AS laggard_margin""")
def q_leader_margin(spark, sf):
    return R(RK.leader_margin(sales(spark, sf, columns=["segment", "revenue"]), "segment", "revenue"))


@register("distribution", """
SELECT 'o_totalprice' AS "column", COUNT(o_totalprice) AS count, ROUND(AVG(o_totalprice), 6) AS mean,
       ROUND(STDDEV_SAMP(o_totalprice), 6) AS std, ROUND(MIN(o_totalprice), 6) AS min,
       ROUND(MAX(o_totalprice), 6) AS max,
       ROUND(quantile_cont(o_totalprice, 0.05), 6) AS q0_05, ROUND(quantile_cont(o_totalprice, 0.25), 6) AS q0_25,
       ROUND(quantile_cont(o_totalprice, 0.5), 6) AS q0_5, ROUND(quantile_cont(o_totalprice, 0.75), 6) AS q0_75,
       ROUND(quantile_cont(o_totalprice, 0.95), 6) AS q0_95
FROM orders WHERE o_totalprice IS NOT NULL AND NOT isnan(o_totalprice)""")
def q_distribution(spark, sf):
    return R(A.distribution(table(spark, sf, "orders"), "o_totalprice"))


@register("group_distribution", SALES_CTE + """,
g AS (SELECT customer_id, CAST(SUM(revenue) AS DOUBLE) v FROM sales WHERE customer_id IS NOT NULL GROUP BY 1)
SELECT 'customer_id' AS group_by, 'revenue' AS metric, 'sum' AS agg, COUNT(v) AS n_groups,
       ROUND(quantile_cont(v, 0.5), 6) AS q0_5, ROUND(quantile_cont(v, 0.75), 6) AS q0_75,
       ROUND(quantile_cont(v, 0.9), 6) AS q0_9, ROUND(quantile_cont(v, 0.95), 6) AS q0_95,
       ROUND(quantile_cont(v, 0.99), 6) AS q0_99, ROUND(MAX(v), 6) AS max_group_value,
       ROUND(MIN(v), 6) AS min_group_value, ROUND(AVG(v), 6) AS mean_group_value FROM g""")
def q_group_distribution(spark, sf):
    return R(A.group_distribution(sales(spark, sf, columns=["customer_id", "revenue"]), "customer_id", "revenue", "sum"))


@register("high_value_groups", SALES_CTE + """,
g AS (SELECT customer_id, CAST(SUM(revenue) AS DOUBLE) v FROM sales WHERE customer_id IS NOT NULL GROUP BY 1),
t AS (SELECT quantile_cont(v, 0.9) thr FROM g)
SELECT customer_id, ROUND(v, 6) AS value, ROUND(thr, 6) AS threshold FROM g, t WHERE v >= thr""")
def q_high_value_groups(spark, sf):
    return R(RK.high_value_groups(sales(spark, sf, columns=["customer_id", "revenue"]), "customer_id", "revenue", "sum", 0.9))


_CORR_COLS = ["quantity", "unit_price", "discount_pct", "revenue"]


def _corr_sql():
    parts = []
    for a in _CORR_COLS:
        for b in _CORR_COLS:
            if a == b:
                continue
            ca, cb = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
            parts.append(
                f"SELECT '{a}' AS x, '{b}' AS y, COUNT(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, "
                f"ROUND(CORR({ca}, {cb}), 6) AS r, 'computed' AS status FROM sales")
    return SALES_CTE + "\n" + "\nUNION ALL\n".join(parts)


@register("correlation_matrix", _corr_sql())
def q_correlation_matrix(spark, sf):
    return R(A.correlation_matrix(sales(spark, sf, columns=_CORR_COLS), _CORR_COLS))


@register("recency", """
WITH g AS (SELECT o_custkey, MAX(o_orderdate) AS last_date FROM orders
           WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY 1),
m AS (SELECT MAX(o_orderdate) AS reference_date FROM orders WHERE o_custkey IS NOT NULL)
SELECT o_custkey, last_date, reference_date,
       CAST(floor(date_diff('second', last_date, reference_date) / 86400.0) AS BIGINT) AS recency_days
FROM g, m""")
def q_recency(spark, sf):
    return A.recency_by_group(table(spark, sf, "orders"), "o_custkey", "o_orderdate")


@register("value_counts", """
SELECT CAST(o_orderpriority AS VARCHAR) AS value, COUNT(*) AS count FROM orders
WHERE o_orderpriority IS NOT NULL GROUP BY 1""")
def q_value_counts(spark, sf):
    return A.value_counts(table(spark, sf, "orders"), "o_orderpriority")


@register("contingency", """
SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders
WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2""")
def q_contingency(spark, sf):
    return A.contingency(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@register("distinct_count", """
SELECT 'l_orderkey' AS "column", COUNT(DISTINCT l_orderkey) AS n_unique FROM lineitem UNION ALL
SELECT 'l_partkey', COUNT(DISTINCT l_partkey) FROM lineitem UNION ALL
SELECT 'l_returnflag', COUNT(DISTINCT l_returnflag) FROM lineitem UNION ALL
SELECT 'l_shipdate', COUNT(DISTINCT l_shipdate) FROM lineitem""")
def q_distinct_count(spark, sf):
    return A.distinct_count(table(spark, sf, "lineitem"),
                            ["l_orderkey", "l_partkey", "l_returnflag", "l_shipdate"])


@register("scalar_median", """
SELECT ROUND(MEDIAN(l_quantity), 6) AS value FROM lineitem""")
def q_scalar_median(spark, sf):
    return R(A.scalar_agg(table(spark, sf, "lineitem"), "l_quantity", "median"))


@register("cube_totals", SALES_CTE + """
SELECT region, segment, ROUND(CAST(COALESCE(SUM(revenue), 0) AS DOUBLE), 6) AS value,
       CAST(GROUPING(region, segment) AS INTEGER) AS grouping_id
FROM sales GROUP BY CUBE (region, segment)""")
def q_cube_totals(spark, sf):
    from pyspark.sql import functions as F
    d = A.cube_agg(sales(spark, sf, columns=["region", "segment", "revenue"]), ["region", "segment"], "revenue", "sum")
    return R(d.withColumn("grouping_id", F.col("grouping_id").cast("int")))


# --------------------------------------------------- time series and cohorts

from pyspark.sql import functions as F  # noqa: E402

from kestrel.operators import cohort as C  # noqa: E402
from kestrel.operators import kpi as K  # noqa: E402
from kestrel.operators import timeseries as TS  # noqa: E402


def _orders_money(spark, sf):
    o = table(spark, sf, "orders")
    return o.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))


@register("timeseries_monthly_gapfill", """
WITH g AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) m,
                  SUM(CAST(o_totalprice AS DECIMAL(18,2))) v
           FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1),
b AS (SELECT CAST(unnest(generate_series((SELECT MIN(m) FROM g), (SELECT MAX(m) FROM g),
             INTERVAL 1 MONTH)) AS DATE) m)
SELECT CAST(last_day(b.m) AS TIMESTAMP) AS period, ROUND(CAST(COALESCE(v, 0) AS DOUBLE), 6) AS value
FROM b LEFT JOIN g USING (m)""")
def q_ts_monthly(spark, sf):
    return R(TS.timeseries_agg(_orders_money(spark, sf), "o_orderdate", "o_totalprice", "M", "sum"))


@register("timeseries_daily_gapfill", """
WITH g AS (SELECT CAST(date_trunc('day', o_orderdate) AS DATE) d,
                  SUM(CAST(o_totalprice AS DECIMAL(18,2))) v
           FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1),
b AS (SELECT CAST(unnest(generate_series((SELECT MIN(d) FROM g), (SELECT MAX(d) FROM g),
             INTERVAL 1 DAY)) AS DATE) d)
SELECT CAST(b.d AS TIMESTAMP) AS period, ROUND(CAST(COALESCE(v, 0) AS DOUBLE), 6) AS value
FROM b LEFT JOIN g USING (d)""")
def q_ts_daily(spark, sf):
    return R(TS.timeseries_agg(_orders_money(spark, sf), "o_orderdate", "o_totalprice", "D", "sum"))


@register("timeseries_weekly_mean", """
SELECT CAST(CAST(date_trunc('week', l_shipdate) AS DATE) + 6 AS TIMESTAMP) AS period,
       ROUND(AVG(l_quantity), 6) AS value
FROM lineitem WHERE l_shipdate IS NOT NULL AND l_quantity IS NOT NULL GROUP BY 1""")
def q_ts_weekly(spark, sf):
    return R(TS.timeseries_agg(table(spark, sf, "lineitem"), "l_shipdate", "l_quantity", "W", "mean"))


@register("timeseries_quarterly_count", """
WITH g AS (SELECT CAST(date_trunc('quarter', ts) AS DATE) q, COUNT(value) v FROM events
           WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1)
SELECT CAST(last_day(q + INTERVAL 2 MONTH) AS TIMESTAMP) AS period, CAST(v AS DOUBLE) AS value FROM g""")
def q_ts_quarterly(spark, sf):
    return TS.timeseries_agg(table(spark, sf, "events"), "ts", "value", "Q", "count")


_COHORT_SQL = """
WITH e AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate) p FROM orders
           WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL),
x AS (SELECT *, MIN(p) OVER (PARTITION BY o_custkey) c FROM e),
g AS (SELECT c, CAST(date_diff('month', c, p) AS INTEGER) n, COUNT(*) a FROM x GROUP BY 1, 2),
s AS (SELECT c, MAX(a) FILTER (WHERE n = 0) sz FROM g GROUP BY c),
l AS (SELECT strftime(g.c, '%Y-%m') AS cohort_period, n AS period_number, a AS active_entities,
             sz AS cohort_size, ROUND(a / sz, 6) AS retention_rate FROM g JOIN s USING (c))
"""


@register("cohort_long", _COHORT_SQL + "SELECT * FROM l")
def q_cohort_long(spark, sf):
    return R(C.cohort_long(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "M"))


_MATRIX_PERIODS = list(range(0, 80))


@register("cohort_matrix", _COHORT_SQL + "SELECT cohort_period, " + ", ".join(
    f'COALESCE(MAX(retention_rate) FILTER (WHERE period_number = {p}), 0.0) AS "{p}"'
    for p in _MATRIX_PERIODS) + " FROM l GROUP BY cohort_period")
def q_cohort_matrix(spark, sf):
    return R(C.cohort_matrix(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "M",
                             periods=_MATRIX_PERIODS))


_KPI_SELECT = """
CAST(COALESCE(SUM(revenue), 0) AS DOUBLE) AS total_revenue, CAST(COUNT(order_id) AS DOUBLE) AS order_count,
CAST(COALESCE(SUM(quantity), 0) AS DOUBLE) AS units_sold, AVG(discount_pct) AS avg_discount_pct"""


@register("kpi_ecommerce", SALES_CTE + f", k AS (SELECT {_KPI_SELECT} FROM sales)" + """
SELECT ROUND(total_revenue, 6) AS total_revenue, ROUND(order_count, 6) AS order_count,
       ROUND(units_sold, 6) AS units_sold, ROUND(avg_discount_pct, 6) AS avg_discount_pct,
       ROUND(CASE WHEN order_count <> 0 THEN total_revenue / order_count END, 6) AS avg_order_value FROM k""")
def q_kpi_ecommerce(spark, sf):
    return R(K.kpi_template_apply(sales(spark, sf), "ecommerce"))


@register("kpi_by_segment", SALES_CTE + f", k AS (SELECT region, {_KPI_SELECT} FROM sales "
          "WHERE region IS NOT NULL GROUP BY region)" + """
SELECT region, ROUND(total_revenue, 6) AS total_revenue, ROUND(order_count, 6) AS order_count,
       ROUND(units_sold, 6) AS units_sold, ROUND(avg_discount_pct, 6) AS avg_discount_pct,
       ROUND(CASE WHEN order_count <> 0 THEN total_revenue / order_count END, 6) AS avg_order_value FROM k""")
def q_kpi_by_segment(spark, sf):
    return R(K.kpi_template_apply(sales(spark, sf), "ecommerce", by=["region"]))


@register("metric_expression", SALES_CTE + """
SELECT 'unit_revenue' AS name, segment, ROUND(AVG(CAST(revenue AS DOUBLE) / quantity), 6) AS value,
       COUNT(*) FILTER (WHERE quantity = 0 OR quantity IS NULL OR revenue IS NULL) AS n_undefined
FROM sales WHERE segment IS NOT NULL GROUP BY segment""")
def q_metric_expression(spark, sf):
    return R(K.metric_definition(sales(spark, sf, columns=["segment", "revenue", "quantity"]), "unit_revenue", expression="revenue / quantity",
                                 group_by="segment"))


@register("metric_definition", SALES_CTE + """
SELECT 'median_quantity' AS name, region, ROUND(MEDIAN(quantity), 6) AS value
FROM sales WHERE region IS NOT NULL GROUP BY region""")
def q_metric_definition(spark, sf):
    return R(K.metric_definition(sales(spark, sf, columns=["region", "quantity"]), "median_quantity", metric_col="quantity",
                                 agg="median", group_by="region"))


# ------------------------------------------------ profiling, quality, joins

from kestrel.operators import profile as PR  # noqa: E402
from kestrel.operators import quality as QY  # noqa: E402
from kestrel.operators import star as ST  # noqa: E402


def _arr_str(df, *cols):
    return df.select(*[F.concat_ws("|", F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


_CUST_COLS = [("c_custkey", "bigint", True), ("c_name", "string", False), ("c_nationkey", "int", True),
              ("c_acctbal", "double", True), ("c_mktsegment", "string", False)]


def _profile_sql():
    parts = []
    for c, t, num in _CUST_COLS:
        if num:
            x = f"CAST({c} AS DOUBLE)"
            stats = (f"COUNT({c}) AS count, ROUND(AVG({x}), 6) AS mean, ROUND(STDDEV_SAMP({x}), 6) AS std, "
                     f"ROUND(MIN({x}), 6) AS min, ROUND(quantile_cont({x}, 0.25), 6) AS p25, "
                     f"ROUND(quantile_cont({x}, 0.5), 6) AS median, ROUND(quantile_cont({x}, 0.75), 6) AS p75, "
                     f"ROUND(MAX({x}), 6) AS max")
        else:
            stats = ("CAST(NULL AS BIGINT) AS count, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, "
                     "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS p25, CAST(NULL AS DOUBLE) AS median, "
                     "CAST(NULL AS DOUBLE) AS p75, CAST(NULL AS DOUBLE) AS max")
        parts.append(f"""SELECT '{c}' AS "column", '{t}' AS dtype, COUNT(*) FILTER (WHERE {c} IS NULL) AS n_missing,
  ROUND(CASE WHEN COUNT(*) > 0 THEN COUNT(*) FILTER (WHERE {c} IS NULL) / COUNT(*) ELSE 0.0 END, 6) AS missing_frac,
  (SELECT COUNT(DISTINCT {c}) FROM customer) AS n_unique,
  (SELECT array_to_string(list(v ORDER BY f DESC, v), '|') FROM
     (SELECT CAST({c} AS VARCHAR) v, COUNT(*) f FROM customer WHERE {c} IS NOT NULL GROUP BY 1
      ORDER BY f DESC, v LIMIT 5)) AS example_values,
  {stats} FROM customer""")
    return "\nUNION ALL\n".join(parts)


@register("column_profile", _profile_sql())
def q_column_profile(spark, sf):
    return R(_arr_str(PR.column_profile(table(spark, sf, "customer")), "example_values"))


@register("dataset_summary", """
SELECT COUNT(*) AS n_rows, 5 AS n_cols, 'c_custkey|c_name|c_nationkey|c_acctbal|c_mktsegment' AS columns,
       'bigint|string|int|double|string' AS dtypes FROM customer""")
def q_dataset_summary(spark, sf):
    return _arr_str(PR.dataset_summary(table(spark, sf, "customer")), "columns", "dtypes")


def _orders_as_text(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(*[F.col(c).cast("string").alias(c) for c in o.columns])


_SQL_FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y/%m/%d",
                "%m/%d/%Y", "%d.%m.%Y", "%Y-%m"]


def _dt_sql():
    fm = "[" + ", ".join(f"'{f}'" for f in _SQL_FORMATS) + "]"
    parts = []
    for c in ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]:
        s = f"trim(CAST({c} AS VARCHAR))"
        parts.append(
            f"SELECT '{c}' AS \"column\", COUNT({c}) AS n_values, "
            f"ROUND(COUNT(try_strptime({s}, {fm})) / NULLIF(COUNT({c}), 0), 6) AS parse_rate FROM orders")
    return ("WITH r AS (" + " UNION ALL ".join(parts) + ") SELECT *, n_values >= 10 AND "
            "COALESCE(parse_rate, 0) >= 0.8 AS is_datetime FROM r")


@register("datetime_columns", _dt_sql())
def q_datetime_columns(spark, sf):
    return R(PR.datetime_columns(_orders_as_text(spark, sf)))


def _cust_orders(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return c.join(o, c.c_custkey == o.o_custkey, "left").drop("o_custkey")


@register("missingness", """
WITH t AS (SELECT c_custkey, c_name, o_orderkey, o_totalprice, o_orderdate FROM customer
           LEFT JOIN orders ON c_custkey = o_custkey)
SELECT "column", ROUND(m, 6) AS missing_frac, m >= 0.2 AS warn FROM (
  SELECT 'c_custkey' AS "column", COUNT(*) FILTER (WHERE c_custkey IS NULL) / COUNT(*) AS m FROM t UNION ALL
  SELECT 'c_name', COUNT(*) FILTER (WHERE c_name IS NULL) / COUNT(*) FROM t UNION ALL
  SELECT 'o_orderkey', COUNT(*) FILTER (WHERE o_orderkey IS NULL) / COUNT(*) FROM t UNION ALL
  SELECT 'o_totalprice', COUNT(*) FILTER (WHERE o_totalprice IS NULL OR isnan(o_totalprice)) / COUNT(*) FROM t UNION ALL
  SELECT 'o_orderdate', COUNT(*) FILTER (WHERE o_orderdate IS NULL) / COUNT(*) FROM t)""")
def q_missingness(spark, sf):
    return R(QY.missingness(_cust_orders(spark, sf)))


@register("duplicate_rate", """
WITH g AS (SELECT l_orderkey, l_linenumber, COUNT(*) c FROM lineitem GROUP BY ALL)
SELECT CAST(SUM(c) AS BIGINT) AS n_rows, COUNT(*) AS n_distinct,
       ROUND(1 - COUNT(*) / SUM(c), 6) AS duplicate_rate FROM g""")
def q_duplicate_rate(spark, sf):
    return R(QY.duplicate_rate(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]))


@register("dedup", """
WITH g AS (SELECT COUNT(*) c FROM lineitem GROUP BY ALL)
SELECT CAST(SUM(c) AS BIGINT) AS rows_before, COUNT(*) AS rows_after, CAST(SUM(c) - COUNT(*) AS BIGINT) AS rows_removed
FROM (SELECT *, 1 FROM lineitem) x, LATERAL (SELECT 1) GROUP BY ALL""")
def q_dedup(spark, sf):
    return QY.dedup_report(table(spark, sf, "lineitem"))


ORACLES["dedup"] = """
WITH g AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
                  l_tax, l_returnflag, l_linestatus, l_shipdate, COUNT(*) c FROM lineitem GROUP BY ALL)
SELECT CAST(SUM(c) AS BIGINT) AS rows_before, COUNT(*) AS rows_after, CAST(SUM(c) - COUNT(*) AS BIGINT) AS rows_removed
FROM g"""


_Z_COLS = ["c_custkey", "c_nationkey", "c_acctbal"]


def _z_sql(tbl, cols, z):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS "column", COUNT({c}) AS n_values, AVG({x}) AS mean,
  STDDEV_POP({x}) AS std, COUNT(*) FILTER (WHERE abs(({x} - (SELECT AVG({x}) FROM {tbl})) /
  (SELECT STDDEV_POP({x}) FROM {tbl})) >= {z}) AS n_outliers FROM {tbl}""")
    return "(" + " UNION ALL ".join(parts) + ")"


@register("zscore_outliers", "SELECT \"column\", n_values, ROUND(mean, 6) AS mean, ROUND(std, 6) AS std, "
          "n_outliers, ROUND(n_outliers / GREATEST(n_values, 1), 6) AS outlier_frac_of_nonnull FROM "
          + _z_sql("customer", _Z_COLS, 1.5) + " WHERE n_values >= 20 AND std IS NOT NULL AND std <> 0")
def q_zscore(spark, sf):
    return R(QY.zscore_outliers(table(spark, sf, "customer"), 1.5))


@register("range_rules", """
SELECT 'c_acctbal' AS "column", CAST(0.0 AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max,
       COUNT(*) FILTER (WHERE c_acctbal < 0) AS n_violations, COUNT(*) FILTER (WHERE c_acctbal < 0) > 0 AS warn
FROM customer""")
def q_range_rules(spark, sf):
    return QY.range_rules(table(spark, sf, "customer"), [("c_acctbal", 0.0, None)])


_LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_LI_NUM = _LI_COLS[:8]


def _quality_sql():
    miss = " UNION ALL ".join(
        f"SELECT 'missingness' AS \"check\", '{c}' AS \"column\", "
        f"ROUND(COALESCE(COUNT(*) FILTER (WHERE {c} IS NULL{' OR isnan(' + c + ')' if c in _LI_NUM[4:] else ''}) "
        f"/ NULLIF(COUNT(*), 0), 0), 6) AS value, CAST(0.2 AS DOUBLE) AS threshold, NULL AS detail FROM lineitem" for c in _LI_COLS)
    dup = ("SELECT 'duplicate_rate', NULL, ROUND(CASE WHEN SUM(c) > 0 THEN 1 - COUNT(*) / SUM(c) ELSE 0 END, 6), "
           "0.01, NULL FROM (SELECT COUNT(*) c FROM lineitem GROUP BY ALL)")
    dup = dup.replace("GROUP BY ALL", "GROUP BY " + ", ".join(_LI_COLS))
    z = ("SELECT 'zscore_outliers', \"column\", ROUND(n_outliers / GREATEST(n_values, 1), 6), 0.01, "
         "CAST(n_outliers AS VARCHAR) || ' points with |z| >= 4' FROM " + _z_sql("lineitem", _LI_NUM, 4.0)
         + " WHERE n_values >= 20 AND std IS NOT NULL AND std <> 0")
    return (f"WITH r AS ({miss} UNION ALL {dup} UNION ALL {z}) SELECT \"check\", \"column\", value, threshold, "
            "value >= threshold AS warn, detail FROM r")


@register("quality_report", _quality_sql())
def q_quality_report(spark, sf):
    return R(QY.quality_report(table(spark, sf, "lineitem")))


_STAR_RELS = [("lineitem", ["l_orderkey"], "orders", ["o_orderkey"]),
              ("orders", ["o_custkey"], "customer", ["c_custkey"]),
              ("customer", ["c_nationkey"], "nation", ["n_nationkey"]),
              ("nation", ["n_regionkey"], "region", ["r_regionkey"]),
              ("lineitem", ["l_partkey"], "part", ["p_partkey"]),
              ("lineitem", ["l_suppkey"], "supplier", ["s_suppkey"])]
_STAR_TABLES = ["lineitem", "orders", "customer", "nation", "region", "part", "supplier"]


def _star_tables(spark, sf):
    return {t: table(spark, sf, t) for t in _STAR_TABLES}


_STAR_FROM = """FROM lineitem t0 LEFT JOIN orders t1 ON t0.l_orderkey = t1.o_orderkey
LEFT JOIN customer t2 ON t1.o_custkey = t2.c_custkey LEFT JOIN nation t3 ON t2.c_nationkey = t3.n_nationkey
LEFT JOIN region t4 ON t3.n_regionkey = t4.r_regionkey"""


@register("star_groupby", f"""
SELECT t4.r_name AS g1_r_name, t2.c_mktsegment AS g2_c_mktsegment, ROUND(SUM(t0.l_quantity), 6) AS value
{_STAR_FROM} GROUP BY 1, 2""")
def q_star_groupby(spark, sf):
    return R(ST.star_groupby(_star_tables(spark, sf), _STAR_RELS, "l_quantity", ["r_name", "c_mktsegment"], "sum"))


@register("star_groupby_mean", """
SELECT t1.p_type AS g1_p_type, t0.l_returnflag AS g2_l_returnflag, ROUND(AVG(t0.l_extendedprice), 6) AS value
FROM lineitem t0 LEFT JOIN part t1 ON t0.l_partkey = t1.p_partkey GROUP BY 1, 2""")
def q_star_groupby_mean(spark, sf):
    return R(ST.star_groupby(_star_tables(spark, sf), _STAR_RELS, "l_extendedprice", ["p_type", "l_returnflag"],
                             "mean", limit=0))


@register("join_profile", f"""
SELECT 'lineitem' AS fact_table, 'region' AS dimension_table,
       'lineitem|orders|customer|nation|region' AS join_path,
       (SELECT COUNT(*) FROM lineitem) AS fact_rows, COUNT(*) AS joined_rows,
       COUNT(*) FILTER (WHERE t4.r_regionkey IS NULL) AS unmatched_rows,
       (SELECT MAX(m) FROM (SELECT MAX(c) m FROM (SELECT COUNT(*) c FROM orders GROUP BY o_orderkey) UNION ALL
                            SELECT MAX(c) FROM (SELECT COUNT(*) c FROM customer GROUP BY c_custkey) UNION ALL
                            SELECT MAX(c) FROM (SELECT COUNT(*) c FROM nation GROUP BY n_nationkey) UNION ALL
                            SELECT MAX(c) FROM (SELECT COUNT(*) c FROM region GROUP BY r_regionkey)))
         AS max_key_multiplicity, 'ok' AS status
{_STAR_FROM}""")
def q_join_profile(spark, sf):
    return _arr_str(ST.join_profile(_star_tables(spark, sf), _STAR_RELS, "lineitem", "region"), "join_path")


@register("relationship_check", """
WITH pk AS (SELECT o_orderkey, COUNT(*) c FROM orders GROUP BY 1)
SELECT CAST((SELECT SUM(c) FROM pk) AS BIGINT) AS parent_rows, (SELECT COUNT(*) FROM pk) AS parent_distinct_keys,
       (SELECT COUNT(*) FROM pk WHERE c > 1) AS duplicate_parent_keys, (SELECT COUNT(*) FROM lineitem) AS child_rows,
       (SELECT COUNT(*) FROM lineitem WHERE l_orderkey IS NULL) AS null_fk_rows,
       (SELECT COUNT(*) FROM lineitem l WHERE l_orderkey IS NOT NULL AND NOT EXISTS
          (SELECT 1 FROM pk WHERE pk.o_orderkey = l.l_orderkey)) AS orphan_rows,
       (SELECT COUNT(*) FROM pk WHERE c > 1) = 0 AND (SELECT COUNT(*) FROM lineitem l WHERE NOT EXISTS
          (SELECT 1 FROM pk WHERE pk.o_orderkey = l.l_orderkey)) = 0 AS valid""")
def q_relationship_check(spark, sf):
    return ST.relationship_check(table(spark, sf, "orders"), ["o_orderkey"], table(spark, sf, "lineitem"),
                                 ["l_orderkey"])


# ------------------------------------------------------------ statistics

from kestrel.operators.stats import intervals as CI  # noqa: E402
from kestrel.operators.stats import tests as HT  # noqa: E402

Z975 = "1.959963984540054"  # standard normal 97.5 % quantile (alpha = 0.05)


def _welch_sql(by: str | None):
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return AB_CTE + f""", g AS (SELECT {sel}
  COUNT(value) FILTER (WHERE variant = 'treatment') n_a, AVG(value) FILTER (WHERE variant = 'treatment') m_a,
  VAR_SAMP(value) FILTER (WHERE variant = 'treatment') v_a, COUNT(value) FILTER (WHERE variant = 'control') n_b,
  AVG(value) FILTER (WHERE variant = 'control') m_b, VAR_SAMP(value) FILTER (WHERE variant = 'control') v_b
  FROM ab WHERE variant IS NOT NULL {'AND ' + by + ' IS NOT NULL' if by else ''} {grp})
SELECT {sel}'treatment' AS group_a, 'control' AS group_b, n_a, n_b, ROUND(m_a, 6) AS mean_a, ROUND(m_b, 6) AS mean_b,
  ROUND(m_a - m_b, 6) AS mean_difference, ROUND((m_a - m_b) / sqrt(v_a / n_a + v_b / n_b), 6) AS statistic,
  ROUND(pow(v_a / n_a + v_b / n_b, 2) / (pow(v_a / n_a, 2) / (n_a - 1) + pow(v_b / n_b, 2) / (n_b - 1)), 6) AS df,
  ROUND((m_a - m_b) / sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2)), 6) AS cohens_d FROM g"""


_WELCH_COLS = ["group_a", "group_b", "n_a", "n_b", "mean_a", "mean_b", "mean_difference", "statistic", "df",
               "cohens_d"]


@register("welch_t", _welch_sql(None))
def q_welch_t(spark, sf):
    r = HT.welch_t_test(ab_events(spark, sf), "variant", "value", "treatment", "control")
    return R(r.select(*_WELCH_COLS))


@register("welch_t_by_segment", _welch_sql("event_type"))
def q_welch_t_by_segment(spark, sf):
    r = HT.welch_t_test(ab_events(spark, sf), "variant", "value", "treatment", "control", by=["event_type"])
    return R(r.select("event_type", *_WELCH_COLS))


@register("paired_t", """
WITH p AS (SELECT o_custkey, AVG(o_totalprice) FILTER (WHERE o_orderstatus = 'F') a,
                  AVG(o_totalprice) FILTER (WHERE o_orderstatus = 'O') b FROM orders
           WHERE o_custkey IS NOT NULL AND o_orderstatus IN ('F', 'O') GROUP BY 1),
d AS (SELECT a, b, a - b d FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT 'F' AS group_a, 'O' AS group_b, COUNT(*) AS n_pairs, ROUND(AVG(a), 6) AS mean_a, ROUND(AVG(b), 6) AS mean_b,
       ROUND(AVG(d), 6) AS mean_difference, ROUND(AVG(d) / (STDDEV_SAMP(d) / sqrt(COUNT(*))), 6) AS statistic,
       CAST(COUNT(*) - 1 AS DOUBLE) AS df, ROUND(AVG(d) / STDDEV_SAMP(d), 6) AS cohens_dz FROM d""")
def q_paired_t(spark, sf):
    r = HT.paired_t_test(table(spark, sf, "orders"), "o_orderstatus", "o_totalprice", "o_custkey", "F", "O")
    return R(r.select("group_a", "group_b", "n_pairs", "mean_a", "mean_b", "mean_difference", "statistic", "df",
                      "cohens_dz"))


def _mwu_sql(by: str | None):
    sel = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""
WITH e AS (SELECT {sel}event_type g, value v FROM events WHERE event_type IN ('click', 'view') AND value IS NOT NULL),
r AS (SELECT *, RANK() OVER (ORDER_P ORDER BY v) + (COUNT(*) OVER (PARTITION_P v) - 1) / 2.0 rk FROM e),
t AS (SELECT {sel}v, COUNT(*) c FROM e {'GROUP BY ' + by + ', v' if by else 'GROUP BY v'}),
tt AS (SELECT {sel}SUM(c * c * c - c) tie FROM t {grp}),
s AS (SELECT {sel}COUNT(*) FILTER (WHERE g = 'click') na, COUNT(*) FILTER (WHERE g = 'view') nb,
             SUM(rk) FILTER (WHERE g = 'click') ra, AVG(v) FILTER (WHERE g = 'click') ma,
             AVG(v) FILTER (WHERE g = 'view') mb, MEDIAN(v) FILTER (WHERE g = 'click') meda,
             MEDIAN(v) FILTER (WHERE g = 'view') medb FROM r {grp}),
u AS (SELECT *, ra - na * (na + 1) / 2.0 AS uu FROM s {'JOIN tt USING (' + by + ')' if by else ', tt'})
SELECT {sel}'click' AS group_a, 'view' AS group_b, na AS n_a, nb AS n_b, ROUND(uu, 6) AS u_statistic,
       ROUND(CAST(tie AS DOUBLE), 6) AS tie_term,
       ROUND((GREATEST(uu, na * nb - uu) - na * nb / 2.0 - 0.5) /
             sqrt(na * nb / 12.0 * ((na + nb + 1) - tie / ((na + nb) * (na + nb - 1.0)))), 6) AS z,
       ROUND(meda, 6) AS median_a, ROUND(medb, 6) AS median_b, ROUND(ma - mb, 6) AS mean_difference FROM u""" \
        .replace("ORDER_P", part).replace("PARTITION_P", f"PARTITION BY {by}, " if by else "PARTITION BY ")


_MWU_COLS = ["group_a", "group_b", "n_a", "n_b", "u_statistic", "tie_term", "z", "median_a", "median_b",
             "mean_difference"]


@register("mann_whitney", _mwu_sql(None))
def q_mann_whitney(spark, sf):
    r = HT.mann_whitney_u(table(spark, sf, "events"), "event_type", "value", "click", "view")
    return R(r.select(*_MWU_COLS))


@register("mann_whitney_by_segment", _mwu_sql("user_id"))
def q_mann_whitney_by_segment(spark, sf):
    r = HT.mann_whitney_u(table(spark, sf, "events"), "event_type", "value", "click", "view", by=["user_id"])
    return R(r.select("user_id", *_MWU_COLS))


@register("chi_square", """
WITH o AS (SELECT o_orderstatus a, o_orderpriority b, COUNT(*) n FROM orders
           WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2),
r AS (SELECT a, SUM(n) n FROM o GROUP BY a), c AS (SELECT b, SUM(n) n FROM o GROUP BY b),
t AS (SELECT SUM(n) n FROM o),
x AS (SELECT COALESCE(o.n, 0) o, r.n * c.n * 1.0 / t.n e FROM r CROSS JOIN c CROSS JOIN t
      LEFT JOIN o ON o.a = r.a AND o.b = c.b),
s AS (SELECT SUM((o - e) * (o - e) / e) chi, MIN(e) me FROM x)
SELECT CAST((SELECT n FROM t) AS BIGINT) AS n, (SELECT COUNT(*) FROM r) AS n_levels_left, (SELECT COUNT(*) FROM c) AS n_levels_right,
       ROUND(chi, 6) AS statistic, ((SELECT COUNT(*) FROM r) - 1) * ((SELECT COUNT(*) FROM c) - 1) AS dof,
       ROUND(me, 6) AS min_expected,
       ROUND(sqrt(chi / ((SELECT n FROM t) * LEAST((SELECT COUNT(*) FROM r) - 1, (SELECT COUNT(*) FROM c) - 1))), 6)
         AS cramers_v FROM s""")
def q_chi_square(spark, sf):
    r = HT.chi_square_independence(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")
    return R(r.select("n", "n_levels_left", "n_levels_right", "statistic", "dof", "min_expected", "cramers_v"))


@register("chi_square_2x2", AB_CTE + """,
c AS (SELECT COUNT(*) FILTER (WHERE variant = 'treatment' AND conversion = 1) a,
             COUNT(*) FILTER (WHERE variant = 'treatment' AND conversion = 0) b,
             COUNT(*) FILTER (WHERE variant = 'control' AND conversion = 1) c,
             COUNT(*) FILTER (WHERE variant = 'control' AND conversion = 0) d FROM ab),
k AS (SELECT *, a + b + c + d n, abs(a * d - b * c) / (a + b + c + d) dd,
             pow(a + b + c + d, 3) / ((a + b) * (c + d) * (a + c) * (b + d)) inv FROM c)
SELECT n, CAST(2 AS BIGINT) AS n_levels_left, CAST(2 AS BIGINT) AS n_levels_right,
       ROUND(pow(dd - LEAST(0.5, dd), 2) * inv, 6) AS statistic, CAST(1 AS BIGINT) AS dof, ROUND(LEAST(a + b, c + d) * LEAST(a + c, b + d) / n, 6) AS min_expected,
       ROUND(sqrt(pow(dd - LEAST(0.5, dd), 2) * inv / n), 6) AS cramers_v FROM k""")
def q_chi_square_2x2(spark, sf):
    r = HT.chi_square_independence(ab_events(spark, sf), "variant", "conversion")
    return R(r.select("n", "n_levels_left", "n_levels_right", "statistic", "dof", "min_expected", "cramers_v"))


_Z_SQL = AB_CTE + f""",
g AS (SELECT COUNT(*) FILTER (WHERE variant = 'treatment') na, COUNT(*) FILTER (WHERE variant = 'control') nb,
             COUNT(*) FILTER (WHERE variant = 'treatment' AND conversion = 1) xa,
             COUNT(*) FILTER (WHERE variant = 'control' AND conversion = 1) xb FROM ab WHERE conversion IS NOT NULL),
p AS (SELECT *, xa / na pa, xb / nb pb, (xa + xb) / (na + nb) pp FROM g)
SELECT 'treatment' AS group_a, 'control' AS group_b, na AS n_a, nb AS n_b, xa AS successes_a, xb AS successes_b,
       ROUND(pa, 6) AS rate_a, ROUND(pb, 6) AS rate_b, ROUND(pa - pb, 6) AS rate_difference,
       ROUND((pa - pb) / sqrt(GREATEST(1e-12, pp * (1 - pp) * (1.0 / na + 1.0 / nb))), 6) AS statistic,
       ROUND(pa - pb - {Z975} * sqrt(pa * (1 - pa) / na + pb * (1 - pb) / nb), 6) AS ci_lower,
       ROUND(pa - pb + {Z975} * sqrt(pa * (1 - pa) / na + pb * (1 - pb) / nb), 6) AS ci_upper,
       ROUND((pa - pb) / pb, 6) AS relative_lift,
       ROUND((xa + 0.5) * (nb - xb + 0.5) / ((na - xa + 0.5) * (xb + 0.5)), 6) AS odds_ratio FROM p"""
_Z_COLS = ["group_a", "group_b", "n_a", "n_b", "successes_a", "successes_b", "rate_a", "rate_b", "rate_difference",
           "statistic", "ci_lower", "ci_upper", "relative_lift", "odds_ratio"]


@register("two_proportion_z", _Z_SQL)
def q_two_proportion_z(spark, sf):
    r = HT.two_proportion_z_test(ab_events(spark, sf), "variant", "conversion", "treatment", "control", success_value=1)
    return R(r.select(*_Z_COLS))


@register("levene", """
WITH e AS (SELECT event_type g, value v FROM events WHERE event_type IN ('click', 'view') AND value IS NOT NULL),
m AS (SELECT g, MEDIAN(v) m FROM e GROUP BY g), z AS (SELECT g, ABS(v - m) z FROM e JOIN m USING (g)),
a AS (SELECT g, COUNT(*) n, AVG(z) zb, VAR_POP(z) vv FROM z GROUP BY g)
SELECT 'click' AS group_a, 'view' AS group_b, CAST(SUM(n) AS BIGINT) AS n,
       ROUND((SUM(n) - 2) * (SUM(n * zb * zb) - POW(SUM(n * zb), 2) / SUM(n)) / SUM(n * vv), 6) AS statistic,
       1.0::DOUBLE AS df1, CAST(SUM(n) - 2 AS DOUBLE) AS df2 FROM a""")
def q_levene(spark, sf):
    r = HT.levene_test(table(spark, sf, "events"), "event_type", "value", "click", "view")
    return R(r.select("group_a", "group_b", "n", "statistic", "df1", "df2"))


@register("tukey_outliers", """
WITH q AS (SELECT l_returnflag, COUNT(*) n, quantile_cont(l_extendedprice, 0.25) q1,
                  quantile_cont(l_extendedprice, 0.75) q3 FROM lineitem
           WHERE l_returnflag IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1),
o AS (SELECT l.l_returnflag, COUNT(*) FILTER (WHERE q3 - q1 > 0 AND (l_extendedprice < q1 - 1.5 * (q3 - q1)
             OR l_extendedprice > q3 + 1.5 * (q3 - q1))) n_out FROM lineitem l JOIN q USING (l_returnflag)
      WHERE l_extendedprice IS NOT NULL GROUP BY 1)
SELECT l_returnflag, n, ROUND(q1, 6) AS q1, ROUND(q3, 6) AS q3, ROUND(q3 - q1, 6) AS iqr,
       ROUND(q1 - 1.5 * (q3 - q1), 6) AS lower_fence, ROUND(q3 + 1.5 * (q3 - q1), 6) AS upper_fence,
       n_out AS n_outliers, ROUND(CASE WHEN n >= 4 THEN n_out / n END, 6) AS outlier_share,
       CASE WHEN n >= 4 THEN n_out / n <= 0.05 END AS passed FROM q JOIN o USING (l_returnflag)""")
def q_tukey_outliers(spark, sf):
    return R(HT.tukey_outliers(table(spark, sf, "lineitem"), "l_extendedprice", by=["l_returnflag"]))


@register("mean_ci", """
SELECT o_orderpriority, COUNT(o_totalprice) AS n, ROUND(AVG(o_totalprice), 6) AS mean,
       ROUND(STDDEV_SAMP(o_totalprice) / sqrt(COUNT(o_totalprice)), 6) AS sem FROM orders
WHERE o_orderpriority IS NOT NULL GROUP BY 1""")
def q_mean_ci(spark, sf):
    r = CI.mean_confidence_interval(table(spark, sf, "orders"), "o_totalprice", by=["o_orderpriority"])
    return R(r.select("o_orderpriority", "n", "mean", "sem"))


@register("proportion_ci", AB_CTE + f""",
g AS (SELECT event_type, COUNT(*) n, SUM(CASE WHEN variant = 'treatment' THEN 1 ELSE 0 END) x FROM ab
      WHERE event_type IS NOT NULL GROUP BY 1),
w AS (SELECT *, x / n p, 1 + {Z975} * {Z975} / n dn FROM g)
SELECT event_type, n, CAST(x AS BIGINT) AS successes, ROUND(p, 6) AS proportion,
       ROUND(GREATEST(0.0, (p + {Z975} * {Z975} / (2.0 * n)) / dn
             - {Z975} * sqrt(p * (1 - p) / n + {Z975} * {Z975} / (4.0 * n * n)) / dn), 6) AS lower_bound,
       ROUND(LEAST(1.0, (p + {Z975} * {Z975} / (2.0 * n)) / dn
             + {Z975} * sqrt(p * (1 - p) / n + {Z975} * {Z975} / (4.0 * n * n)) / dn), 6) AS upper_bound FROM w""")
def q_proportion_ci(spark, sf):
    r = CI.proportion_confidence_interval(ab_events(spark, sf), "variant", "treatment", by=["event_type"])
    return R(r.select("event_type", "n", "successes", "proportion", "lower_bound", "upper_bound"))


from kestrel.operators.stats import dispatch as DS  # noqa: E402
from kestrel.operators.stats import normality as NM  # noqa: E402


@register("ab_test", AB_CTE + """,
g AS (SELECT COUNT(*) FILTER (WHERE variant = 'treatment') na, COUNT(*) FILTER (WHERE variant = 'control') nb,
             COUNT(*) FILTER (WHERE variant = 'treatment' AND conversion = 1) xa,
             COUNT(*) FILTER (WHERE variant = 'control' AND conversion = 1) xb FROM ab WHERE conversion IS NOT NULL),
p AS (SELECT *, xa / na pa, xb / nb pb, (xa + xb) / (na + nb) pp FROM g)
SELECT 'two_proportion_z_test' AS method, na AS n_a, nb AS n_b,
       ROUND((pa - pb) / sqrt(GREATEST(1e-12, pp * (1 - pp) * (1.0 / na + 1.0 / nb))), 6) AS statistic,
       ROUND(pa, 6) AS treatment_mean, ROUND(pb, 6) AS control_mean, ROUND(pa - pb, 6) AS absolute_difference,
       ROUND((pa - pb) / pb, 6) AS relative_lift, ROUND((pa - pb) / pb * 100.0, 6) AS percent_change,
       ROUND(GREATEST(na, nb) / LEAST(na, nb), 6) AS imbalance_ratio FROM p""")
def q_ab_test(spark, sf):
    r = DS.ab_test(ab_events(spark, sf), "variant", "control", "treatment", "conversion")
    return R(r.select("method", "n_a", "n_b", "statistic", "treatment_mean", "control_mean", "absolute_difference",
                      "relative_lift", "percent_change", "imbalance_ratio"))


@register("statistical_test", AB_CTE + """, g AS (SELECT
  COUNT(value) FILTER (WHERE variant = 'treatment') n_a, AVG(value) FILTER (WHERE variant = 'treatment') m_a,
  VAR_SAMP(value) FILTER (WHERE variant = 'treatment') v_a, COUNT(value) FILTER (WHERE variant = 'control') n_b,
  AVG(value) FILTER (WHERE variant = 'control') m_b, VAR_SAMP(value) FILTER (WHERE variant = 'control') v_b FROM ab)
SELECT 'welch_t_test' AS method, 'treatment' AS group_a, 'control' AS group_b, n_a, n_b,
  ROUND((m_a - m_b) / sqrt(v_a / n_a + v_b / n_b), 6) AS statistic,
  ROUND((m_a - m_b) / sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2)), 6) AS effect_size,
  'cohens_d' AS effect_name FROM g""")
def q_statistical_test(spark, sf):
    """Dispatcher on a continuous metric: the selection picks Welch; the SQL
    twin checks the chosen test's numbers."""
    r = DS.statistical_test(ab_events(spark, sf), "variant", "value", "treatment", "control")
    return R(r.select("method", "group_a", "group_b", "n_a", "n_b", "statistic", "effect_size", "effect_name"))


@register("normality", """
WITH v AS (SELECT user_id, CAST(value AS DOUBLE) x FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL),
m AS (SELECT user_id, COUNT(*) n, AVG(x) mu FROM v GROUP BY 1),
c AS (SELECT user_id, n, AVG(POWER(x - mu, 2)) m2, AVG(POWER(x - mu, 3)) m3, AVG(POWER(x - mu, 4)) m4
      FROM v JOIN m USING (user_id) GROUP BY 1, 2),
s AS (SELECT user_id, n, CASE WHEN n >= 3 AND m2 > 0 THEN m3 / POWER(m2, 1.5) END g,
             CASE WHEN n >= 3 AND m2 > 0 THEN m4 / (m2 * m2) - 3 END k FROM c),
j AS (SELECT *, n / 6.0 * (g * g + k * k / 4) jb FROM s)
SELECT user_id, n, CASE WHEN n < 3 THEN 'insufficient' ELSE 'jarque_bera' END AS method, ROUND(jb, 6) AS statistic,
       ROUND(EXP(-jb / 2), 6) AS p_value, ROUND(CASE WHEN n >= 3 THEN g * SQRT(n * (n - 1)) / (n - 2) END, 6) AS skew,
       EXP(-jb / 2) >= 0.05 AS passed FROM j""")
def q_normality(spark, sf):
    """Jarque-Bera per user."""
    return R(NM.normality(table(spark, sf, "events"), "value", by=["user_id"]))


# ------------------------------------------------------------------ OLS

from kestrel.operators.stats import ols as OLS  # noqa: E402

_OLS_CTE = """
WITH s AS (SELECT COUNT(*) n, COVAR_SAMP(l_quantity, l_quantity) s11, COVAR_SAMP(l_discount, l_discount) s22,
  COVAR_SAMP(l_quantity, l_discount) s12, COVAR_SAMP(l_extendedprice, l_quantity) s1y,
  COVAR_SAMP(l_extendedprice, l_discount) s2y, VAR_SAMP(l_extendedprice) syy, AVG(l_extendedprice) my,
  AVG(l_quantity) m1, AVG(l_discount) m2, SUM(l_quantity * l_quantity) g11, SUM(l_discount * l_discount) g22,
  SUM(l_quantity * l_discount) g12, CORR(l_quantity, l_discount) r12 FROM lineitem
  WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL AND l_discount IS NOT NULL),
b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) b1,
                (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) b2 FROM s),
c AS (SELECT *, my - b1 * m1 - b2 * m2 b0, (b1 * s1y + b2 * s2y) / syy r2 FROM b)"""


def _lineitem_fit(spark, sf):
    return OLS.ols_fit(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])


@register("ols_coefficients", _OLS_CTE + """
SELECT 'const' AS term, ROUND(b0, 4) AS coefficient FROM c UNION ALL
SELECT 'l_quantity', ROUND(b1, 4) FROM c UNION ALL SELECT 'l_discount', ROUND(b2, 4) FROM c""")
def q_ols_coefficients(spark, sf):
    r = OLS.ols_coefficients(_lineitem_fit(spark, sf))
    return r.select("term", F.round("coefficient", 4).alias("coefficient"))


@register("ols_fit", _OLS_CTE + """
SELECT n, CAST(3 AS BIGINT) AS k, CAST(3 AS BIGINT) AS rank, ROUND(r2, 8) AS r_squared, ROUND(1 - (1 - r2) * (n - 1) / (n - 3), 8) AS adj_r_squared,
       ROUND((r2 / 2) / ((1 - r2) / (n - 3)), 4) AS f_statistic, 'ok' AS status FROM c""")
def q_ols_fit(spark, sf):
    r = OLS.ols_fit_metrics(_lineitem_fit(spark, sf))
    return r.select("n", "k", "rank", F.round("r_squared", 8).alias("r_squared"),
                    F.round("adj_r_squared", 8).alias("adj_r_squared"), F.round("f_statistic", 4).alias("f_statistic"),
                    "status")


@register("ols_diagnostics", _OLS_CTE + """,
e AS (SELECT l_quantity q, l_discount d, l_extendedprice - (b0 + b1 * l_quantity + b2 * l_discount) e FROM lineitem, c
      WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL AND l_discount IS NOT NULL),
m AS (SELECT COUNT(*) n, AVG(e) me, STDDEV_POP(e) sd FROM e),
k AS (SELECT AVG(pow(e - me, 3)) / pow(AVG(pow(e - me, 2)), 1.5) sk,
             AVG(pow(e - me, 4)) / pow(AVG(pow(e - me, 2)), 2) - 3 ku,
             COUNT(*) FILTER (WHERE abs(e) > 3 * sd) o FROM e, m),
a AS (SELECT COVAR_SAMP(q, q) s11, COVAR_SAMP(d, d) s22, COVAR_SAMP(q, d) s12, COVAR_SAMP(e * e, q) s1y,
             COVAR_SAMP(e * e, d) s2y, VAR_SAMP(e * e) syy FROM e),
ab AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) b2,
              s1y, s2y, syy FROM a)
SELECT m.n, ROUND(sk, 4) AS residual_skew, ROUND(ku, 4) AS residual_kurtosis,
       ROUND(m.n / 6.0 * (sk * sk + ku * ku / 4), 4) AS jarque_bera,
       ROUND(m.n * (b1 * s1y + b2 * s2y) / syy, 4) AS breusch_pagan, o AS residual_outliers FROM m, k, ab""")
def q_ols_diagnostics(spark, sf):
    r = OLS.ols_diagnostics(_lineitem_fit(spark, sf))
    return r.select("n", *[F.round(c, 4).alias(c) for c in ("residual_skew", "residual_kurtosis", "jarque_bera",
                                                            "breusch_pagan")], "residual_outliers")


@register("vif", _OLS_CTE + """
SELECT 'l_quantity' AS term, ROUND(g11 * g22 / (g11 * g22 - g12 * g12), 6) AS vif,
       ROUND(1 / (1 - r12 * r12), 6) AS vif_centered FROM c UNION ALL
SELECT 'l_discount', ROUND(g11 * g22 / (g11 * g22 - g12 * g12), 6), ROUND(1 / (1 - r12 * r12), 6) FROM c""")
def q_vif(spark, sf):
    r = OLS.ols_vif(_lineitem_fit(spark, sf))
    return R(r.select("term", "vif", "vif_centered"))


@register("ols_by_segment", """
WITH s AS (SELECT l_returnflag, COUNT(*) n, COVAR_POP(l_quantity, l_quantity) s11, COVAR_POP(l_discount, l_discount) s22,
  COVAR_POP(l_quantity, l_discount) s12, COVAR_POP(l_extendedprice, l_quantity) s1y,
  COVAR_POP(l_extendedprice, l_discount) s2y, VAR_POP(l_extendedprice) syy, AVG(l_extendedprice) my,
  AVG(l_quantity) m1, AVG(l_discount) m2 FROM lineitem
  WHERE l_returnflag IS NOT NULL AND l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL AND l_discount IS NOT NULL
  GROUP BY 1),
b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) b1,
                (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) b2 FROM s),
c AS (SELECT *, my - b1 * m1 - b2 * m2 b0, (b1 * s1y + b2 * s2y) / syy r2 FROM b)
SELECT l_returnflag, n, 'const' AS term, ROUND(b0, 4) AS coefficient, ROUND(r2, 8) AS r_squared FROM c UNION ALL
SELECT l_returnflag, n, 'l_quantity', ROUND(b1, 4), ROUND(r2, 8) FROM c UNION ALL
SELECT l_returnflag, n, 'l_discount', ROUND(b2, 4), ROUND(r2, 8) FROM c""")
def q_ols_by_segment(spark, sf):
    r = OLS.ols_by_segment(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"],
                           ["l_returnflag"])
    return r.select("l_returnflag", "n", "term", F.round("coefficient", 4).alias("coefficient"),
                    F.round("r_squared", 8).alias("r_squared"))


# ------------------------------------------------------ text audits, ledger

from kestrel.operators import audit as AU  # noqa: E402
from kestrel.operators import ledger as LG  # noqa: E402
from kestrel.operators import review as RV  # noqa: E402


@register("uncited_claims", r"""
WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(COALESCE(text, ''), '\r\n|\n|\r')) raw FROM documents),
c AS (SELECT doc_id, raw, regexp_replace(raw, '^\s+|\s+$', '', 'g') ln FROM l),
bad AS (SELECT doc_id, COUNT(*) n FROM c WHERE ln <> '' AND NOT starts_with(ln, '|') AND NOT starts_with(raw, '## ')
        AND regexp_matches(ln, '(^|[^\p{L}\p{N}_-])[0-9]') AND NOT (contains(ln, '[[EV:') OR contains(ln, '[[EV-'))
        GROUP BY 1)
SELECT d.doc_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_uncited_lines FROM documents d LEFT JOIN bad USING (doc_id)""")
def q_uncited_claims(spark, sf):
    return AU.uncited_claims(table(spark, sf, "documents"), "doc_id", "text")


@register("dangling_refs", r"""
SELECT doc_id, 'unmapped_citation' AS kind, ref FROM
  (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\[([0-9]{1,4})\]', 1))) ref FROM documents)""")
def q_dangling_refs(spark, sf):
    return AU.dangling_refs(table(spark, sf, "documents"), "doc_id", "text")


@register("wording_flags", r"""
SELECT doc_id, s AS significance_wording, p AS has_p_value, ci AS has_ci, e AS has_effect_size, c AS causal_wording,
       CASE WHEN c OR (s AND NOT (p AND ci AND e)) THEN 'fail' ELSE 'pass' END AS verdict FROM (
  SELECT doc_id,
    regexp_matches(COALESCE(text, ''), '(?i)\b(statistically significant|significant improvement|significant lift)\b') s,
    regexp_matches(COALESCE(text, ''), '(?i)\bp-value\b|\bp\s*=\s*\d') p,
    contains(COALESCE(text, ''), '### Confidence Intervals') ci, contains(COALESCE(text, ''), '### Effect Sizes') e,
    regexp_matches(COALESCE(text, ''), '(?i)\b(caused|causes|proved|proves|guarantees|drives growth|causal(?:ly)?)\b') c
  FROM documents)""")
def q_wording_flags(spark, sf):
    return AU.wording_flags(table(spark, sf, "documents"), "doc_id", "text")


# Reports made from the documents' ids, so that every rule fires for some and not for others.
_REPORT = """CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE concat('## 1) Executive Summary\n',
  CASE doc_id % 3 WHEN 0 THEN 'Revenue grew to 89 [1].\n' WHEN 1 THEN 'Revenue grew to 89.\n' ELSE 'Up [[EV:EV-00000000aa]] by 5.\n' END,
  CASE WHEN doc_id % 5 = 0 THEN 'The campaign caused the lift.\n' ELSE '' END,
  CASE WHEN doc_id % 7 = 0 THEN 'Business question: what causes churn?\n' ELSE '' END, '## 5) Analysis Outputs\n',
  CASE WHEN doc_id % 4 = 0 THEN 'A statistically significant lift.\n' ELSE '| table | 7 |\n' END,
  CASE WHEN doc_id % 8 = 0 THEN 'p-value below.\n### Confidence Intervals\n### Effect Sizes\n' ELSE '' END,
  CASE WHEN doc_id % 2 = 0 THEN '### Statistical Questions Evaluated\n' ELSE '' END,
  CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 13 = 0 THEN '## 6) Limitations\nFew.\n'
       ELSE '## 6) Limitations\nFew.\n### Statistical Limitations\n' END,
  '## 8) Evidence References\n', CASE WHEN doc_id % 6 = 3 THEN '' ELSE '| [1] | EV-00000000aa | x |\n' END) END"""


@register("review_reports", """
WITH b AS (SELECT doc_id AS d, doc_id % 17 <> 0 AS f, doc_id % 17 <> 0 AND doc_id % 6 <> 3 AS m, doc_id % 17 <> 0 AND doc_id % 3 = 2 AS t,
    doc_id % 9 <> 0 AS k FROM documents),
s AS (SELECT *, f AND (d % 2 = 0 OR ((m OR t) AND k AND d % 10 = 5)) AS s FROM b),
r AS (SELECT *, list_filter([CASE WHEN NOT f THEN 'empty_report' END, CASE WHEN NOT t AND NOT m THEN 'no_evidence' END,
  CASE WHEN f AND d % 3 = 0 AND NOT m THEN 'unmapped_citations' END, CASE WHEN (t OR m) AND NOT k THEN 'missing_evidence' END,
  CASE WHEN f AND (d % 3 = 1 OR (d % 3 = 0 AND NOT m)) THEN 'uncited_numbers' END, CASE WHEN s AND d % 11 = 0 THEN 'no_limitations' END,
  CASE WHEN s AND (d % 11 = 0 OR d % 13 = 0) THEN 'no_statistical_limitations' END,
  CASE WHEN s AND d % 4 = 0 AND d % 8 <> 0 THEN 'unsupported_significance' END,
  CASE WHEN s AND d % 5 = 0 THEN 'causal_wording' END], lambda x: x IS NOT NULL) AS rules FROM s)
SELECT d AS doc_id, CASE WHEN len(list_filter(rules, lambda x: x NOT IN ('no_evidence', 'no_statistical_limitations'))) > 0 THEN 'fail'
  WHEN len(rules) > 0 THEN 'warn' ELSE 'pass' END AS verdict, array_to_string(rules, ',') AS rules,
  CASE WHEN f AND d % 3 = 0 AND NOT m THEN '1' ELSE '' END AS unmapped, CASE WHEN list_contains(rules, 'uncited_numbers') THEN 1 ELSE 0 END AS n_uncited
FROM r""")
def q_review_reports(spark, sf):
    ids = table(spark, sf, "documents").select("doc_id")
    path = F.when(F.col("doc_id") % 10 == 5, "statistics/t.json").otherwise("tables/x.csv")
    one = F.array(F.struct(F.lit("EV-00000000aa").alias("id"), path.alias("artifact_path")))
    reports = ids.select("doc_id", F.expr(_REPORT).alias("report"),
                         F.when(F.col("doc_id") % 9 != 0, one).otherwise(F.array().cast("array<struct<id:string,artifact_path:string>>")).alias("evidence"))
    r = RV.review_reports(reports, "doc_id", "report", "evidence")
    return r.select("doc_id", "verdict", F.array_join("rules", ",").alias("rules"), F.array_join(F.col("unmapped_citations").cast("array<string>"), ",")
                    .alias("unmapped"), F.size("uncited_lines").alias("n_uncited"))


def _stmt_sql():
    kw = " ".join(f"WHEN regexp_matches(lq, '\\b{k}\\b') THEN '{k}'" for k in AU.SQL_DENY_KEYWORDS)
    return rf"""
WITH s0 AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS stmt_id,
                   regexp_replace(regexp_replace(COALESCE(text, ''), '(?s)/\*.*?\*/', ' ', 'g'), '--[^\n\r]*', ' ', 'g') s
            FROM conversations),
s1 AS (SELECT stmt_id, regexp_replace(regexp_replace(regexp_replace(s, '^\s+|\s+$', '', 'g'), ';+$', ''),
                                      '^\s+|\s+$', '', 'g') q FROM s0),
s2 AS (SELECT stmt_id, q, lower(q) lq FROM s1),
s3 AS (SELECT stmt_id, q, lq, CASE {kw} END kw FROM s2),
s4 AS (SELECT stmt_id, kw, CASE WHEN q = '' THEN 'empty' WHEN contains(q, ';') THEN 'multiple_statements'
    WHEN NOT (starts_with(lq, 'select') OR starts_with(lq, 'with ')) THEN 'not_select'
    WHEN kw IS NOT NULL THEN 'denied_keyword' WHEN regexp_matches(lq, '\bfor\s+update\b') THEN 'for_update'
    WHEN regexp_matches(lq, '\bselect\b[\s\S]*\binto\b') THEN 'select_into' END rule FROM s3)
SELECT stmt_id, CASE WHEN rule IS NULL THEN 'accepted' ELSE 'refused' END AS verdict, rule,
       CASE WHEN rule = 'denied_keyword' THEN kw END AS keyword FROM s4"""


@register("statement_audit", _stmt_sql())
def q_statement_audit(spark, sf):
    c = table(spark, sf, "conversations")
    stmts = c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("stmt_id"),
                     "text")
    return AU.statement_audit(stmts, "stmt_id", "text")


def _redact_sql():
    t = "COALESCE(text, '')"
    expr = t
    hits = []
    for name, pat, rep in AU.REDACTIONS:
        expr = f"regexp_replace({expr}, '{pat}', '{rep.replace('$1', chr(92) + '1')}', 'gi')"
        hits.append(f"CAST(len(regexp_extract_all({t}, '(?i){pat}', 0)) AS INTEGER) AS hits_{name}")
    return f"SELECT doc_id, {expr} AS redacted, {', '.join(hits)} FROM documents"


@register("redact_text", _redact_sql())
def q_redact_text(spark, sf):
    return AU.redact_text(table(spark, sf, "documents"), "doc_id", "text")


_STATUS_SQL = """CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running'
  WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END"""


def _ledger_events(spark, sf):
    e = table(spark, sf, "events")
    status = (F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type").isin("view", "click"), "running")
              .when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed"))
    return e.select(F.col("user_id").alias("run_id"), "ts", "event_id", status.alias("status"),
                    F.col("props").alias("error_message"))


@register("run_transitions", f"""
WITH e AS (SELECT user_id AS run_id, ts, event_id, {_STATUS_SQL} AS to_status FROM events),
l AS (SELECT *, LAG(to_status) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS from_status FROM e),
a AS (SELECT * FROM (VALUES ('queued','queued'), ('queued','running'), ('queued','completed'), ('queued','failed'),
      ('running','running'), ('running','completed'), ('running','failed'), ('completed','completed'),
      ('failed','failed')) v(f, t))
SELECT run_id, ts, event_id, from_status, to_status, (a.f IS NOT NULL) AS allowed
FROM l LEFT JOIN a ON a.f = l.from_status AND a.t = l.to_status WHERE from_status IS NOT NULL""")
def q_run_transitions(spark, sf):
    return LG.run_transitions(_ledger_events(spark, sf), "run_id", "ts", "status", tiebreak="event_id")


@register("run_state", f"""
WITH e AS (SELECT user_id AS run_id, ts, {_STATUS_SQL} AS status, props AS error_message FROM events)
SELECT run_id, arg_max(status, ts) AS status, MIN(ts) FILTER (WHERE status = 'running') AS started_at,
       MIN(ts) FILTER (WHERE status IN ('completed', 'failed')) AS completed_at, COUNT(*) AS n_events,
       arg_max(error_message, ts) FILTER (WHERE status = 'failed') AS last_error FROM e GROUP BY run_id""")
def q_run_state(spark, sf):
    return LG.run_state(_ledger_events(spark, sf), "run_id", "ts", "status", "error_message", tiebreak="event_id")


@register("artifact_upsert", """
SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, MAX(ts) AS ts, arg_max(value, ts) AS value,
       arg_max(props, ts) AS props, COUNT(*) AS n_writes FROM events GROUP BY 1, 2""")
def q_artifact_upsert(spark, sf):
    return LG.artifact_upsert(table(spark, sf, "events"), "user_id", "event_type", "ts", tiebreak="event_id")


_PATHS = [("charts/a{}.svg", "chart"), ("x/qa_{}.png", "chart"), ("x/q_{}.png", "artifact"), ("run{}/Final_Report.md", "markdown_report"),
          ("run{}/cleaned.csv", "cleaned_csv"), ("run{}/data_profile.json", "profile_json"), ("run{}/quality_report.json", "validation_json"),
          ("q{}.SQL", "sql_query"), ("d{}.json", "json"), ("t{}.csv", "csv"), ("n{}.md", "markdown"), ("l{}.txt", "text"), ("m{}/charts/x", "artifact")]


@register("artifact_types", "SELECT page_id, CASE page_id % 13 " + " ".join(
    f"WHEN {i} THEN replace('{p}', '{{}}', page_id::VARCHAR)" for i, (p, _) in enumerate(_PATHS)) + " END AS path, CASE page_id % 13 " + " ".join(
    f"WHEN {i} THEN '{t}'" for i, (_, t) in enumerate(_PATHS)) + " END AS artifact_type FROM pages")
def q_artifact_types(spark, sf):
    """LG4 on paths made from the pages' ids."""
    p = table(spark, sf, "pages")
    path = F.replace(F.element_at(F.array(*[F.lit(x) for x, _ in _PATHS]), (F.col("page_id") % 13 + 1).cast("int")), F.lit("{}"),
                     F.col("page_id").cast("string"))
    return p.select("page_id", path.alias("path")).select("page_id", "path", LG.artifact_type(F.col("path")).alias("artifact_type"))


def _metadata(kind):
    """An event's JSON, as text both engines build alike: a key that all
    write, one of its kind, one of three nested ones."""
    text = """concat('{"step":', ID, ',"by_type":{"', event_type, '":', ID, '},"slot', SLOT, '":{"id":', ID, ',"ok":true}}')"""
    return text.replace("ID", f"CAST(event_id AS {kind})").replace("SLOT", f"CAST(event_id % 3 AS {kind})")


@register("run_metadata", """
WITH m AS (SELECT user_id, ts, event_id, METADATA AS j FROM events),
e AS (SELECT user_id, ts, event_id, key, json_extract(j, '$.' || key)::VARCHAR AS value FROM (SELECT *, unnest(json_keys(j)) AS key FROM m))
SELECT user_id, key, value FROM e QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY ts DESC, event_id DESC) = 1""".replace("METADATA", _metadata("VARCHAR")))
def q_run_metadata(spark, sf):
    e = table(spark, sf, "events").withColumn("meta", F.expr(_metadata("STRING")))
    return LG.run_metadata(e, "user_id", "ts", "meta", "event_id")


@register("run_metadata_deep", """
WITH p AS (SELECT user_id, ts, event_id, unnest([['step', event_id::VARCHAR], ['by_type.' || event_type, event_id::VARCHAR],
    ['slot' || (event_id % 3)::VARCHAR || '.id', event_id::VARCHAR], ['slot' || (event_id % 3)::VARCHAR || '.ok', 'true']]) AS x FROM events)
SELECT user_id, x[1] AS key, x[2] AS value FROM p QUALIFY row_number() OVER (PARTITION BY user_id, x[1] ORDER BY ts DESC, event_id DESC) = 1""")
def q_run_metadata_deep(spark, sf):
    e = table(spark, sf, "events").withColumn("meta", F.expr(_metadata("STRING")))
    return LG.run_metadata(e, "user_id", "ts", "meta", "event_id", deep=True)


@register("run_details", f"""
WITH r AS (SELECT user_id, arg_max({_STATUS_SQL}, ts) AS status, count(*) AS n_events FROM events WHERE user_id % 4 <> 0 GROUP BY 1),
a AS (SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, count(*) AS n_writes FROM events WHERE user_id % 3 <> 0 GROUP BY 1, 2)
SELECT r.user_id, r.status, r.n_events, a.event_type, a.event_id, a.n_writes FROM r LEFT JOIN a USING (user_id)""")
def q_run_details(spark, sf):
    """LG5: each user's events as a run and its latest writes as artifacts;
    some users have no artifacts, some artifacts no run."""
    ev = _ledger_events(spark, sf).where("run_id % 4 <> 0")
    runs = LG.run_state(ev, "run_id", "ts", "status", tiebreak="event_id").select(F.col("run_id").alias("user_id"), "status", "n_events")
    arts = LG.artifact_upsert(table(spark, sf, "events").where("user_id % 3 <> 0"), "user_id", "event_type", "ts", "event_id")
    return LG.run_details(runs, arts.select("user_id", "event_type", "event_id", "n_writes"), "user_id")


@register("run_listing", """
SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 20""")
def q_run_listing(spark, sf):
    return LG.run_listing(table(spark, sf, "orders"), "o_orderpriority", "1-URGENT", "o_orderdate", limit=20,
                          offset=20, tiebreak="o_orderkey")


# --------------------------------------------------- charts, sources, suites

from kestrel.operators import charts as CH  # noqa: E402
from kestrel.plans import suite as SU  # noqa: E402
from kestrel.sources import files as SRC  # noqa: E402


@register("histogram", """
WITH s AS (SELECT MIN(o_totalprice) lo, MAX(o_totalprice) hi FROM orders WHERE o_totalprice IS NOT NULL),
c AS (SELECT CAST(CASE WHEN (hi - lo) / 10 > 0 THEN LEAST(FLOOR((o_totalprice - lo) / ((hi - lo) / 10)), 9) ELSE 0 END
                  AS INTEGER) bin, COUNT(*) n FROM orders, s WHERE o_totalprice IS NOT NULL GROUP BY 1),
g AS (SELECT CAST(unnest(generate_series(0, 9)) AS INTEGER) bin, lo, hi FROM s)
SELECT 'o_totalprice' AS "column", bin, ROUND(lo + bin * (hi - lo) / 10, 6) AS lower,
       ROUND(lo + (bin + 1) * (hi - lo) / 10, 6) AS upper, COALESCE(n, 0) AS count FROM g LEFT JOIN c USING (bin)""")
def q_histogram(spark, sf):
    return R(CH.histogram(table(spark, sf, "orders"), "o_totalprice", 10))


@register("top_categories", """
WITH c AS (SELECT CAST(c_mktsegment AS VARCHAR) value, COUNT(*) count FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1)
SELECT 'c_mktsegment' AS "column", value, count FROM c WHERE (SELECT COUNT(*) FROM c) >= 2""")
def q_top_categories(spark, sf):
    return CH.top_categories(table(spark, sf, "customer"), "c_mktsegment")


@register("heatmap_cells", SALES_CTE + """,
b AS (SELECT CAST(country AS VARCHAR) x, CAST(product_category AS VARCHAR) y, revenue m FROM sales
      WHERE country IS NOT NULL AND product_category IS NOT NULL),
xs AS (SELECT DISTINCT x FROM b), ys AS (SELECT DISTINCT y FROM b),
c AS (SELECT x, y, CAST(COALESCE(SUM(m), 0) AS DOUBLE) v FROM b WHERE x IN (SELECT x FROM xs) AND y IN (SELECT y FROM ys)
      GROUP BY 1, 2)
SELECT xs.x, ys.y, ROUND(COALESCE(c.v, 0.0), 6) AS value FROM xs CROSS JOIN ys LEFT JOIN c ON c.x = xs.x AND c.y = ys.y""")
def q_heatmap_cells(spark, sf):
    return R(CH.heatmap_cells(sales(spark, sf, columns=["country", "product_category", "revenue"]), "country", "product_category", "revenue", "sum"))


@register("schema_inventory", """
WITH c AS (SELECT * FROM (VALUES ('orders', 0, 'o_orderkey'), ('orders', 1, 'o_custkey'), ('orders', 2, 'o_orderstatus'),
  ('orders', 3, 'o_totalprice'), ('orders', 4, 'o_orderdate'), ('orders', 5, 'o_orderpriority'),
  ('customer', 0, 'c_custkey'), ('customer', 1, 'c_name'), ('customer', 2, 'c_nationkey'), ('customer', 3, 'c_acctbal'),
  ('customer', 4, 'c_mktsegment')) v("table", position, "column")),
n AS (SELECT 'orders' AS "table", COUNT(*) AS n_rows FROM orders UNION ALL SELECT 'customer', COUNT(*) FROM customer)
SELECT "table", CAST(position AS INTEGER) AS position, "column",
       CASE WHEN "table" = 'orders' AND "column" = 'o_custkey' THEN 'customer.c_custkey' END AS "references", n_rows
FROM c JOIN n USING ("table")""")
def q_schema_inventory(spark, sf):
    t = {"orders": table(spark, sf, "orders"), "customer": table(spark, sf, "customer")}
    r = SRC.schema_inventory(t, [("orders", ["o_custkey"], "customer", ["c_custkey"])])
    return r.select("table", "position", "column", "references", "n_rows")


@register("sql_query_mapping", """
SELECT CAST(o_orderpriority AS VARCHAR) AS key, CAST(COUNT(*) AS DOUBLE) AS value FROM orders GROUP BY 1""")
def q_sql_query_mapping(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return SRC.sql_query(spark, "-- volume per priority\nSELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1;",
                         output="mapping")


def _suite_sql():
    s = SALES_CTE
    parts = [
        "SELECT 'D1' task_id, 'groupby_agg' type, CAST(country AS VARCHAR) key, 'value' metric, "
        "CAST(COUNT(revenue) AS DOUBLE) v FROM sales WHERE country IS NOT NULL GROUP BY country",
        "SELECT 'D2', 'groupby_agg', country, 'value', CAST(AVG(revenue) AS DOUBLE) FROM sales "
        "WHERE country IS NOT NULL GROUP BY country",
        "SELECT 'D3', 'groupby2_agg', country || '|' || segment, 'value', CAST(AVG(revenue) AS DOUBLE) FROM sales "
        "WHERE country IS NOT NULL AND segment IS NOT NULL GROUP BY country, segment",
        "SELECT 'D4', 'groupby2_agg', country || '|' || segment, 'value', CAST(COUNT(revenue) AS DOUBLE) FROM sales "
        "WHERE country IS NOT NULL AND segment IS NOT NULL GROUP BY country, segment",
    ]
    for i, d in ((5, "quantity"), (6, "discount_pct")):
        parts.append(f"SELECT 'D{i}', 'correlation', '{d}|revenue|computed', 'n', CAST(COUNT(*) AS DOUBLE) FROM sales "
                     f"WHERE {d} IS NOT NULL AND revenue IS NOT NULL")
        parts.append(f"SELECT 'D{i}', 'correlation', '{d}|revenue|computed', 'r', "
                     f"CORR(CAST({d} AS DOUBLE), CAST(revenue AS DOUBLE)) FROM sales")
    parts.append("""SELECT 'D7', 'timeseries_agg', CAST(CAST(last_day(b.m) AS TIMESTAMP) AS VARCHAR), 'value',
        CAST(COALESCE(v, 0) AS DOUBLE) FROM (SELECT CAST(unnest(generate_series((SELECT MIN(m) FROM ts),
        (SELECT MAX(m) FROM ts), INTERVAL 1 MONTH)) AS DATE) m) b LEFT JOIN ts USING (m)""")
    for met, expr in (("value", "v"), ("share_pct", "v / SUM(v) OVER ()"), ("share_of_total", "v / SUM(v) OVER ()")):
        parts.append(f"SELECT 'D8', 'segment_analysis', k, '{met}', {expr} FROM seg")
    gd = [("n_groups", "CAST(COUNT(v) AS DOUBLE)"), ("q0_5", "quantile_cont(v, 0.5)"),
          ("q0_75", "quantile_cont(v, 0.75)"), ("q0_9", "quantile_cont(v, 0.9)"), ("q0_95", "quantile_cont(v, 0.95)"),
          ("q0_99", "quantile_cont(v, 0.99)"), ("max_group_value", "MAX(v)"), ("min_group_value", "MIN(v)"),
          ("mean_group_value", "AVG(v)")]
    for met, expr in gd:
        parts.append(f"SELECT 'D9', 'group_distribution', 'country|revenue|sum', '{met}', {expr} FROM gsum")
    parts.append("""SELECT 'D10', 'recency_by_group', country || '|' || CAST(last_date AS VARCHAR) || '|' ||
        CAST(ref AS VARCHAR), 'recency_days', CAST(floor(date_diff('second', last_date, ref) / 86400.0) AS DOUBLE)
        FROM (SELECT country, MAX(order_date) last_date FROM sales WHERE country IS NOT NULL AND order_date IS NOT NULL
        GROUP BY 1), (SELECT MAX(order_date) ref FROM sales WHERE country IS NOT NULL)""")
    ctes = s + """,
ts AS (SELECT CAST(date_trunc('month', order_date) AS DATE) m, SUM(revenue) v FROM sales
       WHERE order_date IS NOT NULL AND revenue IS NOT NULL GROUP BY 1),
seg AS (SELECT CAST(country AS VARCHAR) k, CAST(AVG(revenue) AS DOUBLE) v FROM sales WHERE country IS NOT NULL GROUP BY 1),
gsum AS (SELECT country, CAST(SUM(revenue) AS DOUBLE) v FROM sales WHERE country IS NOT NULL GROUP BY 1)"""
    body = "\nUNION ALL\n".join(parts)
    return (ctes + f"\nSELECT task_id, type, key, metric, ROUND(v, 6) AS value, 'computed' AS status, "
            f"CAST(NULL AS VARCHAR) AS reason FROM ({body}) u(task_id, type, key, metric, v)")


_DRIVER_ARGS = dict(metric="revenue", dim="country", dim2="segment", drivers=["quantity", "discount_pct"],
                    date_col="order_date")


@register("driver_suite", _suite_sql())
def q_driver_suite(spark, sf):
    return R(SU.driver_suite(sales(spark, sf, columns=["order_date", "country", "segment", "quantity", "discount_pct", "revenue"]), **_DRIVER_ARGS))


@register("metric_suite", SALES_CTE + """
SELECT 'T1' AS task_id, 'groupby_agg' AS type, region AS key, 'value' AS metric,
       ROUND(CAST(SUM(revenue) AS DOUBLE), 6) AS value, 'computed' AS status, CAST(NULL AS VARCHAR) AS reason
FROM sales WHERE region IS NOT NULL GROUP BY region
UNION ALL SELECT 'T2', 'filter_agg', 'segment|AUTOMOBILE', 'value', ROUND(CAST(SUM(quantity) AS DOUBLE), 6), 'computed',
       NULL FROM sales WHERE segment = 'AUTOMOBILE'
UNION ALL SELECT 'T3', 'groupby_agg', '', '', NULL, 'failed', 'ColumnError: column(s) not found: no_such_column'""")
def q_metric_suite(spark, sf):
    tasks = [{"id": "T1", "type": "groupby_agg", "params": {"group_by": "region", "metric": "revenue", "limit": 0}},
             {"id": "T2", "type": "filter_agg",
              "params": {"filter_col": "segment", "filter_val": "AUTOMOBILE", "metric": "quantity"}},
             {"id": "T3", "type": "groupby_agg", "params": {"group_by": "no_such_column", "metric": "revenue"}},
             {"id": "T4", "type": "groupby_agg", "params": {"group_by": "region", "metric": "revenue", "limit": 0}}]
    return R(SU.run_suite(sales(spark, sf), tasks))


# ------------------------------------------------------------- streaming

from kestrel.streaming import incremental as STR  # noqa: E402


@register("stream_event_windows", """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type,
       COUNT(*) AS n, ROUND(SUM(value), 6) AS total, ROUND(AVG(value), 6) AS mean, ROUND(MIN(value), 6) AS min,
       ROUND(MAX(value), 6) AS max FROM events GROUP BY 1, 2, 3""")
def q_stream_event_windows(spark, sf):
    s = STR.read_parquet_stream(spark, f"{sf.rstrip('/')}/events.parquet")
    agg = STR.windowed_aggregates(s, "ts", "value", "1 hour", "1 hour", by=["event_type"])
    out = STR.run_versioned(agg, "event-windows", ["window_start", "window_end", "event_type"])
    return R(out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                        F.col("window_end").cast("timestamp_ntz").alias("window_end"),
                        "event_type", "n", "total", "mean", "min", "max"))


@register("stream_run_transitions", ORACLES["run_transitions"])
def q_stream_run_transitions(spark, sf):
    s = STR.read_parquet_stream(spark, f"{sf.rstrip('/')}/events.parquet")
    status = (F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type").isin("view", "click"), "running")
              .when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed"))
    ev = s.select(F.col("user_id").alias("run_id"), "ts", "event_id", status.alias("status"))
    t = STR.ledger_transitions_stream(ev, "run_id", "ts", "status", "event_id")
    return STR.run_append(t, "run-transitions")


from kestrel.operators.stats import assumptions as AS  # noqa: E402


@register("assumption_checks")
def q_assumption_checks(spark, sf):
    """Checks of treatment vs control on events.value per event type."""
    return AS.two_group_checks(ab_events(spark, sf), "variant", "value", "treatment", "control", by=["event_type"])


@register("failure_summary")
def q_failure_summary(spark, sf):
    chk = AS.two_group_checks(ab_events(spark, sf), "variant", "value", "treatment", "control", by=["event_type"])
    return AS.failure_summary(chk, ["event_type"])


@register("adjusted_pvalues")
def q_adjusted_pvalues(spark, sf):
    """Holm-adjusted Welch p-values of one test per user (rows-only: DuckDB
    has no t distribution)."""
    r = HT.welch_t_test(ab_events(spark, sf), "event_type", "value", "purchase", "view", by=["user_id"])
    return AS.adjust_pvalues(r.select("user_id", "statistic", "p_value"), "p_value", "holm")


@register("top_pair", SALES_CTE + """
SELECT region, segment, ROUND(CAST(SUM(revenue) AS DOUBLE), 6) AS value FROM sales
WHERE region IS NOT NULL AND segment IS NOT NULL GROUP BY 1, 2 ORDER BY value DESC, region, segment LIMIT 1""")
def q_top_pair(spark, sf):
    return R(RK.top_pair(sales(spark, sf, columns=["region", "segment", "revenue"]), "region", "segment", "revenue"))


@register("bar_data", SALES_CTE + """
SELECT CAST(product_category AS VARCHAR) AS label, ROUND(CAST(SUM(revenue) AS DOUBLE), 6) AS value FROM sales
WHERE product_category IS NOT NULL GROUP BY 1""")
def q_bar_data(spark, sf):
    g = A.groupby_agg(sales(spark, sf, columns=["product_category", "revenue"]), "product_category", "revenue", "sum", limit=0)
    return R(CH.bar_data(g, "product_category", "value"))


@register("line_data", """
SELECT CAST(CAST(date_trunc('week', l_shipdate) AS DATE) + 6 AS TIMESTAMP) AS x, ROUND(AVG(l_quantity), 6) AS y
FROM lineitem WHERE l_shipdate IS NOT NULL AND l_quantity IS NOT NULL GROUP BY 1""")
def q_line_data(spark, sf):
    return R(CH.line_data(TS.timeseries_agg(table(spark, sf, "lineitem"), "l_shipdate", "l_quantity", "W", "mean")))


@register("stream_missingness", """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
       COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE event_id IS NULL) AS missing_event_id,
       COUNT(*) FILTER (WHERE user_id IS NULL) AS missing_user_id,
       COUNT(*) FILTER (WHERE event_type IS NULL) AS missing_event_type,
       COUNT(*) FILTER (WHERE value IS NULL OR isnan(value)) AS missing_value,
       COUNT(*) FILTER (WHERE props IS NULL) AS missing_props FROM events GROUP BY 1, 2""")
def q_stream_missingness(spark, sf):
    s = STR.read_parquet_stream(spark, f"{sf.rstrip('/')}/events.parquet")
    agg = STR.windowed_missingness(s, "ts", "1 hour", "1 hour")
    out = STR.run_versioned(agg, "missingness", ["window_start", "window_end"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"),
                      *[c for c in out.columns if c not in ("window_start", "window_end")])


@register("stream_run_state", ORACLES["run_state"])
def q_stream_run_state(spark, sf):
    s = STR.read_parquet_stream(spark, f"{sf.rstrip('/')}/events.parquet")
    status = (F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type").isin("view", "click"), "running")
              .when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed"))
    ev = s.select(F.col("user_id").alias("run_id"), "ts", status.alias("status"), F.col("props").alias("error_message"))
    st = STR.run_state_stream(ev, "run_id", "ts", "status", "error_message")
    return STR.run_versioned(st, "run-state", ["run_id"])


@register("csv_roundtrip", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders""")
def q_csv_roundtrip(spark, sf):
    """SNK1 + SRC1: orders written as CSV to the shared checkpoint folder and
    read back with validation and type inference."""
    path = STR.stream_folder(spark, "csv-orders")
    SRC.write_results(table(spark, sf, "orders"), path, fmt="csv")
    df = SRC.read_csv(spark, path)
    return df.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"),
                     F.col("o_custkey").cast("bigint").alias("o_custkey"), "o_orderstatus",
                     F.col("o_totalprice").cast("double").alias("o_totalprice"),
                     F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_orderpriority")


@register("having_filter", SALES_CTE + """
SELECT customer_id, ROUND(CAST(SUM(revenue) AS DOUBLE), 6) AS value FROM sales WHERE customer_id IS NOT NULL
GROUP BY 1 HAVING SUM(revenue) > 1000000""")
def q_having_filter(spark, sf):
    """AG14: a condition on the aggregate is a filter on the grouped result."""
    g = A.groupby_agg(sales(spark, sf, columns=["customer_id", "revenue"]), "customer_id", "revenue", "sum", limit=0)
    return R(g.where(F.col("value") > 1000000))


@register("welch_vs_rest", """
WITH g AS (SELECT COUNT(value) FILTER (WHERE event_type = 'purchase') n_a, AVG(value) FILTER (WHERE event_type = 'purchase') m_a,
  VAR_SAMP(value) FILTER (WHERE event_type = 'purchase') v_a, COUNT(value) FILTER (WHERE event_type <> 'purchase') n_b,
  AVG(value) FILTER (WHERE event_type <> 'purchase') m_b, VAR_SAMP(value) FILTER (WHERE event_type <> 'purchase') v_b
  FROM events WHERE event_type IS NOT NULL)
SELECT 'purchase' AS group_a, 'rest' AS group_b, n_a, n_b, ROUND(m_a, 6) AS mean_a, ROUND(m_b, 6) AS mean_b,
  ROUND(m_a - m_b, 6) AS mean_difference, ROUND((m_a - m_b) / sqrt(v_a / n_a + v_b / n_b), 6) AS statistic,
  ROUND(pow(v_a / n_a + v_b / n_b, 2) / (pow(v_a / n_a, 2) / (n_a - 1) + pow(v_b / n_b, 2) / (n_b - 1)), 6) AS df,
  ROUND((m_a - m_b) / sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2)), 6) AS cohens_d FROM g""")
def q_welch_vs_rest(spark, sf):
    r = HT.welch_t_test(table(spark, sf, "events"), "event_type", "value", "purchase", compare_to_rest=True)
    return R(r.select(*_WELCH_COLS))


@register("cohort_weekly_events", """
WITH e AS (SELECT DISTINCT user_id, CAST(date_trunc('week', ts) AS DATE) p FROM events
           WHERE user_id IS NOT NULL AND ts IS NOT NULL),
x AS (SELECT *, MIN(p) OVER (PARTITION BY user_id) c FROM e),
g AS (SELECT c, CAST((p - c) / 7 AS INTEGER) n, COUNT(*) a FROM x GROUP BY 1, 2),
s AS (SELECT c, MAX(a) FILTER (WHERE n = 0) sz FROM g GROUP BY c)
SELECT strftime(g.c, '%Y-%m-%d') || '/' || strftime(g.c + 6, '%Y-%m-%d') AS cohort_period, n AS period_number,
       a AS active_entities, sz AS cohort_size, ROUND(a / sz, 6) AS retention_rate FROM g JOIN s USING (c)""")
def q_cohort_weekly_events(spark, sf):
    return R(C.cohort_long(table(spark, sf, "events"), "user_id", "ts", "W"))


@register("timeseries_hourly_count", """
WITH g AS (SELECT date_trunc('hour', ts) h, COUNT(value) v FROM events
           WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1),
b AS (SELECT unnest(generate_series((SELECT MIN(h) FROM g), (SELECT MAX(h) FROM g), INTERVAL 1 HOUR)) h)
SELECT b.h AS period, CAST(COALESCE(v, 0) AS DOUBLE) AS value FROM b LEFT JOIN g USING (h)""")
def q_timeseries_hourly_count(spark, sf):
    return TS.timeseries_agg(table(spark, sf, "events"), "ts", "value", "H", "count")


@register("kpi_ops", SALES_CTE + """
SELECT CAST(NULL AS DOUBLE) AS ticket_count, CAST(NULL AS DOUBLE) AS avg_resolution_time,
       ROUND(CAST(COALESCE(SUM(quantity), 0) AS DOUBLE), 6) AS throughput, region FROM sales
WHERE region IS NOT NULL GROUP BY region""")
def q_kpi_ops(spark, sf):
    return R(K.kpi_template_apply(sales(spark, sf), "ops", by=["region"]))


@register("kpi_segment_sample", SALES_CTE + """,
g AS (SELECT country k, CAST(SUM(revenue) AS DOUBLE) v FROM sales WHERE country IS NOT NULL GROUP BY 1),
kept AS (SELECT * FROM g)
SELECT k AS segment, ROUND(v, 6) AS value, ROUND(v / SUM(v) OVER (), 6) AS share_pct,
       ROUND(v / (SELECT SUM(v) FROM g), 6) AS share_of_total FROM kept""")
def q_kpi_segment_sample(spark, sf):
    """K1's segment view: first numeric resolved KPI column (revenue) by the
    first present segment candidate (country), sum, all segments."""
    return R(K.kpi_segment_sample(sales(spark, sf), "ecommerce"))


@register("stream_daily_kpis", SALES_CTE + """
SELECT CAST(date_trunc('day', order_date) AS TIMESTAMP) AS window_start,
       CAST(date_trunc('day', order_date) + INTERVAL 1 DAY AS TIMESTAMP) AS window_end, region,
       ROUND(CAST(COALESCE(SUM(revenue), 0) AS DOUBLE), 6) AS total_revenue, CAST(COUNT(order_id) AS DOUBLE) AS order_count,
       ROUND(CAST(COALESCE(SUM(quantity), 0) AS DOUBLE), 6) AS units_sold, ROUND(AVG(discount_pct), 6) AS avg_discount_pct,
       CAST(SUM(revenue) AS DOUBLE) / COUNT(order_id) AS avg_order_value
FROM sales WHERE region IS NOT NULL GROUP BY 1, 2, 3""")
def q_stream_daily_kpis(spark, sf):
    """K1 per day and region on a lineitem stream joined to static
    dimension tables."""
    li = STR.read_parquet_stream(spark, f"{sf.rstrip('/')}/lineitem.parquet")
    k = STR.windowed_kpis(sales(spark, sf, lineitem=li), "order_date", "ecommerce", "1 day", "30 days",
                          by=["region"])
    out = STR.run_versioned(k, "daily-kpis", ["window_start", "window_end", "region"])
    return R(out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                        F.col("window_end").cast("timestamp_ntz").alias("window_end"),
                        *[c for c in out.columns if c not in ("window_start", "window_end")]),
             skip=("avg_order_value",))

from kestrel.plans import inference_queries, temporal_queries  # noqa: E402,F401
