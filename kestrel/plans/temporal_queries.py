"""Registered queries of the operators on time, discovery and drift: as-of
and interval joins, ordered streams, keys and inclusions, distribution
distances, forecasts, anomalies, absorbed regressions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from kestrel.operators import anomaly as AN
from kestrel.operators import discovery as DI
from kestrel.operators import drift as DR
from kestrel.operators import forecast as FC
from kestrel.operators import temporal as TM
from kestrel.operators.stats import ols as OL
from kestrel.plans.registry import ORACLES, _ledger_events, register
from kestrel.sources import files as SRC
from kestrel.sources.tables import table
from kestrel.streaming import ledger as SL


def _events(spark, sf, kind, **names):
    e = table(spark, sf, "events").where(F.col("event_type") == kind)
    return e.select(*[F.col(c).alias(n) for c, n in names.items()])


# ------------------------------------------------------- as-of and intervals

@register("as_of_last_view", """
SELECT p.event_id, p.user_id, p.ts, v.ts AS view_ts, v.event_id AS view_id, v.value AS view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def q_as_of_last_view(spark, sf):
    p = _events(spark, sf, "purchase", event_id="event_id", user_id="user_id", ts="ts")
    v = _events(spark, sf, "view", user_id="user_id", ts="view_ts", event_id="view_id", value="view_value")
    return TM.as_of_join(p, v, ["user_id"], "ts", "view_ts", ["view_id", "view_value"])


@register("as_of_next_purchase", """
WITH j AS (SELECT c.event_id, c.user_id, c.ts, p.ts AS purchase_ts, p.event_id AS purchase_id
  FROM (SELECT * FROM events WHERE event_type = 'click') c
  ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts < p.ts)
SELECT event_id, user_id, ts, CASE WHEN purchase_ts - ts <= INTERVAL 12 HOUR THEN purchase_ts END AS purchase_ts,
       CASE WHEN purchase_ts - ts <= INTERVAL 12 HOUR THEN purchase_id END AS purchase_id FROM j""")
def q_as_of_next_purchase(spark, sf):
    c = _events(spark, sf, "click", event_id="event_id", user_id="user_id", ts="ts")
    p = _events(spark, sf, "purchase", user_id="user_id", ts="purchase_ts", event_id="purchase_id")
    return TM.as_of_join(c, p, ["user_id"], "ts", "purchase_ts", ["purchase_id"], "forward", "INTERVAL 12 HOUR", exact=False)


@register("as_of_nearest_error", """
WITH a AS (SELECT * FROM events WHERE event_type = 'signup'), e AS (SELECT * FROM events WHERE event_type = 'error'),
b AS (SELECT a.event_id, e.ts, e.event_id AS id FROM a ASOF LEFT JOIN e ON a.user_id = e.user_id AND a.ts >= e.ts),
f AS (SELECT a.event_id, e.ts, e.event_id AS id FROM a ASOF LEFT JOIN e ON a.user_id = e.user_id AND a.ts <= e.ts)
SELECT a.event_id, a.user_id, a.ts,
  CASE WHEN b.ts IS NULL OR f.ts - a.ts < a.ts - b.ts THEN coalesce(f.ts, b.ts) ELSE b.ts END AS error_ts,
  CASE WHEN b.ts IS NULL OR f.ts - a.ts < a.ts - b.ts THEN coalesce(f.id, b.id) ELSE b.id END AS error_id
FROM a JOIN b ON a.event_id = b.event_id JOIN f ON a.event_id = f.event_id""")
def q_as_of_nearest_error(spark, sf):
    a = _events(spark, sf, "signup", event_id="event_id", user_id="user_id", ts="ts")
    e = _events(spark, sf, "error", user_id="user_id", ts="error_ts", event_id="error_id")
    return TM.as_of_join(a, e, ["user_id"], "ts", "error_ts", ["error_id"], "nearest")


@register("interval_events_after_error", """
SELECT p.event_id, p.user_id, p.event_type, p.ts, e.event_id AS error_id
FROM events p JOIN events e ON e.event_type = 'error' AND p.user_id = e.user_id
AND p.ts >= e.ts AND p.ts < e.ts + INTERVAL 6 HOUR""")
def q_interval_events_after_error(spark, sf):
    e = _events(spark, sf, "error", event_id="error_id", user_id="user_id", ts="start")
    e = e.withColumn("stop", F.col("start") + F.expr("INTERVAL 6 HOURS"))
    p = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return TM.interval_join(p, e, ["user_id"], "ts", "start", "stop").select("event_id", "user_id", "event_type", "ts", "error_id")


@register("interval_overlaps", """
WITH a AS (SELECT event_id, user_id, ts AS s, ts + INTERVAL 2 DAY AS e FROM events WHERE event_type = 'signup'),
b AS (SELECT event_id, user_id, ts AS s, ts + INTERVAL 5 HOUR AS e FROM events WHERE event_type = 'error')
SELECT a.event_id AS signup_id, b.event_id AS error_id, a.user_id FROM a JOIN b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e""")
def q_interval_overlaps(spark, sf):
    a, b = (_events(spark, sf, k, event_id="event_id", user_id="user_id", ts="s").withColumn("e", F.col("s") + F.expr(f"INTERVAL {d}"))
            for k, d in (("signup", "2 DAYS"), ("error", "5 HOURS")))
    j = TM.overlap_join(a, b, ["user_id"], "s", "e")
    return j.select(F.col("event_id").alias("signup_id"), F.col("event_id_b").alias("error_id"), "user_id")


# ----------------------------------------------------------- ordered streams

@register("stream_ordered_transitions", ORACLES["run_transitions"])
def q_stream_ordered_transitions(spark, sf):
    """LG1 on four arrivals whose events are up to 20 hours out of order,
    each a stream run that goes on from the one before."""
    ev = _ledger_events(spark, sf).select("run_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "status")
    at = F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(20 * 3600 * 10**6))
    lo, hi = ev.agg(F.min(at), F.max(at)).first()
    part = F.least(F.floor((at - (lo or 0)) * 4 / max((hi or 0) - (lo or 0), 1)), F.lit(3))
    out, _ = SL.replay_ordered([ev.where(part == i) for i in range(4)], "run_id", "ts", "status", "event_id", delay="1 day",
                               partitions=min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# ------------------------------------------------------- keys and inclusions

_COLUMNS = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"]}


def _keys_sql():
    parts = []
    for t, cols in _COLUMNS.items():
        sets = [s for n in (1, 2) for s in combinations(cols, n)]
        test = ", ".join(f"count(DISTINCT ({', '.join(s)})) = count(*) AND {' AND '.join(f'count({c}) = count(*)' for c in s)} AS k{i}"
                         for i, s in enumerate(sets))
        for i, s in enumerate(sets):
            smaller = "".join(f" AND NOT k{j}" for j, o in enumerate(sets) if set(o) < set(s))
            parts.append((t, test, f"SELECT '{t}' AS \"table\", [{', '.join(repr(c) for c in s)}] AS columns, {len(s)}::INTEGER AS n_columns "
                                   f"FROM {t}_k WHERE k{i}{smaller}"))
    views = ", ".join(f"{t}_k AS (SELECT {test} FROM {t})" for t, test in dict((p[0], p[1]) for p in parts).items())
    return f"WITH {views} " + " UNION ALL ".join(p[2] for p in parts)


@register("discover_keys", _keys_sql())
def q_discover_keys(spark, sf):
    out = None
    for t, cols in _COLUMNS.items():
        one = DI.find_keys(table(spark, sf, t).select(*cols), 2).select(F.lit(t).alias("table"), "columns", "n_columns")
        out = one if out is None else out.unionByName(one)
    return out


_INTEGERS = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"],
             "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey", "p_size"], "orders": ["o_orderkey", "o_custkey"],
             "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]}
_TEXTS = {"region": ["r_name"], "nation": ["n_name"], "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"]}


def _inclusions_sql():
    parts = []
    for kind in (_INTEGERS, _TEXTS):
        cols = [(t, c) for t, cs in kind.items() for c in cs]
        for t, c in cols:
            for u, d in cols:
                if (t, c) != (u, d):
                    parts.append(f"SELECT '{t}' AS child_table, '{c}' AS child_column, '{u}' AS parent_table, '{d}' AS parent_column, "
                                 f"(SELECT count(DISTINCT {c}) FROM {t}) AS n_values WHERE EXISTS (SELECT 1 FROM {t} WHERE {c} IS NOT NULL) "
                                 f"AND NOT EXISTS (SELECT {c} FROM {t} WHERE {c} IS NOT NULL EXCEPT SELECT {d} FROM {u})")
    return " UNION ALL ".join(parts)


def _key_tables(spark, sf):
    names = {t: _INTEGERS.get(t, []) + _TEXTS.get(t, []) for t in _INTEGERS}
    return {t: table(spark, sf, t).select(*cols) for t, cols in names.items()}


@register("inclusion_dependencies", _inclusions_sql())
def q_inclusion_dependencies(spark, sf):
    return DI.inclusion_dependencies(_key_tables(spark, sf))


_FK = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
       ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
       ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
       ("lineitem", "l_suppkey", "supplier", "s_suppkey")]


@register("foreign_keys_found", " UNION ALL ".join(
    f"SELECT '{t}' AS child_table, '{c}' AS child_column, '{u}' AS parent_table, '{d}' AS parent_column, "
    f"(SELECT count(DISTINCT {c}) FROM {t}) AS n_values, (SELECT count(*) FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {d} FROM {u})) "
    f"AS orphan_rows, (SELECT count(*) = count(DISTINCT {d}) FROM {u}) AS valid" for t, c, u, d in _FK))
def q_foreign_keys_found(spark, sf):
    """Candidates whose names agree: the declared foreign keys."""
    return DI.foreign_keys(_key_tables(spark, sf)).where("same_name").drop("same_name")


_SCHEMA = [("orders", "o_orderkey", "bigint", True), ("orders", "o_custkey", "bigint", False), ("orders", "o_orderstatus", "string", False),
           ("orders", "o_totalprice", "double", False), ("orders", "o_orderdate", "timestamp_ntz", False), ("orders", "o_orderpriority", "string", False),
           ("nation", "n_nationkey", "int", True), ("nation", "n_name", "string", False), ("nation", "n_regionkey", "int", False)]


@register("schema_keys", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}', '{k}', true, {str(p).lower()})" for t, c, k, p in _SCHEMA) +
          ") v(\"table\", \"column\", dtype, nullable, primary_key)")
def q_schema_keys(spark, sf):
    """SRC6 with types, nullability and the primary keys found in the data."""
    r = SRC.schema_inventory({t: table(spark, sf, t) for t in ("orders", "nation")}, primary_keys="discover")
    return r.select("table", "column", "dtype", "nullable", "primary_key")


# --------------------------------------------------------------------- drift

_KS_SQL = """
WITH e AS (SELECT event_type, value, ts >= TIMESTAMP '2024-01-16' AS cur FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
c AS (SELECT event_type, value, count(*) FILTER (NOT cur) AS r, count(*) FILTER (cur) AS q FROM e GROUP BY 1, 2),
w AS (SELECT event_type, sum(r) OVER o AS sr, sum(q) OVER o AS sq, sum(r) OVER p AS n_ref, sum(q) OVER p AS n_cur FROM c
      WINDOW o AS (PARTITION BY event_type ORDER BY value), p AS (PARTITION BY event_type)),
k AS (SELECT event_type, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur, max(abs(sr / n_ref - sq / n_cur)) AS ks
      FROM w WHERE n_ref > 0 AND n_cur > 0 GROUP BY 1, 2, 3),
x AS (SELECT *, ks * sqrt(CAST(n_ref AS DOUBLE) * n_cur / (n_ref + n_cur)) AS x FROM k)"""


@register("ks_by_event_type", _KS_SQL + """
SELECT event_type, n_ref, n_cur, round(ks, 9) AS ks, round(least(1, greatest(0, CASE WHEN x <= 0 THEN 1 ELSE
  (SELECT sum(2 * (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * x * x)) FROM range(1, 60) t(j)) END)), 6) AS p_value FROM x""")
def q_ks_by_event_type(spark, sf):
    e = table(spark, sf, "events")
    out = DR.ks_exact(e, "value", F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz"), ["event_type"])
    return out.select("event_type", "n_ref", "n_cur", F.round("ks", 9).alias("ks"), F.round("p_value", 6).alias("p_value"))


@register("drift_from_daily_sketches", _KS_SQL + """,
u AS (SELECT event_type, user_id, bool_or(ts >= TIMESTAMP '2024-01-16') AS cur, bool_or(ts < TIMESTAMP '2024-01-16') AS ref FROM events GROUP BY 1, 2)
SELECT event_type, n_ref, n_cur, TRUE AS ks_near, TRUE AS new_ids_near FROM k JOIN (SELECT DISTINCT event_type FROM u) USING (event_type)""")
def q_drift_from_daily_sketches(spark, sf):
    """The report from daily sketches next to exact values: KS within 0.01
    and the share of new users within 0.05 of them."""
    e = table(spark, sf, "events")
    days = DR.daily_sketches(e, "ts", "value", "user_id", ["event_type"])
    got = DR.drift_report(days, ("1900-01-01", "2024-01-15"), ("2024-01-16", "9999-12-31"), ["event_type"])
    current = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    exact = DR.ks_exact(e, "value", current, ["event_type"]).select("event_type", F.col("ks").alias("ks_exact"))
    ids = e.groupBy("event_type", "user_id").agg(F.bool_or(current).alias("cur"), F.bool_or(~current).alias("ref"))
    ids = ids.groupBy("event_type").agg((F.count_if(F.col("cur") & ~F.col("ref")) / F.count_if(F.col("cur"))).alias("new_exact"))
    j = got.join(exact, "event_type").join(ids, "event_type")
    return j.select("event_type", "n_ref", "n_cur", (F.abs(F.col("ks") - F.col("ks_exact")) <= 0.01).alias("ks_near"),
                    (F.abs(F.col("new_ids") - F.col("new_exact")) <= 0.05).alias("new_ids_near"))


# ------------------------------------------------------------------ forecasts

_HW_SQL = """
WITH RECURSIVE s AS (SELECT o_orderpriority AS k, date_trunc('month', o_orderdate) AS ts,
    CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y FROM orders GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts) AS i FROM s),
f AS (SELECT k, avg(y) FILTER (i <= 12) AS l, coalesce((avg(y) FILTER (i BETWEEN 13 AND 24) - avg(y) FILTER (i <= 12)) / 12, 0) AS b,
    list(y ORDER BY i) FILTER (i <= 12) AS ys FROM n GROUP BY k),
r AS (SELECT k, 0 AS i, l, b, list_transform(range(1, 13), lambda j: coalesce(ys[j] - l, 0)) AS s, 0.0::DOUBLE AS sse,
        NULL::TIMESTAMP AS ts, NULL::DOUBLE AS y, NULL::DOUBLE AS expected FROM f
      UNION ALL
      SELECT k, i + 1, l + b + 0.3 * (z - g), b + 0.03 * (z - g), list_append(s[2:12], s[1] + 0.07 * (z - g)), sse + (z - g) * (z - g), t, z, g
      FROM (SELECT r.k, r.i, r.l, r.b, r.s, r.sse, n.ts AS t, n.y AS z, r.l + r.b + r.s[1] AS g FROM r JOIN n ON n.k = r.k AND n.i = r.i + 1))"""


def _monthly(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy("o_orderpriority", F.date_trunc("month", F.col("o_orderdate")).cast("timestamp_ntz").alias("ts")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("y"))


@register("holt_winters_fitted", _HW_SQL + """
SELECT k AS o_orderpriority, ts, round(y, 2) AS y, round(expected, 2) AS expected FROM r WHERE i > 0""")
def q_holt_winters_fitted(spark, sf):
    fit = FC.holt_winters_fit(_monthly(spark, sf), ["o_orderpriority"], "ts", "y", 12)
    out = FC.fitted(fit, ["o_orderpriority"], "ts", "y")
    return out.select("o_orderpriority", "ts", F.round("y", 2).alias("y"), F.round("expected", 2).alias("expected"))


@register("holt_winters_forecast", _HW_SQL + """,
e AS (SELECT r.* FROM r JOIN (SELECT k, max(i) AS i FROM r GROUP BY k) m ON r.k = m.k AND r.i = m.i),
h AS (SELECT CAST(h AS INTEGER) AS h, sqrt(1 + (SELECT coalesce(sum(power(0.3 * (1 + j * 0.1) + CASE WHEN j % 12 = 0 THEN 0.07 ELSE 0 END, 2)), 0)
        FROM range(1, 25) t(j) WHERE j < h)) AS w FROM range(1, 25) u(h))
SELECT k AS o_orderpriority, ts AS last_ts, h AS step, round(l + h * b + s[1 + (h - 1) % 12], 2) AS forecast,
  round(l + h * b + s[1 + (h - 1) % 12] - 1.959963984540054 * sqrt(sse / i) * w, 2) AS lower,
  round(l + h * b + s[1 + (h - 1) % 12] + 1.959963984540054 * sqrt(sse / i) * w, 2) AS upper FROM e, h""")
def q_holt_winters_forecast(spark, sf):
    fit = FC.holt_winters_fit(_monthly(spark, sf), ["o_orderpriority"], "ts", "y", 12)
    out = FC.forecast(fit, ["o_orderpriority"], 24, 12)
    return out.select("o_orderpriority", "last_ts", "step", *[F.round(c, 2).alias(c) for c in ("forecast", "lower", "upper")])


# ------------------------------------------------------------------ anomalies

@register("isolation_forest_planted", """
SELECT l_linenumber, count(*) AS n_rows, count(*) FILTER (l_orderkey % 400 = 7) AS n_planted, TRUE AS recall_ok, TRUE AS few_others
FROM lineitem GROUP BY 1""")
def q_isolation_forest_planted(spark, sf):
    """Every 400th order's lines moved far out in price and tax: at least 95
    of 100 of them are found, and at most 2 of 100 other rows with them."""
    li = table(spark, sf, "lineitem")
    far = F.col("l_orderkey") % 400 == 7
    li = li.select("l_orderkey", "l_linenumber", "l_quantity", F.when(far, F.col("l_extendedprice") * 9 + 1e6).otherwise(F.col("l_extendedprice")).alias("price"),
                   F.when(far, F.col("l_tax") + 0.6).otherwise(F.col("l_tax")).alias("tax"), "l_discount")
    s = AN.isolation_forest(li, ["l_quantity", "price", "tax", "l_discount"], ["l_orderkey", "l_linenumber"], threshold=0.65)
    far = F.col("l_orderkey") % 400 == 7
    per = s.groupBy("l_linenumber").agg(F.count("*").alias("n_rows"), F.count_if(far).alias("n_planted"), F.count_if(far & F.col("anomaly")).alias("f"),
                                        F.count_if(~far & F.col("anomaly")).alias("o"))
    whole = s.agg(F.count_if(far).alias("p"), F.count_if(far & F.col("anomaly")).alias("tp"), F.count_if(~far & F.col("anomaly")).alias("fp"),
                  F.count("*").alias("n"))
    return per.crossJoin(whole).select("l_linenumber", "n_rows", "n_planted", (F.col("tp") * 100 >= F.col("p") * 95).alias("recall_ok"),
                                       (F.col("fp") * 100 <= F.col("n") * 2).alias("few_others"))


# ------------------------------------------------------- absorbed regressions

_ABSORB_SQL = """
WITH b AS (SELECT CAST(o_custkey AS VARCHAR) AS g, CAST(l_quantity AS DOUBLE) AS q, l_discount AS d, l_extendedprice AS y
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT g, count(*) AS n, avg(q) AS mq, avg(d) AS md, avg(y) AS my FROM b GROUP BY g),
w AS (SELECT q - mq AS q, d - md AS d, y - my AS y FROM b JOIN m USING (g)),
s AS (SELECT sum(q*q) AS qq, sum(q*d) AS qd, sum(d*d) AS dd, sum(q*y) AS qy, sum(d*y) AS dy, sum(y*y) AS yy, count(*) AS n FROM w),
c AS (SELECT *, (qy*dd - dy*qd) / (qq*dd - qd*qd) AS bq, (dy*qq - qy*qd) / (qq*dd - qd*qd) AS bd, (SELECT count(*) FROM m) AS g FROM s),
v AS (SELECT *, (yy - bq*qy - bd*dy) / (n - g - 2) AS s2 FROM c)"""


def _absorbed(spark, sf):
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return OL.ols_absorbed(li.select("l_extendedprice", "l_quantity", "l_discount", "o_custkey"), "l_extendedprice", ["l_quantity", "l_discount"], "o_custkey")


@register("ols_absorbed_slopes", _ABSORB_SQL + """
SELECT 'l_quantity' AS term, round(bq, 4) AS coefficient, round(sqrt(s2 * dd / (qq*dd - qd*qd)), 4) AS std_error FROM v
UNION ALL SELECT 'l_discount', round(bd, 4), round(sqrt(s2 * qq / (qq*dd - qd*qd)), 4) FROM v""")
def q_ols_absorbed_slopes(spark, sf):
    c = OL.absorbed_coefficients(_absorbed(spark, sf))
    return c.select("term", F.round("coefficient", 4).alias("coefficient"), F.round("std_error", 4).alias("std_error"))


@register("ols_absorbed_effects", _ABSORB_SQL + """
SELECT m.g AS level, m.n, round(my - bq * mq - bd * md, 3) AS effect FROM m, v""")
def q_ols_absorbed_effects(spark, sf):
    """One intercept per customer, as many as there are."""
    return OL.absorbed_effects(_absorbed(spark, sf)).select("level", "n", F.round("effect", 3).alias("effect"))
