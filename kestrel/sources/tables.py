"""Parquet tables of a data directory and the derived working views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


_SCHEMAS: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder. Its files are listed
    anew at each call, so that files added meanwhile are read; the schema is
    inferred once per path and session."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def money(c: str):
    """Money as an exact decimal so sums are identical on every engine."""
    return F.col(c).cast("decimal(18,2)")


# What each column of ``sales`` needs besides lineitem.
_SALES_NEEDS = {"order_date": ("orders",), "customer_id": ("orders",), "segment": ("orders", "customer"),
                "country": ("orders", "customer", "nation"), "region": ("orders", "customer", "nation", "region"),
                "product_category": ("part",)}
SALES_COLUMNS = ("order_id", "order_date", "customer_id", "country", "region", "segment", "product_category", "quantity",
                 "unit_price", "discount_pct", "revenue")


def sales(spark: SparkSession, sf_dir: str, tables: dict | None = None,
          lineitem: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """The e-commerce working table (one row per line item).

    lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ region ⋈ part, without the
    tables that none of ``columns`` (default: all) needs: the keys are
    declared and checked (REL1), so that a join to a parent that gives no
    column changes no row. All joins are left to AQE, which broadcasts a
    side only when its runtime size is under
    ``spark.sql.autoBroadcastJoinThreshold``. ``tables`` may supply
    lineitem/orders written by ``sources.layout.bucketed_order_tables``;
    their join then needs no shuffle. ``lineitem`` may be a streaming
    DataFrame (stream-static joins with the dimension tables).
    """
    columns = list(columns or SALES_COLUMNS)
    need = {t for c in columns for t in _SALES_NEEDS.get(c, ())}
    tables = tables or {}
    df = (lineitem if lineitem is not None else tables.get("lineitem") or table(spark, sf_dir, "lineitem")).select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    if "orders" in need:
        o = (tables.get("orders") or table(spark, sf_dir, "orders")).select("o_orderkey", "o_orderdate", "o_custkey")
        df = df.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    if "customer" in need:
        c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        df = df.join(c, F.col("o_custkey") == F.col("c_custkey"))
    if "nation" in need:
        geo = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
        if "region" in need:
            geo = geo.join(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
        df = df.join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    if "part" in need:
        df = df.join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    made = {"order_id": F.col("l_orderkey"), "order_date": F.col("o_orderdate"), "customer_id": F.col("o_custkey"), "country": F.col("n_name"),
            "region": F.col("r_name"), "segment": F.col("c_mktsegment"), "product_category": F.col("p_type"), "quantity": F.col("l_quantity"),
            "unit_price": F.col("l_extendedprice") / F.col("l_quantity"), "discount_pct": F.col("l_discount"),
            "revenue": money("l_extendedprice") * (F.lit(1) - money("l_discount"))}
    return df.select(*[made[c].alias(c) for c in columns])


# The same view as SQL text, used by oracle queries (DuckDB dialect).
SALES_SQL = """
SELECT l.l_orderkey AS order_id, o.o_orderdate AS order_date, o.o_custkey AS customer_id,
       n.n_name AS country, r.r_name AS region, c.c_mktsegment AS segment,
       p.p_type AS product_category, l.l_quantity AS quantity,
       l.l_extendedprice / l.l_quantity AS unit_price, l.l_discount AS discount_pct,
       CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(18,2))) AS revenue
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey JOIN part p ON l.l_partkey = p.p_partkey
"""


def ab_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A/B view of ``events``: variant by user parity, purchase = conversion."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.when(F.col("user_id") % 2 == 1, F.lit("treatment")).otherwise(F.lit("control")).alias("variant"),
        (F.col("event_type") == "purchase").cast("int").alias("conversion"),
    )


AB_EVENTS_SQL = """
SELECT event_id, ts, user_id, event_type, value,
       CASE WHEN user_id % 2 = 1 THEN 'treatment' ELSE 'control' END AS variant,
       CAST(event_type = 'purchase' AS INTEGER) AS conversion
FROM events
"""
