import io
from contextlib import redirect_stdout

from conftest import SF_SMALL
from kestrel.sources.layout import bucketed_order_tables


def test_bucketed_join_has_no_shuffle(spark):
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = bucketed_order_tables(spark, SF_SMALL, 4, prefix="t_layout_")
        j = t["lineitem"].join(t["orders"], t["lineitem"].l_orderkey == t["orders"].o_orderkey)
        buf = io.StringIO()
        with redirect_stdout(buf):
            j.explain()
        plan = buf.getvalue()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert j.count() == spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
