import pytest
from pyspark.sql import functions as F

from kestrel.operators import charts as CH
from kestrel.operators import kpi as K
from kestrel.operators import star as ST


def test_row_formula(spark):
    df = spark.createDataFrame([("k", 6.0, 0.0, "2"), ("k", 1.0, 4.0, "n/a")], "g string, a double, b double, c string")
    ansi = spark.conf.get("spark.sql.ansi.enabled")

    def values(f):
        return [r["_v"] for r in K.row_formula(df, f, ["g"]).collect()]

    assert values("a / c ** 2 - -1") == [pytest.approx(2.5), None]
    assert values("a / b") == [None, 0.25] and values(F.col("a") + F.col("b")) == [6.0, 5.0]
    assert values("power(a, 2) + (b - 1) * 2") == [34.0, 7.0]
    for bad in ("__import__('os')", "a.b", "abs(a)", "a if c else b", "d + 1", "sum(a)", "a -- 1", "a = b",
                "a ** -b", "java_method('java.lang.System', 'exit')", "a; b", "a is null"):
        with pytest.raises(ValueError):
            K.row_formula(df, bad)
    assert spark.conf.get("spark.sql.ansi.enabled") == ansi


def test_histogram_constant_and_bins(spark):
    const = spark.createDataFrame([(5.0,)] * 4, "x double")
    h = {r["bin"]: r["count"] for r in CH.histogram(const, "x").collect()}
    assert h[0] == 4 and sum(h.values()) == 4 and len(h) == 10
    df = spark.createDataFrame([(float(v),) for v in range(11)], "x double")
    h = {r["bin"]: r["count"] for r in CH.histogram(df, "x").collect()}
    assert h[9] == 2 and sum(h.values()) == 11       # last bin closed


def test_top_categories_cardinality_rule(spark):
    one = spark.createDataFrame([("a",)] * 3, "c string")
    assert CH.top_categories(one, "c").count() == 0
    many = spark.createDataFrame([(str(i),) for i in range(40)], "c string")
    assert CH.top_categories(many, "c", max_unique=30).count() == 0
    assert CH.top_categories(many, "c").count() == 40 and CH.top_categories(many, "c", top_k=3).count() == 3


def test_heatmap_zero_cells(spark):
    df = spark.createDataFrame([("x1", "y1", 1.0), ("x2", "y2", 2.0)], "x string, y string, v double")
    cells = {(r["x"], r["y"]): r["value"] for r in CH.heatmap_cells(df, "x", "y", "v").collect()}
    assert cells == {("x1", "y1"): 1.0, ("x1", "y2"): 0.0, ("x2", "y1"): 0.0, ("x2", "y2"): 2.0}


def test_star_composite_key_and_unknown_agg(spark):
    fact = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0), (2, "a", 4.0)], "k1 int, k2 string, m double")
    dim = spark.createDataFrame([(1, "a", "X"), (1, "b", "Y"), (2, "a", "X")], "d1 int, d2 string, label string")
    rels = [{"from_table": "fact", "from_columns": ["k1", "k2"], "to_table": "dim", "to_columns": ["d1", "d2"]}]
    r = {x["g1_label"]: x["value"] for x in ST.star_groupby({"fact": fact, "dim": dim}, rels, "m", ["label"],
                                                           agg="weird").collect()}
    assert r == {"X": 6.0, "Y": 3.0}           # unknown aggregate falls back to sum


def test_join_tree():
    rels = [("f", "a", "d1", "x"), ("d1", "y", "d2", "z"), ("f", ["b", "c"], "d2", ["u", "v"]), ("q", "k", "r", "k")]
    tree = ST.join_tree(rels, "f")
    assert list(tree) == ["f", "d1", "d2"] and tree["d2"] == ("f", [("b", "u"), ("c", "v")])
    assert ST.branch(tree, "d1") == ["f", "d1"] and ST.branch(tree, "f") == ["f"] and ST.branch(tree, "r") == []
    assert ST.branch(ST.join_tree(rels, "r"), "q") == ["r", "q"]


def test_negative_zero_is_zero(spark):
    from kestrel.operators.aggregate import distinct_count
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.5,), (None,)], "x double")
    assert distinct_count(df).collect()[0]["n_unique"] == 2
