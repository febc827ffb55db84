"""Keys and inclusions found in data, against brute force."""
import random
from itertools import combinations

from pyspark.sql import functions as F

from kestrel.operators import discovery as DI

R = random.Random(2)


def brute_keys(rows, names, most):
    keys = []
    for n in range(1, most + 1):
        for s in combinations(range(len(names)), n):
            cells = [tuple(r[i] for i in s) for r in rows]
            if rows and not any(set(k) <= set(s) for k in keys) and all(None not in c for c in cells) and len(set(cells)) == len(rows):
                keys.append(s)
    return {tuple(names[i] for i in k) for k in keys}


def test_keys(spark):
    names = ["a", "b", "c", "d", "e", "f"]
    rows = [(i // 20, i % 20, R.randint(0, 30), f"x{i % 7}", None if i == 5 else i, float(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d string, e int, f double")
    for most in (1, 2, 3):
        assert {tuple(r["columns"]) for r in DI.find_keys(df, most).collect()} == brute_keys(rows, names, most)
    assert ("a", "b") in brute_keys(rows, names, 2) and DI.primary_key(df) == ["a", "b"]
    assert DI.primary_key(df.select("d", "f")) == [] and DI.find_keys(df.where("false")).count() == 0
    # a repeated row: no key at all; one row: every column; a nearly unique column is no key
    assert DI.find_keys(df.unionByName(df.limit(1)), 3).count() == 0
    assert DI.find_keys(df.where("e = 0"), 1).count() == 6
    near = spark.range(5000).selectExpr("if(id = 4999, 0, id) AS x", "id AS y")
    assert [r["columns"] for r in DI.find_keys(near, 2).collect()] == [["y"]]


def test_zero_signs_and_nested(spark):
    df = spark.createDataFrame([(0.0, [1]), (-0.0, [2])], "x double, y array<int>")
    assert DI.find_keys(df).count() == 0


def test_inclusions(spark):
    t = {"p": spark.createDataFrame([(i, f"n{i}", None) for i in range(50)], "id int, name string, none int"),
         "c": spark.createDataFrame([(i, i % 50 if i % 9 else None, f"n{i % 60}", f"n{i % 5}") for i in range(200)], "id long, p_id long, label string, kind string"),
         "e": spark.createDataFrame([], "id int")}
    got = {tuple(r)[:4] for r in DI.inclusion_dependencies(t).collect()}
    held = {(n, c): {r[c] for r in df.collect()} - {None} for n, df in t.items() for c in df.columns}
    kind = lambda v: type(next(iter(v)))
    want = {(*a, *b) for a in held for b in held if a != b and held[a] and held[b] and kind(held[a]) == kind(held[b]) and held[a] <= held[b]}
    assert got == want and ("c", "kind", "p", "name") in got
    fk = {(r["child_table"], r["child_column"], r["parent_table"], r["parent_column"]): r for r in DI.foreign_keys(t).collect()}
    assert fk[("c", "p_id", "p", "id")]["valid"] and fk[("c", "p_id", "p", "id")]["same_name"]
    assert ("c", "label", "p", "name") not in fk


def test_inclusions_are_read_once(spark, monkeypatch):
    """Found pairs need no join on the tables, and columns beyond 63 have
    their bits too."""
    a = spark.range(20).select(*[(F.col("id") % (i + 1)).alias(f"a{i}") for i in range(70)])
    t = {"a": a, "b": spark.createDataFrame([(0, "x"), (None, None), (-1, "y")], "k short, w string"), "c": spark.createDataFrame([("y",)], "z string")}
    sizes, join = [], type(a).join

    def counted(self, other, *args, **kw):
        sizes.append((self.count(), other.count()))
        return join(self, other, *args, **kw)

    monkeypatch.setattr(type(a), "join", counted)
    got = {tuple(r) for r in DI.inclusion_dependencies(t).collect()}
    held = {("a", f"a{i}"): {x % (i + 1) for x in range(20)} for i in range(70)} | {("b", "k"): {0, -1}, ("b", "w"): {"x", "y"}, ("c", "z"): {"y"}}
    want = {(*x, *y, len(held[x])) for x in held for y in held if x != y and held[x] <= held[y]}
    assert got == want and len(sizes) == 1
