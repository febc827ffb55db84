"""SRC6/REL1: keys and inclusion dependencies found in the data.

Keys: the lattice of column sets level by level, without sets that contain a
key or whose distinct counts cannot reach the number of rows; a sketch per
set in one scan rules most of the rest out, and what is left is counted
exactly. Inclusions: every distinct value gathers the columns that hold it,
and the sets of columns, each with its number of values, decide all
pairs of columns at once.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.operators.star import relationship_check
from kestrel.session import cut_lineage

#: log2 of a sketch's registers (relative standard error 0.4 %), and the
#: share of the rows below which an estimate rules a set out (20 standard
#: errors away).
SKETCH, RSD, SURE = 16, 0.004, 0.92


def _flat(df: DataFrame) -> list[str]:
    """Columns that can be part of a key."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]


def _value(column, kind):
    """Values that count as equal in one form: -0.0 as 0.0."""
    return F.when(column == 0, F.lit(0.0)).otherwise(column) if isinstance(kind, (T.DoubleType, T.FloatType)) else column


def _estimate(cells):
    """The number of distinct values of a set of columns, about."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*cells), SKETCH))


def find_keys(df: DataFrame, max_columns: int = 2, columns: list[str] | None = None) -> DataFrame:
    """(columns, n_columns): the minimal sets of at most ``max_columns``
    columns without nulls whose values tell all rows apart.

    One scan per level: a set's distinct values are estimated by a sketch of
    fixed size (sets with fewer than ``SURE`` of the rows fall out); only
    sets that pass it are grouped, which shuffles their hash-sized keys and
    spreads any value. Columns default to all that are not nested. An empty
    table has no keys (every set would be one)."""
    spark = df.sparkSession
    names = columns or _flat(df)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    schema = "columns array<string>, n_columns int"
    cells = {c: _value(df[c], kinds[c]) for c in names}
    first = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(df[c]).alias(f"c{i}") for i, c in enumerate(names)],
                   *[_estimate([cells[c]]).alias(f"d{i}") for i, c in enumerate(names)]).first()
    n = first["n"]
    if not n:
        return spark.createDataFrame([], schema)
    names = [c for i, c in enumerate(names) if first[f"c{i}"] == n]
    distinct = {c: first[f"d{i}"] for i, c in enumerate(columns or _flat(df)) if c in names}
    keys: list[tuple] = []
    for size in range(1, max_columns + 1):
        sets = [s for s in combinations(names, size)
                if not any(set(k) <= set(s) for k in keys)
                # even if every combination of values occurred, there would be too few
                and reduce(lambda a, b: a * b, (distinct[c] * (1 + 20 * RSD) for c in s), 1.0) >= n]
        if size == 1:
            near = [s for s in sets if distinct[s[0]] >= SURE * n]
        elif sets:
            guess = df.agg(*[_estimate([cells[c] for c in s]).alias(f"s{i}") for i, s in enumerate(sets)]).first()
            near = [s for i, s in enumerate(sets) if guess[f"s{i}"] >= SURE * n]
        else:
            near = []
        if not near:
            continue
        tests = [df.select(*[cells[c].alias(f"k{j}") for j, c in enumerate(s)]).groupBy(*[f"k{j}" for j in range(size)]).count()
                 .where("count > 1").limit(1).select(F.lit(i).alias("i")) for i, s in enumerate(near)]
        repeated = {r["i"] for r in reduce(DataFrame.unionByName, tests).collect()}           # one row per set at most
        keys += [s for i, s in enumerate(near) if i not in repeated]
    return spark.createDataFrame([(list(k), len(k)) for k in keys], schema)


def primary_key(df: DataFrame, max_columns: int = 2) -> list[str]:
    """The first of the smallest keys in column order ([] without one)."""
    found = find_keys(df, max_columns).collect()
    place = {c: i for i, c in enumerate(df.columns)}
    best = min(found, key=lambda r: (r["n_columns"], [place[c] for c in r["columns"]]), default=None)
    return list(best["columns"]) if best else []


def _kind(kind: T.DataType) -> str | None:
    """Columns are compared within one class of types."""
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(kind, T.DateType):
        return "date"
    return None


def inclusion_dependencies(tables: dict[str, DataFrame], verify: bool = True) -> DataFrame:
    """(child_table, child_column, parent_table, parent_column, n_values):
    all pairs of columns (whole numbers, texts or dates) where every
    non-null value of the child occurs in the parent; columns without values
    are in no pair.

    Each class's distinct values travel once, as values, with a bit per
    column that holds them (merged before the shuffle); a value met in many
    columns is one row. What is left is one row per occurring set of
    columns. The values themselves are grouped, not their hashes, so no
    collision can stand and nothing is left for ``verify`` to check."""
    spark = next(iter(tables.values())).sparkSession
    place = [(t, f.name, _kind(f.dataType)) for t, df in tables.items() for f in df.schema.fields if _kind(f.dataType)]
    out = "child_table string, child_column string, parent_table string, parent_column string, n_values long"
    if not place:
        return spark.createDataFrame([], out)
    words = [f"m{w}" for w in range(-(-len(place) // 63))]          # 63 columns' bits in a long
    sets = None
    for cls, form in (("integer", "long"), ("text", "string"), ("date", "date")):
        rows = None
        for t, df in tables.items():
            cells = [F.struct(df[c].cast(form).alias("v"), *[F.lit(1 << i % 63 if i // 63 == w else 0).cast("long").alias(m) for w, m in enumerate(words)])
                     for i, (tt, c, kind) in enumerate(place) if tt == t and kind == cls]
            if cells:
                one = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("v IS NOT NULL")
                rows = one if rows is None else rows.unionByName(one)
        if rows is not None:
            some = rows.groupBy("v").agg(*[F.bit_or(m).alias(m) for m in words]).groupBy(*words).agg(F.count("*").alias("n"))
            sets = some if sets is None else sets.unionByName(some)
    held = F.filter(F.array(*[F.when(F.col(words[i // 63]).bitwiseAND(F.lit(1 << i % 63).cast("long")) != 0, i) for i in range(len(place))]),
                    lambda x: x.isNotNull())
    sets = cut_lineage(sets.select(held.alias("s"), "n"))
    both = sets.select(F.explode("s").alias("a"), "s", "n").select("a", F.explode("s").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("n"))
    own = both.where("a = b").select(F.col("a").alias("of"), F.col("n").alias("all"))
    found = both.where("a <> b").join(own, (F.col("a") == F.col("of")) & (F.col("n") == F.col("all"))).select("a", "b", "n").collect()  # pairs of columns
    return spark.createDataFrame([(*place[r["a"]][:2], *place[r["b"]][:2], r["n"]) for r in found], out)


def foreign_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Inclusions into a single-column key of another table, as candidates
    for foreign keys: (child_table, child_column, parent_table,
    parent_column, n_values, orphan_rows, valid, same_name). The last is
    true if both names agree after their prefix up to the first ``_``, the
    usual sign of a key that is meant rather than of small numbers that
    happen to lie inside."""
    spark = next(iter(tables.values())).sparkSession
    keys = {t: {tuple(r["columns"])[0] for r in find_keys(df, 1).collect()} for t, df in tables.items()}
    found = [r for r in inclusion_dependencies(tables, verify=False).collect()
             if r["parent_column"] in keys[r["parent_table"]] and r["child_table"] != r["parent_table"]]
    out = None
    for r in found:
        ct, cc, pt, pc = r["child_table"], r["child_column"], r["parent_table"], r["parent_column"]
        same = cc.split("_", 1)[-1].lower() == pc.split("_", 1)[-1].lower()
        one = relationship_check(tables[pt], [pc], tables[ct], [cc]).select(
            F.lit(ct).alias("child_table"), F.lit(cc).alias("child_column"), F.lit(pt).alias("parent_table"),
            F.lit(pc).alias("parent_column"), F.lit(r["n_values"]).cast("long").alias("n_values"), "orphan_rows", "valid",
            F.lit(same).alias("same_name"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "child_table string, child_column string, parent_table string, parent_column string, "
                                         "n_values long, orphan_rows long, valid boolean, same_name boolean")
    return out
