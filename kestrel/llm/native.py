"""Helpers for operators that stay inside DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.session import cut_lineage


def let(value, body):
    """``body`` of a value that is computed once per row (an expression
    named inside a lambda would be computed once per element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(*frames: DataFrame) -> str:
    """A prefix that starts no column's name of the frames."""
    p, names = "_x", [c.lower() for df in frames for c in df.columns]
    while any(c.startswith(p) for c in names):
        p = "_" + p
    return p


#: Bits of the sieve below: a megabyte, whatever the number of keys.
SIEVE_BITS = 23


def sift(rows: DataFrame, key: str, keys: DataFrame, wanted: str) -> tuple[DataFrame, DataFrame]:
    """(others, suspects): ``rows`` cut by a bit table of fixed size that holds the hashes ``wanted`` of ``keys``. ``key`` is such a hash
    in every row. Rows whose hash is wanted are all among the suspects, with
    a share of the rest that grows with the number of keys; so a join with
    the keys need not move the others."""
    spark = rows.sparkSession
    slot = F.pmod(F.col(wanted), F.lit(1 << SIEVE_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    words = keys.select(F.shiftright(slot, 6).alias("w"), bit.alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))
    table = (spark.range(1 << (SIEVE_BITS - 6)).join(words, F.col("id") == F.col("w"), "left")
             .agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("v", F.lit(0).cast("long")).alias("v")))).alias("x"))
             .select(F.transform("x", lambda x: x["v"]).alias("bits")))
    at = F.pmod(F.col(key), F.lit(1 << SIEVE_BITS))
    # a scalar, not a joined row: joins with the keys would be pushed below a join
    held = F.get(cut_lineage(table).scalar(), F.shiftright(at, 6).cast("int")).bitwiseAND(
        F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))) != 0
    return rows.where(~held), rows.where(held)


def plain(column, kind: T.DataType):
    """A column without maps (entries instead) and with numbered struct
    fields, in which form Arrow carries any type; ``unplain`` turns it back."""
    if isinstance(kind, T.MapType):
        return F.transform(F.map_entries(column), lambda e: F.struct(plain(e["key"], kind.keyType).alias("f0"),
                                                                     plain(e["value"], kind.valueType).alias("f1")))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: plain(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[plain(column.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)]))
    return column


def unplain(column, kind: T.DataType):
    if isinstance(kind, T.MapType):
        entries = F.transform(column, lambda e: F.struct(unplain(e["f0"], kind.keyType).alias("key"), unplain(e["f1"], kind.valueType).alias("value")))
        return F.when(column.isNotNull(), F.map_from_entries(entries))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: unplain(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[unplain(column.getField(f"f{i}"), f.dataType).alias(f.name) for i, f in enumerate(kind.fields)]))
    return column
