"""Column helpers shared by every operator (aggregate names, coercion, keys).

All helpers return JVM-side Column expressions so they stay inside
whole-stage codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A string counts as a number only when it matches this
# pattern (plain or scientific notation, optional sign, inf/nan words),
# mirroring "to_numeric(errors='coerce')"; try_cast alone would accept
# Java suffixes such as '1d'.
NUMERIC_PATTERN = r"^[+-]?((\d+\.?\d*)|(\.\d+))([eE][+-]?\d+)?$|^[+-]?(inf|infinity|nan)$"

# date/time formats tried in order when a string column is
# parsed as a timestamp. Bare digit strings (years, yyyyMMdd) are left
# out on purpose: they turn identifier columns into 'dates'.
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd.MM.yyyy",
    "yyyy-MM",
)

AGG_NAMES = ("sum", "mean", "min", "max", "median", "count", "std", "var",
             "nunique", "prod", "sem", "skew", "first", "last")
SCALAR_AGG_NAMES = ("sum", "mean", "min", "max", "median", "count")


class ColumnError(ValueError):
    """A requested column is missing or has an unusable type."""


def require_columns(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c is not None and c not in df.columns]
    if missing:
        raise ColumnError(f"column(s) not found: {', '.join(missing)}")


def is_numeric_type(dt: T.DataType) -> bool:
    """Numeric and not boolean (booleans are never treated as measures)."""
    return isinstance(dt, T.NumericType)


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def numeric_col(df: DataFrame, name: str) -> Column:
    """Column `name` as a number; unparsable strings become NULL.

    Numeric columns (including exact decimals) pass through untouched so
    sums stay exact; NaN is normalised to NULL because pandas treats both
    as missing while Spark does not.
    """
    dt = field_type(df, name)
    c = F.col(name)
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    if is_numeric_type(dt):
        return c
    if isinstance(dt, T.BooleanType):
        return c.cast("int")
    if isinstance(dt, T.StringType):
        s = F.trim(c)
        d = F.when(s.rlike(NUMERIC_PATTERN), F.expr(f"try_cast(trim(`{name}`) as double)"))
        return F.when(~F.isnan(d), d)
    raise ColumnError(f"column {name} of type {dt.simpleString()} is not numeric")


def timestamp_col(df: DataFrame, name: str, formats=DATE_FORMATS) -> Column:
    """Column `name` as timestamp_ntz; unparsable values become NULL."""
    dt = field_type(df, name)
    c = F.col(name)
    if isinstance(dt, T.TimestampNTZType):
        return c
    if isinstance(dt, (T.DateType, T.TimestampType)):
        return c.cast("timestamp_ntz")
    if isinstance(dt, T.StringType):
        s = F.trim(c)
        parsed = [F.try_to_timestamp(s, F.lit(f)) for f in formats]
        return F.coalesce(*parsed).cast("timestamp_ntz")
    raise ColumnError(f"column {name} of type {dt.simpleString()} is not a date")


def key_equals(df: DataFrame, name: str, value) -> Column:
    """Group label comparison as the reference does it (labels as text).

    Numeric and boolean columns compare natively against a parsed literal
    so the predicate reaches the Parquet scan; other types compare as text.
    """
    dt = field_type(df, name)
    c = F.col(name)
    if is_numeric_type(dt) and not isinstance(value, bool):
        try:
            v = float(value)
        except (TypeError, ValueError):
            return F.lit(False)
        if isinstance(dt, (T.IntegralType,)) and v == int(v):
            return c == F.lit(int(v))
        return c == F.lit(v)
    if isinstance(dt, T.StringType):
        return c == F.lit(str(value))
    return c.cast("string") == F.lit(str(value))


def agg_column(agg: str, x: Column, order_by: Column | None = None) -> Column:
    """Aggregate name -> Column.

    `sum` of an all-NULL group is 0 (the reference's pandas semantics);
    `count` counts non-NULL values; `skew` is the bias-corrected sample
    skewness; `first`/`last` need an explicit ordering column because
    Spark rows have no inherent order.
    """
    a = (agg or "sum").lower()
    if a == "sum":
        return F.coalesce(F.sum(x), F.lit(0).cast("int"))
    if a in ("mean", "avg", "average"):
        return F.avg(x)
    if a == "min":
        return F.min(x)
    if a == "max":
        return F.max(x)
    if a == "median":
        return F.median(x)
    if a == "count":
        return F.count(x)
    if a in ("std", "stddev"):
        return F.stddev_samp(x)
    if a in ("var", "variance"):
        return F.var_samp(x)
    if a == "nunique":
        return F.count_distinct(x)
    if a == "prod":
        return F.product(x)
    if a == "sem":
        return F.stddev_samp(x) / F.sqrt(F.count(x))
    if a == "skew":
        n = F.count(x)
        return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))
    if a in ("first", "last"):
        if order_by is None:
            raise ColumnError(f"aggregate {a!r} needs an order column")
        return F.min_by(x, order_by) if a == "first" else F.max_by(x, order_by)
    raise ColumnError(f"unsupported aggregate {agg!r}")


def as_double(c: Column) -> Column:
    return c.cast("double")


def round_doubles(df: DataFrame, digits: int = 6, skip: tuple = ()) -> DataFrame:
    """Round every double column (used by registry wrappers so results hash
    identically across engines). Columns in ``skip`` are exact IEEE results
    of identical inputs on both engines (e.g. a ratio of an exact decimal sum
    and a count) and are left unrounded: rounding them could split exact
    decimal halves differently."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in skip:
            out.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
