"""J9: as-of and interval joins, without a task per key.

As-of: both sides are united, range-partitioned on (key, time), and the last
row of the other side is carried forward inside each partition; what crosses
a partition's border is one row per partition. Interval: an interval lies in
one or two bins about as long as itself, a point in one bin of each length in
use, and an equi-join on the bins finds the pairs; crowded bins are cut into
dyadic ones. A key with a third of all rows is spread over time in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.operators.ranks import _n_parts
from kestrel.session import cut_lineage

DIRECTIONS = ("backward", "forward", "nearest")


def _prefix(columns) -> str:
    """A prefix that starts no column's name."""
    p = "_t"
    while any(c.lower().startswith(p) for c in columns):
        p = "_" + p
    return p


def carry_over(rows: DataFrame, by: list[str], order: list[str], payload: str, pid: str, name: str,
               ahead: bool = False) -> DataFrame:
    """Adds ``name``: the last non-null ``payload`` up to each row in
    ``order`` (``ahead``: the first from it on) within its ``by`` group, for
    rows that are range-partitioned on (by, order) and hold their partition's
    number in ``pid``. ``order`` is unique in a group but for rows without
    payload.

    Only a partition's first group (last, if ``ahead``) can have begun in
    another one, so the table of carried rows has at most one row per
    partition and is broadcast."""
    turn = (lambda c: F.col(c).desc()) if ahead else (lambda c: F.col(c).asc())
    w = Window.partitionBy(pid, *by).orderBy(*[turn(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn(name, F.last(payload, ignorenulls=True).over(w))
    at = F.when(F.col(payload).isNotNull(), F.struct(*order))
    ends = rows.groupBy(pid, *by).agg((F.min_by if ahead else F.max_by)(payload, at).alias(f"{name}_end"))
    before = Window.partitionBy(*by).orderBy(turn(pid)).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn(f"{name}_in", F.last(f"{name}_end", ignorenulls=True).over(before)).where(F.col(f"{name}_in").isNotNull())
    carry = carry.select(*[F.col(c).alias(f"{name}_{i}") for i, c in enumerate([pid, *by])], f"{name}_in")
    on = [F.col(c).eqNullSafe(F.col(f"{name}_{i}")) for i, c in enumerate([pid, *by])]
    return local.join(F.broadcast(carry), on, "left").select(*rows.columns, F.coalesce(name, f"{name}_in").alias(name))


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str],
               direction: str = "backward", tolerance: str | None = None, exact: bool = True,
               tiebreak: list[str] | None = None, suffix: str = "", partitions: int | None = None) -> DataFrame:
    """Every left row, with ``right_on`` and ``values`` (named with
    ``suffix``) of the right row of the same ``by`` key whose time is the
    last at or before its own (``forward``: the first at or after;
    ``nearest``: the closer one, the earlier on a tie).

    ``tolerance`` (SQL text, as the times subtract: ``INTERVAL 1 HOUR``,
    ``5``) drops matches farther away; ``exact=False`` leaves equal times
    out. Of right rows with one key and time the last by ``tiebreak``, then
    by ``values``, counts. Left rows without a key, a time or a match stay,
    with nulls; right rows without key or time match nothing; repeated left
    rows come back as often. An empty left side gives an empty result."""
    if direction not in DIRECTIONS or (direction == "nearest" and not exact):
        raise ValueError(f"direction is one of {DIRECTIONS}; nearest takes equal times")
    p = _prefix([*left.columns, *right.columns])
    time, place, row, pid, match = (f"{p}_{x}" for x in ("time", "place", "row", "pid", "match"))
    keys = [f"{p}_k{i}" for i in range(len(by))]
    known = right.where(F.col(right_on).isNotNull())
    for b in by:
        known = known.where(F.col(b).isNotNull())
    payload = F.struct(F.col(right_on).alias("at"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    rank = F.struct(*[F.col(c) for c in (tiebreak or [])], *[F.col(v) for v in values], F.lit(0))
    # right rows stand before the left rows of their time if a row looks back at them there, else behind
    first = (direction != "forward") == exact
    r = known.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(right_on).alias(time), payload.alias(match), rank.alias(place))
    r = r.groupBy(*keys, time).agg(F.max_by(match, place).alias(match)).withColumn(place, F.lit(0.0 if first else 2.0))
    whole = T.StructType(left.schema.fields)
    a = left.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(left_on).alias(time), F.lit(None).cast(r.schema[match].dataType).alias(match),
                    (F.rand(17) + 0.5).alias(place), F.struct(*[F.col(c) for c in left.columns]).alias(row))     # equal times are spread as well
    both = r.withColumn(row, F.lit(None).cast(whole)).unionByName(a)
    both = both.repartitionByRange(partitions or _n_parts(left), *keys, time, place).withColumn(pid, F.spark_partition_id())
    out = cut_lineage(both)
    for ahead in (False, True):
        if direction == "nearest" or ahead == (direction == "forward"):
            out = carry_over(out, keys, [time, place], match, pid, f"{match}{int(ahead)}", ahead)
    out = out.where(F.col(row).isNotNull())
    back, on = F.col(f"{match}0") if direction != "forward" else None, F.col(f"{match}1") if direction != "backward" else None
    t = F.col(time)
    if direction == "nearest":
        got = F.when(back.isNull() | ((on["at"] - t) < (t - back["at"])), on).otherwise(back)
        got = F.when(on.isNull(), back).otherwise(got)
    else:
        got = on if back is None else back
    ok = t.isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    out = out.select(row, time, F.when(ok, got).alias(match))
    if tolerance is not None:
        at = F.col(match)["at"]
        gap = F.when(at > t, at - t).otherwise(t - at)
        out = out.withColumn(match, F.when(gap <= F.expr(tolerance), F.col(match)))
    got = F.col(match)
    return out.select(f"{row}.*", got["at"].alias(right_on + suffix), *[got[f"v{i}"].alias(v + suffix) for i, v in enumerate(values)])


def _whole_number(column: F.Column, kind: T.DataType) -> F.Column:
    """A time or whole number as a long that keeps its order."""
    if isinstance(kind, T.TimestampNTZType):             # by its own fields, so that no time zone folds it
        seconds = F.unix_date(F.to_date(column)).cast("long") * 86400 + F.hour(column) * 3600 + F.minute(column) * 60
        return seconds * 1000000 + (F.date_part(F.lit("SECOND"), column) * 1000000).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    if isinstance(kind, T.IntegralType):
        return column.cast("long")
    raise ValueError(f"points and borders are dates, timestamps or whole numbers, not {kind.simpleString()}")


#: Levels of dyadic bins: lengths from 1 to 2**61.
_LEVELS = 62


def _shift(x, level):
    return F.call_function("shiftright", x, level)


def _bins(start, end):
    """[start, end) as dyadic bins (level, number): of each level at most
    the first if its number is odd, and the last if it is even."""
    def at(level):
        lo, hi = -_shift(-start, level), _shift(end, level)
        odd = lo.bitwiseAND(F.lit(1))
        low = F.when((lo < hi) & (odd == 1), F.struct(level.alias("level"), lo.alias("bin")))
        high = F.when((lo + odd < hi) & (hi.bitwiseAND(F.lit(1)) == 1), F.struct(level.alias("level"), (hi - 1).alias("bin")))
        return F.array(low, high)
    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_LEVELS - 1)), at)), lambda x: x.isNotNull())


def _cells(lo, hi):
    """The level whose bins are the shortest that are no shorter than
    [lo, hi), and the one or two bins of it that the interval meets."""
    level = F.when(hi - lo > 1, F.length(F.bin(hi - lo - 1))).otherwise(0)
    return level, F.array_distinct(F.array(_shift(lo, level), _shift(hi - 1, level)))


def interval_join(points: DataFrame, intervals: DataFrame, by: list[str], on: str, start: str, end: str,
                  closed: str = "left", suffix: str = "_interval", crowd: int = 1000) -> DataFrame:
    """Every pair of a point and an interval of the same ``by`` key with
    start <= point < end (``closed="both"``: <= end): the points' columns,
    then the intervals' (named with ``suffix`` where both have the name).

    An interval falls into the one or two bins that it meets of the level of
    its length, a point into one bin of each level that intervals have (one
    level, if all are about as long; at most 62); bins are the join's keys,
    and the borders are compared on what they bring together. In a bin of
    more than ``crowd`` intervals of a key, where that could form many pairs
    that do not match, intervals are cut further into dyadic bins (at most
    two per level), which form no other pairs. No pair is formed twice. Rows
    with a null key or border, and empty or reversed intervals, match
    nothing. Borders are dates, timestamps or whole numbers below 2**61 in
    size."""
    if closed not in ("left", "both"):
        raise ValueError("closed is 'left' or 'both'")
    p = _prefix([*points.columns, *intervals.columns])
    kind = points.schema[on].dataType
    lo, hi, x = F.col(f"{p}_lo"), F.col(f"{p}_hi"), F.col(f"{p}_x")
    keys = [f"{p}_k{i}" for i in range(len(by))]
    iv = intervals.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.struct(*[F.col(c) for c in intervals.columns]).alias(f"{p}_iv"),
                          _whole_number(F.col(start), intervals.schema[start].dataType).alias(f"{p}_lo"),
                          (_whole_number(F.col(end), intervals.schema[end].dataType) + (1 if closed == "both" else 0)).alias(f"{p}_hi")).where(lo < hi)
    pt = points.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.struct(*[F.col(c) for c in points.columns]).alias(f"{p}_pt"),
                       _whole_number(F.col(on), kind).alias(f"{p}_x")).where(x.isNotNull())
    for k in keys:
        iv, pt = iv.where(F.col(k).isNotNull()), pt.where(F.col(k).isNotNull())
    level, bins = _cells(lo, hi)
    levels = sorted(r[0] for r in iv.select(level).distinct().collect())            # at most 63 numbers
    iv = iv.withColumn(f"{p}_level", level).withColumn(f"{p}_bin", F.explode(bins))
    pt = pt.withColumn(f"{p}_level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
    pt = pt.withColumn(f"{p}_bin", _shift(x, F.col(f"{p}_level")))
    cell = [*keys, f"{p}_level", f"{p}_bin"]
    crowded = cut_lineage(iv.groupBy(*cell).count().where(F.col("count") > crowd).select(*cell))
    if crowded.isEmpty():
        j = pt.join(iv, cell).where((lo <= x) & (x < hi)).select(f"{p}_pt", f"{p}_iv")
    else:
        j = pt.join(iv.join(crowded, cell, "left_anti"), cell).where((lo <= x) & (x < hi)).select(f"{p}_pt", f"{p}_iv")
        at = lambda n: F.call_function("shiftleft", n, F.col(f"{p}_level"))
        n = F.col(f"{p}_bin")
        part = _bins(F.greatest(lo, at(n)), F.least(hi, at(n + 1)))                 # what lies in the bin
        fine = iv.join(crowded, cell, "left_semi").withColumn(f"{p}_b", F.explode(part))
        fine = fine.select(*cell, f"{p}_iv", F.col(f"{p}_b.level").alias(f"{p}_l"), F.col(f"{p}_b.bin").alias(f"{p}_n"))
        near = pt.join(crowded, cell, "left_semi").withColumn(f"{p}_l", F.explode(F.sequence(F.lit(0), F.least(F.col(f"{p}_level"), F.lit(_LEVELS - 1)))))
        near = near.withColumn(f"{p}_n", _shift(x, F.col(f"{p}_l")))
        j = j.unionByName(near.join(fine, [*cell, f"{p}_l", f"{p}_n"]).select(f"{p}_pt", f"{p}_iv"))
    names = {c.lower() for c in points.columns}
    return j.select(f"{p}_pt.*", *[F.col(f"{p}_iv")[c].alias(c + suffix if c.lower() in names else c) for c in intervals.columns])


def overlap_join(a: DataFrame, b: DataFrame, by: list[str], start: str, end: str, suffix: str = "_b") -> DataFrame:
    """Every pair of intervals [start, end) of the same key that overlap:
    either the first starts in the second, or the second strictly inside the
    first, two point-in-interval joins that share no pair. ``b``'s columns
    are named with ``suffix``. Nulls and empty intervals as there."""
    b = b.select(*[F.col(c).alias(c + suffix) for c in b.columns])
    some = a.where(F.col(start) < F.col(end))
    one = interval_join(some.select("*", *[F.col(k).alias(k + suffix) for k in by]), b, [k + suffix for k in by], start, start + suffix,
                        end + suffix, suffix="__").drop(*[k + suffix + "__" for k in by])
    two = interval_join(b.where(F.col(start + suffix) < F.col(end + suffix)).select("*", *[F.col(k + suffix).alias(k) for k in by]), a, by,
                        start + suffix, start, end, suffix="__").drop(*[k + "__" for k in by])
    two = two.where(F.col(start + suffix) > F.col(start))
    columns = [*a.columns, *b.columns]
    return one.select(*columns).unionByName(two.select(*columns))
