"""As-of and interval joins against brute force."""
import random

import pytest
from pyspark.sql import functions as F

from kestrel.operators import temporal as TM

R = random.Random(1)
LEFT = [(i, R.choice(["a", "a", "a", "b", "c", None]), R.choice([None, *range(60)])) for i in range(400)]
RIGHT = [(R.choice(["a", "a", "b", None]), R.choice([None, *range(60)]), i) for i in range(60)]
SPANS = [(R.choice(["a", "a", "b", None]), R.randint(-50, 50), R.choice([None, *range(-60, 200)]), i) for i in range(150)]


def brute(direction, tolerance, exact):
    out = []
    for i, k, t in LEFT:
        near = [] if k is None or t is None else [(u, v) for kk, u, v in RIGHT if kk == k and u is not None]
        back = max((x for x in near if x[0] < t or (exact and x[0] == t)), default=None)
        ahead = [x for x in near if x[0] > t or (exact and x[0] == t)]
        ahead = max((x for x in ahead if x[0] == min(u for u, _ in ahead)), default=None)
        m = back if direction == "backward" else ahead
        if direction == "nearest":
            m = back if ahead is None else ahead if back is None or ahead[0] - t < t - back[0] else back
        if m and tolerance is not None and abs(m[0] - t) > tolerance:
            m = None
        out.append((i, k, t, *(m or (None, None))))
    return out


@pytest.mark.parametrize("direction,exact", [("backward", True), ("backward", False), ("forward", True), ("forward", False), ("nearest", True)])
def test_as_of(spark, direction, exact):
    left = spark.createDataFrame(LEFT, "id int, k string, t int")
    right = spark.createDataFrame(RIGHT, "k string, u int, v int")
    for tolerance, parts in ((None, 1), (None, 7), (3, 7)):
        got = TM.as_of_join(left, right, ["k"], "t", "u", ["v"], direction, tolerance and str(tolerance), exact, partitions=parts)
        assert got.columns == ["id", "k", "t", "u", "v"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(direction, tolerance, exact), key=repr)


def test_as_of_edges(spark):
    """Clashing names and a suffix, ties by a column, no keys, repeated left
    rows, empty sides."""
    left = spark.createDataFrame([(5, "x"), (5, "x"), (1, "y"), (None, "z")], "t int, _t_match string")
    right = spark.createDataFrame([(3, 1, 9), (3, 2, 8), (7, 1, 7)], "t int, o int, _t_time int")
    got = TM.as_of_join(left, right, [], "t", "t", ["_t_time"], tiebreak=["o"], suffix="_r")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(5, "x", 3, 8), (5, "x", 3, 8), (1, "y", None, None), (None, "z", None, None)], key=repr)
    assert TM.as_of_join(left.where("false"), right, [], "t", "t", [], suffix="_r").count() == 0
    assert {r["t_r"] for r in TM.as_of_join(left, right.where("false"), [], "t", "t", [], suffix="_r").collect()} == {None}
    with pytest.raises(ValueError):
        TM.as_of_join(left, right, [], "t", "t", [], "sideways")


def test_hot_key_is_spread(spark):
    """Two thirds of the rows in one key, most at one time: no partition of
    the united table holds them together, and matches cross partitions."""
    left = spark.range(30000).select(F.lit("hot").alias("k"), F.when(F.col("id") % 3 > 0, F.lit(500)).otherwise(F.col("id") % 1000).cast("int").alias("t"), "id")
    right = spark.createDataFrame([("hot", 10, 1), ("hot", 500, 2), ("cold", 3, 3)], "k string, u int, v int")
    got = TM.as_of_join(left, right, ["k"], "t", "u", ["v"], partitions=16)
    n = {r["v"]: r["count"] for r in got.groupBy("v").count().collect()}
    want = {}
    for i in range(30000):
        t = 500 if i % 3 else i % 1000
        v = None if t < 10 else 1 if t < 500 else 2
        want[v] = want.get(v, 0) + 1
    assert n == want
    both = got.select("k", "t", "id").repartitionByRange(16, "k", "t", F.rand(17))
    assert max(r["count"] for r in both.groupBy(F.spark_partition_id()).count().collect()) < 6000


@pytest.mark.parametrize("closed", ["left", "both"])
def test_interval(spark, closed):
    points, spans = spark.createDataFrame(LEFT, "id int, k string, t int"), spark.createDataFrame(SPANS, "k string, s int, e int, n int")
    got = TM.interval_join(points, spans, ["k"], "t", "s", "e", closed)
    assert got.columns == ["id", "k", "t", "k_interval", "s", "e", "n"]
    want = [(*a, *b) for a in LEFT for b in SPANS if None not in (a[1], a[2], b[2]) and a[1] == b[0] and b[1] <= a[2]
            and (a[2] < b[2] or (closed == "both" and a[2] == b[2] >= b[1]))]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert TM.interval_join(points.where("false"), spans, ["k"], "t", "s", "e").count() == 0
    assert TM.interval_join(points, spans.where("false"), ["k"], "t", "s", "e").count() == 0


def test_overlaps(spark):
    spans = spark.createDataFrame(SPANS, "k string, s int, e int, n int")
    ok = [x for x in SPANS if x[0] is not None and x[2] is not None and x[1] < x[2]]
    want = [(*a, *b) for a in ok for b in ok if a[0] == b[0] and a[1] < b[2] and b[1] < a[2]]
    assert sorted(map(tuple, TM.overlap_join(spans, spans, ["k"], "s", "e").collect())) == sorted(want)


@pytest.mark.parametrize("closed", ["left", "both"])
def test_crowded_bins(spark, closed):
    """Bins with more intervals than ``crowd`` give the same pairs, next to
    bins with fewer and with lengths of several levels."""
    points = spark.createDataFrame(LEFT + LEFT[:30], "id int, k string, t int")
    spans = spark.createDataFrame(SPANS + SPANS[:20], "k string, s int, e int, n int")
    want = sorted(map(tuple, TM.interval_join(points, spans, ["k"], "t", "s", "e", closed).collect()))
    for crowd in (0, 1, 4):
        assert sorted(map(tuple, TM.interval_join(points, spans, ["k"], "t", "s", "e", closed, crowd=crowd).collect())) == want


def test_few_copies(spark, monkeypatch):
    """Six hours in microseconds: the join gets each interval at most twice
    and each point once."""
    spans = spark.range(40).selectExpr("id % 3 AS k", "id * 5000000007 AS s", "id * 5000000007 + 21600000000 AS e")
    points = spark.range(200).selectExpr("id % 3 AS k", "id * 1000000007 AS t")
    sizes, join = [], type(points).join

    def counted(self, other, *a, **kw):
        sizes.append((self.count(), other.count()))
        return join(self, other, *a, **kw)

    monkeypatch.setattr(type(points), "join", counted)
    TM.interval_join(points, spans, ["k"], "t", "s", "e")
    assert sizes and all(a <= 200 and b <= 80 for a, b in sizes)


def test_few_bins(spark):
    """A span of a hundred years in microseconds is a few dozen bins, which
    cover it exactly once."""
    rows = [(-3155760000000000, 3155760000000001), (5, 6), (0, 1 << 50), (-7, 9)]
    df = spark.createDataFrame(rows, "s long, e long").select("s", "e", F.explode(TM._bins(F.col("s"), F.col("e"))).alias("b")).select("s", "e", "b.*")
    held = {}
    for r in df.collect():
        held.setdefault((r["s"], r["e"]), []).append((r["bin"] << r["level"], (r["bin"] + 1) << r["level"]))
    for (s, e), parts in held.items():
        parts.sort()
        assert len(parts) <= 104 and parts[0][0] == s and parts[-1][1] == e and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert len(held) == 4


def test_times(spark):
    """Dates, timestamps and zone-free timestamps as borders."""
    rows = spark.sql("SELECT timestamp_ntz'1969-12-31 23:59:59.999999' AS a, timestamp'2024-02-29 12:00:00' AS b, date'1960-01-01' AS c")
    for c, step in (("a", "INTERVAL 1 MICROSECOND"), ("b", "INTERVAL 1 SECOND"), ("c", "INTERVAL 1 DAY")):
        spans = rows.select(F.col(c).alias("s"), (F.col(c) + F.expr(step)).cast(rows.schema[c].dataType).alias("e"))
        inside = TM.interval_join(rows.select(F.col(c).alias("p")), spans, [], "p", "s", "e")
        behind = TM.interval_join(spans.select(F.col("e").alias("p")), spans, [], "p", "s", "e")
        assert inside.count() == 1 and behind.count() == 0
