"""The ordered streaming ledger equals the batch operator."""
import datetime as dt
import random

import pytest

from kestrel.operators import ledger as LG
from kestrel.streaming import ledger as SL

R = random.Random(6)
T0 = dt.datetime(2024, 1, 1)
SCHEMA = "run string, ts timestamp, id int, status string"


@pytest.fixture(scope="module")
def events():
    rows = []
    for i in range(260):
        ts = T0 + dt.timedelta(minutes=10 * i + R.randint(0, 5) * 2)
        rows.append((R.choice(["a", "a", "b", "c"]), ts, i, R.choice(["queued", "running", "completed", "failed"])))
    rows += [("a", rows[50][1], 1000, "failed"), ("a", rows[50][1], 999, "running"), ("b", rows[60][1], 1001, None)]
    return rows


def batch(spark, rows):
    df = spark.createDataFrame([r for r in rows if r[0] is not None and r[1] is not None and r[3] is not None], SCHEMA)
    out = LG.run_transitions(df, "run", "ts", "status", tiebreak="id")
    return sorted(map(tuple, out.select("run", "ts", "id", "from_status", "to_status", "allowed").collect()), key=repr)


def result(df):
    return sorted(map(tuple, df.select("run", "ts", "id", "from_status", "to_status", "allowed").collect()), key=repr)


def test_out_of_order_files(spark, events):
    """Files hold events up to five hours out of order, one file a batch."""
    at = {r[2]: r[1] + dt.timedelta(minutes=R.randint(0, 290)) for r in events}
    order = sorted(events, key=lambda r: at[r[2]])
    size = -(-len(order) // 6)
    rows = [order[i:i + size] for i in range(0, len(order), size)]
    rows[2] = rows[2] + [(None, order[2 * size][1], 5000, "running"), ("a", None, 5001, "running")]
    arrivals = [spark.createDataFrame(x, SCHEMA).coalesce(1) for x in rows]
    out, figures = SL.replay_ordered(arrivals, "run", "ts", "status", "id", delay="6 hours", max_files=1)
    assert result(out) == batch(spark, events)
    assert sum(f["late_rows"] for f in figures) == 0 and all(f["batches"] for f in figures)


def test_late_rows_and_retention(spark):
    """Rows behind the watermark are counted and change nothing; a run that
    ended is forgotten, so its later event starts it anew."""
    h = lambda n: T0 + dt.timedelta(hours=n)
    first = [("a", h(0), 1, "queued"), ("a", h(1), 2, "completed"), ("b", h(1), 3, "queued"), ("c", h(20), 4, "queued")]
    second = [("a", h(2), 5, "running"), ("c", h(21), 6, "running")]            # the first of them is late
    third = [("a", h(60), 7, "queued"), ("b", h(61), 8, "running"), ("c", h(90), 9, "failed")]
    arrivals = [spark.createDataFrame(x, SCHEMA).coalesce(1) for x in (first, second, third)]
    out, figures = SL.replay_ordered(arrivals, "run", "ts", "status", "id", delay="3 hours", retention="30 hours")
    got = [(r["run"], r["id"], r["from_status"], r["to_status"], r["allowed"]) for r in out.collect()]
    assert sorted(got) == [("a", 2, "queued", "completed", True), ("b", 8, "queued", "running", True), ("c", 6, "queued", "running", True),
                           ("c", 9, "running", "failed", True)]
    assert sum(f["late_rows"] for f in figures) == 1


def test_runs_share_state(spark, monkeypatch):
    """Many runs in two buckets: the transitions of the batch operator, and
    no timer or state of a run's own."""
    monkeypatch.setattr(SL, "BUCKETS", 2)
    rows = [(f"r{i % 90}", T0 + dt.timedelta(minutes=7 * i), i, R.choice(["queued", "running", "completed", "failed", None])) for i in range(400)]
    order = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=R.randint(0, 100)))
    arrivals = [spark.createDataFrame(order[i:i + 200], SCHEMA).coalesce(1) for i in (0, 200)]
    out, figures = SL.replay_ordered(arrivals, "run", "ts", "status", "id", delay="3 hours")
    assert result(out) == batch(spark, rows) and len({r[0] for r in result(out)}) > 50
    assert sum(f["late_rows"] for f in figures) == 0
