"""LG1/LG2 on streams in event-time order (``transformWithStateInPandas``).

A run's events wait in list state until the watermark has passed them, so
that events which arrive out of order, in any files and micro-batches, give
the same transitions as the batch operator. Runs share their state in a fixed
number of buckets, as a call per state and run takes far longer than its rows.
An event-time timer per bucket wakes it up at its earliest waiting event; a
second use of the timer drops runs that ended long ago. State is bounded: the
events of the watermark's delay, and one small row per live run.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kestrel.operators.ledger import ALLOWED_TRANSITIONS
from kestrel.streaming.incremental import read_parquet_stream, stream_folder

_ALLOWED = {(a, b) for a, bs in ALLOWED_TRANSITIONS.items() for b in (a, *bs)}
_ENDED = {a for a, bs in ALLOWED_TRANSITIONS.items() if not bs}


#: Groups of runs that share their state, fixed for a folder.
BUCKETS = 1024


class OrderedTransitions(StatefulProcessor):
    """Per bucket of runs, so that state is read and written once a batch for
    many of them: waiting events (run, micros, tiebreak, status) in ``held``;
    each run's last emitted status and its time in ``last``; the timer set in
    ``timer``."""

    def __init__(self, columns: tuple, retention_ms: int | None, run_type: str):
        self.columns, self.retention_ms, self.run_type = columns, retention_ms, run_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", f"run {self.run_type}, ts long, tb string, status string")
        self.last = handle.getListState("last", f"run {self.run_type}, status string, ts long")
        self.timer = handle.getValueState("timer", "at long")

    def _advance(self, events, watermark_ms: int):
        """Emits what the watermark has passed, keeps the rest, sets the
        timer at the earliest waiting event or end of a run's life."""
        last = {r[0]: (r[1], r[2]) for r in self.last.get()} if self.last.exists() else {}
        held = self.held.exists()
        events = [*(tuple(e) for e in self.held.get()), *events] if held else events
        # the tiebreak travels as text; whole numbers keep their order by length, then text
        events.sort(key=lambda e: (e[1], len(e[2]) if e[2].isdigit() else 0, e[2], e[3] or ""))
        limit = watermark_ms * 1000
        out, n = [], 0
        for run, ts, tb, status in events:
            if ts > limit:
                break
            n += 1
            prev, since = last.get(run, (None, None))
            if self.retention_ms is not None and prev in _ENDED and ts - since >= 1000 * self.retention_ms:
                prev = None                          # forgotten, whether or not its timer has fired yet
            if prev is not None and status is not None:
                out.append((run, ts, tb, prev, status, (prev, status) in _ALLOWED))
            if status is not None:
                last[run] = status, ts
        rest = events[n:]
        due = -(-rest[0][1] // 1000) if rest else None
        old = []
        if self.retention_ms is not None:
            waiting = {e[0] for e in rest}
            for run, (status, since) in last.items():
                if status in _ENDED and run not in waiting:
                    end = since // 1000 + self.retention_ms
                    if end <= watermark_ms:          # ended long ago: nothing is kept
                        old.append(run)
                    else:
                        due = end if due is None else min(due, end)
            for run in old:
                del last[run]
        if rest:
            self.held.put(rest)
        elif held:
            self.held.clear()
        if n or old:
            if last:
                self.last.put([(run, *x) for run, x in last.items()])
            else:
                self.last.clear()
        timer = self.timer.get()[0] if self.timer.exists() else None
        if due != timer:
            if timer is not None and timer > watermark_ms:
                self.handle.deleteTimer(timer)
            if due is None:
                self.timer.clear()
            else:
                self.handle.registerTimer(due)
                self.timer.update((due,))
        return self._frame(out)

    def _frame(self, rows):
        run, ts, tb = self.columns
        df = pd.DataFrame(rows, columns=[run, ts, tb, "from_status", "to_status", "allowed"])
        df[ts] = pd.to_datetime(df[ts].astype("int64"), unit="us", utc=True)
        return df

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None or key[0] != key[0]:           # rows that only move the watermark
            yield self._frame([])
            return
        events = []
        for pdf in rows:
            run, micros, tie, status = (pdf.iloc[:, i] for i in (1, 3, 4, 5))
            events += zip(run.tolist(), micros.astype("int64").tolist(), tie.astype(str).tolist(), [s if isinstance(s, str) else None for s in status.tolist()])
        yield self._advance(events, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance([], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def ordered_transitions(stream: DataFrame, run_col: str, ts_col: str, status_col: str, tiebreak: str,
                        delay: str = "1 day", retention: str | None = None) -> DataFrame:
    """LG1 on a stream, in event-time order: (run, ts, tiebreak, from_status,
    to_status, allowed), each row once, when the watermark (the latest event
    time seen minus ``delay``) has passed its event.

    Events of one run are ordered by time, then ``tiebreak`` (a whole number
    or text). Rows that come later than ``delay`` are dropped by Spark and
    counted (``late_rows``); rows without time or run are ignored, and rows
    without status change nothing. With ``retention`` (``30 days``) a run
    whose last status is final is forgotten that long after it; an event
    after that starts it anew. The stream needs the RocksDB state store
    (``run_ordered`` sets it for its query)."""
    ms = None
    if retention is not None:
        ms = int(stream.sparkSession.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {retention})").first()[0])
    key, tie = stream.schema[run_col].dataType, stream.schema[tiebreak].dataType
    ts = F.col(ts_col).cast("timestamp")
    bucket = F.when(F.col(run_col).isNotNull(), F.pmod(F.xxhash64(run_col), F.lit(BUCKETS)).cast("int"))
    rows = (stream.select(bucket.alias("_bucket"), F.col(run_col), ts.alias(ts_col), F.unix_micros(ts).alias("_us"), F.col(tiebreak).cast("string").alias("_tb"),
                          F.col(status_col).cast("string").alias("_status"))
            .where(F.col(ts_col).isNotNull()).withWatermark(ts_col, delay)
            # a closing row moves the watermark, so it must get as far as here and one step on
            .where(F.col(run_col).isNotNull() | (F.col("_tb").isNull() & F.col("_status").isNull())))
    schema = T.StructType([T.StructField(run_col, key), T.StructField(ts_col, T.TimestampType()), T.StructField(tiebreak, T.StringType()),
                           T.StructField("from_status", T.StringType()), T.StructField("to_status", T.StringType()),
                           T.StructField("allowed", T.BooleanType())])
    out = rows.groupBy("_bucket").transformWithStateInPandas(OrderedTransitions((run_col, ts_col, tiebreak), ms, key.simpleString()), schema, "append", "EventTime")
    return out.withColumn(tiebreak, F.col(tiebreak).cast(tie))


@contextmanager
def _state_store(spark: SparkSession, partitions: int | None = None):
    """The conf that a query takes over when it starts, put back after."""
    want = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.streaming.numRecentProgressUpdates": "100000"}
    if partitions:
        want["spark.sql.shuffle.partitions"] = str(partitions)
    had = {k: spark.conf.get(k, None) for k in want}
    try:
        for k, v in want.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in had.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def run_ordered(stream: DataFrame, folder: str, partitions: int | None = None) -> dict:
    """Runs ``ordered_transitions`` over all that its source holds now and
    appends to ``<folder>/data``; the same folder later goes on where this
    run stopped. ``partitions`` of the state (default: the session's shuffle
    partitions) are fixed by a folder's first run. Returns the run's batches,
    rows that were too late and state rows that are left."""
    spark = stream.sparkSession
    with _state_store(spark, partitions):
        q = (stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/data")
             .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
        seen = q.recentProgress
    ops = [o for p in seen for o in p["stateOperators"]]
    return {"batches": len(seen), "late_rows": sum(o["numRowsDroppedByWatermark"] for o in ops),
            "state_rows": ops[-1]["numRowsTotal"] if ops else 0}


def seal(spark: SparkSession, source: str, schema: T.StructType, run_col: str, ts_col: str, delay: str) -> None:
    """Closes a folder of events: adds one row that holds only a time, so far
    behind the last that the watermark passes every waiting event."""
    end = spark.read.schema(schema).parquet(source).agg(
        (F.max(F.col(ts_col).cast("timestamp")) + F.expr(f"INTERVAL {delay}") * 2 + F.expr("INTERVAL 1 SECOND")).alias("t"))
    row = end.select(*[(F.col("t") if f.name == ts_col else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
    row.where(F.col(ts_col).isNotNull()).coalesce(1).write.mode("append").parquet(source)


def replay_ordered(arrivals: list[DataFrame], run_col: str, ts_col: str, status_col: str, tiebreak: str, delay: str = "1 day",
                   retention: str | None = None, max_files: int | None = None, partitions: int | None = None) -> tuple[DataFrame, list[dict]]:
    """Feeds tables to the stream one after another, each by a run that goes
    on from the checkpoint of the one before, then closes it. Returns the
    transitions (``seal``'s row has none) and each run's figures."""
    spark = arrivals[0].sparkSession
    base = stream_folder(spark, f"ledger-{uuid.uuid4().hex[:6]}")
    schema, figures = arrivals[0].schema, []
    for i in range(len(arrivals) + 1):
        if i < len(arrivals):
            arrivals[i].write.mode("append").parquet(f"{base}/events")
        else:
            seal(spark, f"{base}/events", schema, run_col, ts_col, delay)
        # the closing row has no run: it moves the watermark before the operator ignores it
        stream = read_parquet_stream(spark, f"{base}/events", max_files if i < len(arrivals) else None)
        figures.append(run_ordered(ordered_transitions(stream, run_col, ts_col, status_col, tiebreak, delay, retention), f"{base}/out", partitions))
    kind = ordered_transitions(read_parquet_stream(spark, f"{base}/events"), run_col, ts_col, status_col, tiebreak, delay, retention).schema
    return spark.read.schema(kind).parquet(f"{base}/out/data"), figures
