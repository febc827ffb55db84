"""LG1-LG5: run-ledger queries over a table of status events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators.ranks import ordered_lag
from kestrel.session import cut_lineage

# Run states and the allowed transitions between them
# (a state may always repeat).
ALLOWED_TRANSITIONS = {
    "queued": ("running", "completed", "failed"),
    "running": ("completed", "failed"),
    "completed": (),
    "failed": (),
}

# Artifact types. The first rule that fits counts; paths are
# compared in lower case, names are what follows the last slash.
ARTIFACT_TYPES = (
    ("chart", "path starts with", "charts/"),
    ("chart", "name starts with qa_ and ends with", ".png"),
    ("markdown_report", "name is", "final_report.md"),
    ("cleaned_csv", "name is", "cleaned.csv"),
    ("profile_json", "name is", "data_profile.json"),
    ("validation_json", "name is", "quality_report.json"),
    ("sql_query", "name ends with", ".sql"),
    ("json", "name ends with", ".json"),
    ("csv", "name ends with", ".csv"),
    ("markdown", "name ends with", ".md"),
    ("text", "name ends with", ".txt"),
)
OTHER_ARTIFACT = "artifact"


def transition_table(spark) -> DataFrame:
    rows = [(a, b) for a, bs in ALLOWED_TRANSITIONS.items() for b in (a, *bs)]
    return spark.createDataFrame(rows, "from_status string, to_status string")


def run_transitions(events: DataFrame, run_col: str, ts_col: str, status_col: str,
                    tiebreak: str | None = None) -> DataFrame:
    """LG1: every status change with its predecessor and whether it is
    allowed. The predecessor comes from ``ordered_lag`` (range partitions,
    no per-run task). The allowed-transition table has a fixed size and is
    broadcast."""
    order = [ts_col] + ([tiebreak] if tiebreak else [])
    ev = events.select(run_col, *order, F.col(status_col).alias("to_status"))
    lagged = ordered_lag(ev, [run_col], order, "to_status", name="from_status")
    allowed = transition_table(events.sparkSession).withColumn("_ok", F.lit(True))
    j = lagged.where(F.col("from_status").isNotNull()).join(allowed, ["from_status", "to_status"], "left")
    return j.select(run_col, *order, "from_status", "to_status", F.coalesce("_ok", F.lit(False)).alias("allowed"))


def run_state(events: DataFrame, run_col: str, ts_col: str, status_col: str, error_col: str | None = None,
              tiebreak: str | None = None) -> DataFrame:
    """LG2: current status (latest event), first start and first end
    timestamps, number of events and the last error - partial aggregates,
    so a run with many events never collects in one task."""
    order = F.struct(ts_col, tiebreak) if tiebreak else F.col(ts_col)
    terminal = F.col(status_col).isin("completed", "failed")
    aggs = [F.max_by(status_col, order).alias("status"),
            F.min(F.when(F.col(status_col) == "running", F.col(ts_col))).alias("started_at"),
            F.min(F.when(terminal, F.col(ts_col))).alias("completed_at"),
            F.count(F.lit(1)).alias("n_events")]
    if error_col:
        aggs.append(F.max_by(F.when(F.col(status_col) == "failed", F.col(error_col)),
                             F.when(F.col(status_col) == "failed", order)).alias("last_error"))
    return events.groupBy(run_col).agg(*aggs)


def artifact_upsert(artifacts: DataFrame, run_col: str, path_col: str, ts_col: str, tiebreak: str | None = None) -> DataFrame:
    """LG3: one row per (run, path), the latest write wins, of writes at one
    time the one with the largest ``tiebreak`` (then the largest row as
    JSON, so that the result never depends on the order of reading). max_by
    is a partial aggregate."""
    others = [c for c in artifacts.columns if c not in (run_col, path_col)]
    row = F.struct(*others)
    order = F.struct(ts_col, *([tiebreak] if tiebreak else []), F.to_json(row))
    latest = artifacts.groupBy(run_col, path_col).agg(F.max_by(row, order).alias("_r"), F.count(F.lit(1)).alias("n_writes"))
    return latest.select(run_col, path_col, "_r.*", "n_writes")


def artifact_type(path: F.Column) -> F.Column:
    """LG4: artifact type from the path (null for a null path)."""
    p = F.lower(path)
    name = F.regexp_extract(p, "([^/]*)/*$", 1)
    tests = {"path starts with": lambda v: p.startswith(v), "name is": lambda v: name == v, "name ends with": lambda v: name.endswith(v),
             "name starts with qa_ and ends with": lambda v: name.startswith("qa_") & name.endswith(v)}
    return F.coalesce(*[F.when(tests[test](value), F.lit(kind)) for kind, test, value in ARTIFACT_TYPES],
                      F.when(path.isNotNull(), F.lit(OTHER_ARTIFACT)))


def run_metadata(events: DataFrame, run_col: str, ts_col: str, metadata_col: str, tiebreak: str | None = None,
                 deep: bool = False) -> DataFrame:
    """LG2: the runs' merged metadata, one row per key: (run, key, value).

    ``metadata_col`` holds a JSON object per event; a key's last write wins,
    of writes at one time the one with the largest ``tiebreak`` (then the
    larger text). With ``deep`` nested objects merge key by key as well:
    ``key`` is then the path (``a.b``), a write of another kind of value
    replaces what stood below its path, and an object that is written over
    a value replaces it. Values are JSON texts. Texts that are no object,
    and null, add nothing. A run with many events costs partial aggregates,
    never one task."""
    spark = events.sparkSession
    order = F.struct(ts_col, *([tiebreak] if tiebreak else []))
    rows = events.select(F.col(run_col).alias("run"), order.alias("at"), F.try_parse_json(F.col(metadata_col).cast("string")).alias("v"))
    rows = rows.where("v IS NOT NULL").select("run", "at", "v", F.lit("").alias("key"))
    leaves, last = None, None
    while True:
        one = rows.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("k"), F.col("value").alias("x")))
        one = one.where("k IS NOT NULL").select("run", "at", F.concat("key", F.when(F.col("key") != "", F.lit(".")).otherwise(F.lit("")), "k").alias("key"),
                                                F.col("x").alias("v"), F.schema_of_variant("x").startswith("OBJECT").alias("nested"))
        one = one.withColumn("text", F.to_json("v"))
        if not deep:
            leaves = one.groupBy("run", "key").agg(F.max_by("text", F.struct("at", "text")).alias("value"))
            break
        one = cut_lineage(one.withColumn("v", F.col("text")))
        # every write of a path, value or object, puts an end to values of the other kind written before it
        flat = one.where(~F.col("nested")).groupBy("run", "key").agg(F.max(F.struct("at", "text")).alias("w"))
        leaves = flat if leaves is None else leaves.unionByName(flat)
        objects = one.where("nested").groupBy("run", "key").agg(F.max("at").alias("object_at"))
        last = objects if last is None else last.unionByName(objects)
        rows = one.where("nested").select("run", "at", F.parse_json("v").alias("v"), "key")
        if rows.isEmpty():
            break
    if deep:
        leaves, last = cut_lineage(leaves), cut_lineage(last)
        values = leaves.select("run", F.col("key").alias("path"), F.col("w.at").alias("value_at"))
        live = leaves.join(last, ["run", "key"], "left").where("object_at IS NULL OR w.at >= object_at").drop("object_at")
        # the paths above a leaf, each an equi-join: a value written there later replaces it
        above = F.expr("transform(sequence(1, size(split(key, '[.]'))), i -> array_join(slice(split(key, '[.]'), 1, i), '.'))")
        up = live.select("run", "key", "w", F.explode(above).alias("path")).where("path <> key")
        gone = up.join(values, ["run", "path"]).where("value_at > w.at").select("run", "key").distinct()
        leaves = live.join(gone, ["run", "key"], "left_anti").select("run", "key", F.col("w.text").alias("value"))
    return leaves.select(F.col("run").alias(run_col), "key", "value")


def run_details(runs: DataFrame, artifacts: DataFrame, run_col: str, user_col: str | None = None, user=None) -> DataFrame:
    """LG5: runs with their artifacts, one row per artifact (runs without
    any stay, with nulls); ``user`` keeps one user's runs. Columns that both
    sides have are the run's, the artifact's named ``artifact_<name>``."""
    if user_col is not None:
        runs = runs.where(F.col(user_col) == F.lit(user))
    names = {c.lower() for c in runs.columns}
    side = artifacts.select(F.col(run_col).alias("_of"), *[F.col(c).alias(f"artifact_{c}" if c.lower() in names else c)
                                                           for c in artifacts.columns if c != run_col])
    return runs.join(side, F.col(run_col) == F.col("_of"), "left").drop("_of")


def run_listing(runs: DataFrame, user_col: str, user, created_col: str, limit: int = 20,
                offset: int = 0, tiebreak: str | None = None) -> DataFrame:
    """LG5: one user's runs, newest first (``tiebreak`` desc on equal
    timestamps), one page."""
    order = [F.col(created_col).desc()] + ([F.col(tiebreak).desc()] if tiebreak else [])
    return (runs.where(F.col(user_col) == F.lit(user)).orderBy(*order)
            .offset(int(offset)).limit(int(limit)))
