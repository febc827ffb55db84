"""SparkSession construction and cluster-safe helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every kestrel job relies on. AQE re-plans joins (broadcast vs
# sort-merge) from runtime sizes and splits skewed shuffle partitions; ANSI
# mode stays on, which is why the library uses try_cast / try_divide.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "kestrel", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with kestrel's defaults.

    On a cluster the master and shuffle partitions come from spark-submit;
    locally (tests, bench) pass ``master="local[8]"``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_CHECKPOINT_SET: dict = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be a shared file system path set by the
    deployment; we only invent a local one when nothing is configured
    (unit tests on a laptop).
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="kestrel-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if _CHECKPOINT_SET.get(sc.applicationId) != d:
        sc.setCheckpointDir(d)
        _CHECKPOINT_SET[sc.applicationId] = d
    return d


def cut_lineage(df, mode: str | None = None, **options):
    """Cut lineage into the shared checkpoint folder (survives executor
    loss; never localCheckpoint).

    Default: write the DataFrame as a Parquet table under
    ``spark.checkpoint.dir`` and read it back - a columnar, vectorised
    re-read that also carries file-size statistics, so AQE can broadcast a
    small derived table. ``mode='rdd'`` uses ``DataFrame.checkpoint``.
    Override the default with the session conf ``kestrel.cutLineage``.
    ``options`` are of the Parquet writer."""
    import uuid
    spark = df.sparkSession
    d = ensure_checkpoint_dir(spark)
    mode = mode or spark.conf.get("kestrel.cutLineage", "parquet")
    if mode == "rdd":
        return df.checkpoint(eager=True)
    path = f"{d.rstrip('/')}/kestrel-tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.parquet(path)


_SHIPPED: dict = {}


def ship_package(spark: SparkSession) -> None:
    """Make ``kestrel`` importable in Python workers (the ``--py-files``
    mechanism): zip the package once per process and register it with
    ``SparkContext.addPyFile`` once per context. Spark's file server then
    hands it to every executor. Not needed when the package is installed
    on the executors."""
    import hashlib
    import zipfile
    sc = spark.sparkContext
    if _SHIPPED.get(sc.applicationId):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    files = []
    for dirpath, dirnames, filenames in os.walk(pkg):
        dirnames[:] = [d for d in dirnames if d != "__pycache__"]
        files += [os.path.join(dirpath, f) for f in sorted(filenames) if f.endswith(".py")]
    digest = hashlib.sha1()
    for f in sorted(files):
        with open(f, "rb") as fh:
            digest.update(f.encode() + fh.read())
    out_dir = os.path.join(root, ".kestrel_dist")
    try:
        os.makedirs(out_dir, exist_ok=True)
    except OSError:
        out_dir = tempfile.mkdtemp(prefix="kestrel-dist-")
    path = os.path.join(out_dir, f"kestrel-{digest.hexdigest()[:12]}.zip")
    if not os.path.exists(path):
        tmp = path + f".{os.getpid()}.part"
        with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED) as z:
            for f in files:
                z.write(f, os.path.relpath(f, root))
        os.replace(tmp, path)
    sc.addPyFile(path)
    _SHIPPED[sc.applicationId] = path


def env_master(default: str = "local[8]") -> str:
    cpus = os.environ.get("BENCH_CPUS")
    return f"local[{cpus}]" if cpus else default
