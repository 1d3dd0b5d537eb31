"""Session helpers: table loading, checkpoint folder, size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest side (bytes, as estimated by Catalyst) that helpers will hint for broadcast.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(app: str = "grainset", cores: str = "*", partitions: int = 8) -> SparkSession:
    """Local session used by tests and the bench; cluster jobs bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be configured (a shared filesystem). Only a local
    session without one gets a fresh private folder, as in tests.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns spark.checkpoint.dir
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="grainset-ckpt-"))
    return sc.getCheckpointDir()


def shared_table_path(spark: SparkSession, kind: str = "") -> str:
    """A new path in the shared checkpoint folder, removed by ``cleanup_checkpoints``."""
    import uuid

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/grainset-{kind}{uuid.uuid4().hex}"
    _track_table(spark, path)
    return path


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage by writing ``df`` as a Parquet table in the shared checkpoint folder
    and reading it back: later passes are columnar (a count reads one column) and the
    files survive executor loss. Repeated column names and types that Parquet lacks go
    through ``DataFrame.checkpoint``; any other error rises."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    names = [n.lower() for n in df.columns]
    if not base or len(set(names)) < len(names) or any("void" in t or "interval" in t for _, t in df.dtypes):
        return df.checkpoint(eager=True)
    path = shared_table_path(spark)
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)


_tables: list = []
_tables_lock = threading.Lock()
_atexit_registered = [False]


def _track_table(spark: SparkSession, path: str) -> None:
    import atexit

    with _tables_lock:
        _tables.append(path)
        if not _atexit_registered[0]:
            _atexit_registered[0] = True
            atexit.register(lambda: cleanup_checkpoints(spark))


def cleanup_checkpoints(spark: SparkSession) -> int:
    """Delete the numbering tables this driver wrote into the checkpoint folder (Spark's
    checkpoint cleaner only handles RDD checkpoints). Call it when the results that
    depend on them are written; it also runs, best effort, when the driver exits."""
    removed = 0
    with _tables_lock:
        paths = list(_tables)
        _tables.clear()
    for path in paths:
        try:
            jp = spark._jvm.org.apache.hadoop.fs.Path(path)
            if jp.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jp, True):
                removed += 1
        except Exception:  # noqa: BLE001 - session already stopped or Spark Connect
            pass
    return removed


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate for the optimized plan (None when unknown)."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:  # Spark Connect or missing stats
        return None


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES, measure: bool = False) -> DataFrame:
    """Hint a broadcast only when the estimated size is below ``limit``.

    The estimate of an aggregate follows its input. With ``measure`` a table estimated above
    the limit is written to the checkpoint folder once and judged by its real size.
    Otherwise the planner keeps its own choice (sort-merge or shuffled hash join),
    so a side that grows with the data never gets pinned to every executor.
    """
    size = estimated_bytes(df)
    if measure and (size is None or size > limit):
        df = reliable_checkpoint(df)
        size = estimated_bytes(df)
    if size is not None and size <= limit:
        return F.broadcast(df)
    return df


def default_parallelism(spark: SparkSession) -> int:
    try:
        return max(1, spark.sparkContext.defaultParallelism)
    except Exception:  # Spark Connect
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


_shipped: set = set()
_ship_lock = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``grainset`` importable in Python workers (UDFs, grouped/partition pandas
    functions, the row-group data source): zip the package once per application and
    add it with ``addPyFile`` (``addArtifacts`` on Spark Connect). Executors fetch it
    from the driver, so this works on a cluster as well as locally."""
    try:
        app = spark.sparkContext.applicationId
    except Exception:
        app = spark.conf.get("spark.app.id", "connect")
    with _ship_lock:
        if app in _shipped:
            return
        pkg_dir = os.path.dirname(os.path.abspath(__file__))
        out_dir = tempfile.mkdtemp(prefix="grainset-pkg-")
        zpath = os.path.join(out_dir, "grainset.zip")
        with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
            for root, _dirs, files in os.walk(pkg_dir):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(root, f)
                        zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
        try:
            spark.sparkContext.addPyFile(zpath)
        except Exception:  # Spark Connect
            spark.addArtifacts(zpath, pyfile=True)
        _shipped.add(app)
