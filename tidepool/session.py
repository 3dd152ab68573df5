"""Session helpers: building a session for tests/bench and cutting lineage.

Lineage is cut with a reliable ``checkpoint()`` into the folder named by
``spark.checkpoint.dir``.  The folder is read from the session; a default is
only set when the setting is absent (local tests), never overriding a cluster.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tidepool") -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    parts = shuffle_partitions or int(os.environ.get("TIDEPOOL_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEPOOL_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[int] = set()
_BROADCAST_SCOPES: list[list] = []


def broadcast(spark: SparkSession, value):
    """``sc.broadcast`` that is released at the end of the innermost :func:`broadcast_scope`."""
    b = spark.sparkContext.broadcast(value)
    if _BROADCAST_SCOPES:
        _BROADCAST_SCOPES[-1].append(b)
    return b


class broadcast_scope:
    """Destroy the broadcasts created inside the block on exit.

    Used around one loop iteration: once its results are checkpointed nothing
    reads those broadcasts again, so a long run does not accumulate model
    weights and target matrices on the driver and executors.
    """

    def __enter__(self):
        _BROADCAST_SCOPES.append([])
        return self

    def __exit__(self, *exc):
        for b in _BROADCAST_SCOPES.pop():
            try:
                b.destroy()
            except Exception:  # already gone
                pass
        return False


def ship_package(spark: SparkSession) -> None:
    """Make ``tidepool`` importable in Python workers started from any directory.

    Operators that run numpy inside tasks (``mapInArrow``/``applyInPandas``)
    pickle functions by module path; a worker whose working directory does not
    contain the package could not import it.  The package is zipped once per
    session on the driver and distributed with ``addPyFile`` in local mode; a
    cluster deployment passes the package with ``--py-files`` (or installs it),
    so nothing is written to a machine-local folder there.
    """
    import zipfile

    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    if not sc.master.startswith("local"):
        # on a cluster the deployment ships the package (--py-files / an installed wheel)
        _SHIPPED.add(id(sc))
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="tidepool-code-")
    zpath = os.path.join(out_dir, "tidepool.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    _SHIPPED.add(id(sc))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        # Only reached in local tests: no cluster-provided folder exists.
        conf_dir = tempfile.mkdtemp(prefix="tidepool-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


#: Called with every DataFrame that is about to be checkpointed (plan checks hook in here).
CHECKPOINT_OBSERVERS: list = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint; survives executor loss (unlike localCheckpoint)."""
    for observe in CHECKPOINT_OBSERVERS:
        observe(df)
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*frames: DataFrame | None) -> None:
    """Delete the files of checkpoints made by :func:`cut_lineage` that nothing reads any more."""
    for df in frames:
        if df is None:
            continue
        spark = df.sparkSession
        saved = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if saved.isDefined():
            path = spark._jvm.org.apache.hadoop.fs.Path(saved.get())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    It does so when the driver's JVM collects its garbage, which a driver with free memory puts off for long.
    """
    gc.collect()
    spark._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tidepool-tables/{name}-{uuid.uuid4().hex[:12]}"
