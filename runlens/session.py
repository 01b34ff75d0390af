"""Session construction and the shared scratch location.

Configuration follows the scale notes in the README: AQE on (partition
coalescing, skew-join splitting, runtime broadcast conversion), ANSI on
(Spark 4 default), UTC session time zone, Arrow for pandas UDFs, UI off.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Sides below this many bytes may be broadcast by the planner; anything we
# broadcast by hint has a size bound that does not grow with the data.
BROADCAST_THRESHOLD = str(32 * 1024 * 1024)


def _driver_memory() -> str:
    """RUNLENS_DRIVER_MEMORY, else 60 % of physical memory capped at 16 GB
    (local mode runs every executor thread inside the driver JVM)."""
    if os.environ.get("RUNLENS_DRIVER_MEMORY"):
        return os.environ["RUNLENS_DRIVER_MEMORY"]
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
        return f"{max(1, min(16, int(total * 0.6 / 2**30)))}g"
    except (ValueError, OSError, AttributeError):
        return "4g"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "runlens") -> SparkSession:
    master = master or os.environ.get("RUNLENS_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("RUNLENS_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", BROADCAST_THRESHOLD)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", _driver_memory())
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
        # Whole-stage methods above the JIT's 8000-byte limit would run
        # interpreted (4x slower on the wide string projections here); fall
        # back to per-operator code for those instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Positional operators checkpoint their range-sorted input; remove those
        # files once the checkpointed data is no longer referenced.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared file system folder and is used
    as is. Only when it is unset and all tasks run in this process (local tests)
    a private folder is created; on a cluster executors could not share it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="runlens-ckpt-")
        atexit.register(shutil.rmtree, current, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint location; it lives as long as the driver's Python process."""
    own = f"{ensure_checkpoint_dir(spark).rstrip('/')}/runlens-scratch/{spark.sparkContext.applicationId}"
    if own not in _SCRATCH:
        _SCRATCH.add(own)
        atexit.register(_forget, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


_SCRATCH: set[str] = set()


def _forget(spark: SparkSession, folder: str) -> None:
    """Delete an application's scratch folder, if the application is still there to do it."""
    try:
        context = spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # stopped before: the folder stays, as after a crash
        pass


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they run (once per application)."""
    context = spark.sparkContext
    if getattr(context, "_runlens_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    # Spark serves this file to executors from the driver as long as the application runs
    folder = os.path.realpath(tempfile.mkdtemp(prefix="runlens-code-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "runlens.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.join("runlens", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._runlens_shipped = True
