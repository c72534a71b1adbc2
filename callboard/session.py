"""Session settings. Nothing that the cluster has already set is changed."""

from __future__ import annotations

import tempfile
import warnings

from pyspark.sql import SparkSession

# Settings every job of this package relies on. Applied only where the session
# has no explicit value, so a cluster's own configuration always wins.
RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even when a later aggregate then needs one more
    # exchange: one extra shuffle is cheaper than one task holding a third of the rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows can be whole documents: Python workers get them in batches of a bounded size.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def build(app: str = "callboard", cpus: str | int = "*", **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; a cluster submits its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for name, value in {**RUNTIME_DEFAULTS, **conf}.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Fill in the runtime settings that this session leaves unset."""
    explicit = spark.conf.getAll
    for name, value in RUNTIME_DEFAULTS.items():
        if name not in explicit:
            spark.conf.set(name, value)
    return spark


def _is_local(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file"


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach, for checkpoints and working tables.

    The cluster names it in ``spark.checkpoint.dir``. Only when neither that setting
    nor a context checkpoint folder exists (local tests) is a temporary one made. On a
    cluster a folder of the local file system draws a warning: it must be a shared mount.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not spark.sparkContext.master.startswith("local") and _is_local(spark, configured):
            warnings.warn(f"{configured} must be mounted on every executor and the driver", stacklevel=2)
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="callboard-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()
