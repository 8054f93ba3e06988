"""Spark session helpers.

The library never creates its own cluster settings on a real cluster: it
reads what the session already has and only fills in defaults that are
unset (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults applied only when the key is not already configured.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "covenant") -> SparkSession:
    """A local session for tests and the bench script."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.scheduler.mode", "FAIR")  # the checks of a table are a pool
        .config("spark.driver.memory", os.environ.get("COVENANT_DRIVER_MEMORY", "12g"))
        # no Python call-site capture per DataFrame call (an error-message aid
        # that costs several JVM round trips for every function call)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the operator sets it to shared storage (an error is raised
    when it is missing); only for a local master with no setting (tests) a
    scratch folder is created here.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    master = spark.sparkContext.master or ""
    if not master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: on a cluster it must name a shared folder "
            "(executors and driver must all see it); a machine-local folder would not survive "
            "executor loss")
    path = tempfile.mkdtemp(prefix="covenant-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def configure(spark: SparkSession) -> SparkSession:
    """Apply library defaults to an existing session (only unset keys)."""
    for k, v in _DEFAULTS.items():
        if k in ("spark.ui.enabled", "spark.ui.showConsoleProgress"):
            continue  # static; cannot change on a running session
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark
