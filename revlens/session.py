"""Session helpers.

Library code never creates its own session; it takes the caller's. The helpers
here only fill in settings that are *unset*, so a cluster's own configuration
(shuffle partitions, checkpoint directory, AQE) always wins.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the engine relies on for exact results. They do not depend on data
# size, so they are applied to any session the library is handed.
_SEMANTIC_CONF = {
    # All event times are UTC; rendering and 24 h windows assume it.
    "spark.sql.session.timeZone": "UTC",
    # Model responses may repeat a key; the last one wins, like a JSON object.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Lower-casing header names can collide; the last value wins, like a dict.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

# Performance defaults, applied only where the session leaves them unset.
_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the engine's semantic settings to an existing session."""
    for key, value in _SEMANTIC_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, value in _DEFAULT_CONF.items():
        try:
            if spark.conf.get(key, None) is None:
                spark.conf.set(key, value)
        except Exception:  # static / unmodifiable conf on some deployments
            pass
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    On a cluster this must be set (a shared filesystem path). Only when it is
    unset, as in local tests, a fresh private scratch folder is created.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no driver-side context; the server's conf decides
        sc = None
    configured = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    if not configured:
        if sc is None or not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: set it to a shared folder every executor can "
                "reach (checkpoints and sink tables live there)"
            )
        configured = tempfile.mkdtemp(prefix="revlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint directory for materialised tables."""
    return os.path.join(checkpoint_dir(spark), name)


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "revlens") -> SparkSession:
    """A local session for tests and the bench (never used by library code)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def materialise(df):
    """Compute `df` once and cut its lineage: reliable checkpoint into
    spark.checkpoint.dir (survives executor loss), persisted first so the
    checkpoint write does not recompute it. Used where recomputation would be
    wrong or costly (model calls) and where two consumers must see identical
    rows."""
    from pyspark import StorageLevel

    checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out

