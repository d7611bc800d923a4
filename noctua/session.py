"""Session helpers: builder for tests and benches, per-query SQL settings,
and the shared checkpoint / scratch location."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# SQL settings every operator relies on: UTC wall clock and NTZ literals so
# that `timestamp '...'` literals compare with the NTZ columns of the inputs.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "noctua") -> SparkSession:
    builder = (SparkSession.builder.master(master).appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g"))
    for k, v in SQL_SETTINGS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # noqa: BLE001 - Spark Connect
        pass
    prepare(spark)
    return spark


def ship_code() -> None:
    """Pickle this package's functions by value into Python UDF closures, so
    executors run the pandas kernels without the package installed there."""
    import sys

    from pyspark import cloudpickle
    pkg = sys.modules[__name__.rsplit(".", 1)[0]]
    cloudpickle.register_pickle_by_value(pkg)


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to an existing session (idempotent)."""
    ship_code()
    for k, v in SQL_SETTINGS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    On a cluster it is set by the deployment and points at shared storage;
    it is only filled in here when unset (local tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "") or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = os.environ.get("NOCTUA_CHECKPOINT_DIR", "/tmp/noctua-checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    try:  # classic sessions; Spark Connect reads spark.checkpoint.dir itself
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(root)
    except Exception:  # noqa: BLE001
        pass
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint root (never reused)."""
    return f"{checkpoint_root(spark).rstrip('/')}/noctua/{name}-{uuid.uuid4().hex[:12]}"
