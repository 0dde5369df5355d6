"""Spark session helpers.

The library never creates its own cluster settings beyond what a user would
pass on ``spark-submit``.  ``get_session`` is for tests, the bench and the
command line; library functions always take the caller's session.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "tidepool") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(os.environ.get("TIDEPOOL_SHUFFLE_PARTITIONS", cpus))
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.tidepool.spread", cpus)  # test tables are one small file each
        .config("spark.driver.memory", os.environ.get("TIDEPOOL_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster it is set by whoever runs it and lies in shared storage;
    without it this raises, since a folder of the driver's machine would not be
    seen by the executors.  Only in local mode (tests) is one made.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or _CHOSEN.get(spark.sparkContext.applicationId)
    if not current:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="tidepool-ckpt-")
    if _CHOSEN.get(spark.sparkContext.applicationId) != current:
        _CHOSEN[spark.sparkContext.applicationId] = current
        spark.sparkContext.setCheckpointDir(current)
    return current


#: the folder in use, by Spark application
_CHOSEN: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
