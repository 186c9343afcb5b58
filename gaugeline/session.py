"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid as _uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "gaugeline",
              shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    On a cluster, pass nothing for ``master`` and size ``shuffle_partitions`` to
    roughly input_bytes / 128 MB; AQE coalesces what turns out small and splits
    skewed join partitions.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_PRIVATE_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for lineage cuts and scratch tables.

    Read from ``spark.checkpoint.dir``; only when the session has none and runs on a
    local master (tests, a laptop) a private temporary folder is created and
    registered.  On a cluster a missing setting is an error: executors would each
    write to a disk of their own.
    """
    sc = spark.sparkContext
    d = (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
         or _PRIVATE_DIRS.get(sc.applicationId))
    if not d:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="gaugeline-ckpt-")
        _PRIVATE_DIRS[sc.applicationId] = d
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 - core confs may be read-only at run time
            pass
    # make DataFrame.checkpoint() use the same folder
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder (never reused)."""
    return os.path.join(shared_dir(spark), "gaugeline", f"{name}-{_uuid.uuid4().hex}")
