"""Session defaults and the shared folder for files that jobs leave behind."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(app: str = "plumbline", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the library is tuned for.

    Settings given by the caller (with ``__`` for dots) and by ``spark-submit``
    win.  Shuffle partitions are left to the cluster; AQE coalesces them.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for name, value in {**defaults, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the session.

    Only a local session may fall back to a temporary folder; a cluster
    without the setting is a configuration error, because a folder on one
    machine is lost with that machine.
    """
    root = spark.conf.get(CHECKPOINT_SETTING, None)
    if root:
        return root.rstrip("/")
    if not is_local(spark):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set(CHECKPOINT_SETTING, root)
    return root


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared root; nothing is created yet."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
