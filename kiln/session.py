"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every kiln session wants; a cluster's own spark-defaults win for
# anything set there because builder.config only fills what the user passes.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "kiln", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The session setting wins (on a cluster it names storage every executor
    can reach); the SparkContext's checkpoint directory is the fallback.
    Only a local session with neither gets a private temp folder, which is
    how tests run."""
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current.rstrip("/")
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir is unset; point it at shared storage")
    path = tempfile.mkdtemp(prefix="kiln-ckpt-")
    sc.setCheckpointDir(path)  # later calls find it through getCheckpointDir()
    try:
        spark.conf.set("spark.checkpoint.dir", path)
    except Exception:  # core configs may be read-only at runtime; the context holds it
        pass
    return path


_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    root = checkpoint_root(spark)
    base = root if _SCHEME.match(root) else os.path.abspath(root)
    return f"{base}/kiln-{name}-{uuid.uuid4().hex[:12]}"
