"""Session defaults and the shared folder for checkpoints and interim tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: interim tables that this process made and has not removed
_made: dict[str, None] = {}


def get_spark(app: str = "tallyfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (AQE, skew join, UTC)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    A session that names none gets a fresh temporary folder, remembered by the
    context, only if its master is local; on a cluster that folder would be
    another one on each machine, so it raises there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if not current:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current:
        return current
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
    folder = tempfile.mkdtemp(prefix="tallyfold-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one interim table in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made[path] = None
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete an interim table made under ``scratch_path``, on whatever store it lies."""
    base = shared_dir(spark).rstrip("/")
    if not path.startswith(base + "/") or ".." in path:
        raise ValueError(f"{path} is no interim table of {base}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _made.pop(path, None)


@contextmanager
def interim(spark: SparkSession) -> Iterator[None]:
    """On leaving, also by an error, removes every interim table made inside.

    Results are read from these tables when they run, so they must be written or
    collected inside. Tables made before stay; those that other threads make
    meanwhile go too.
    """
    before = set(_made)
    try:
        yield
    finally:
        for path in [p for p in _made if p not in before]:
            remove(spark, path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for what is planned inside; what stood there before comes back on leaving."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of the executors that wrote it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
